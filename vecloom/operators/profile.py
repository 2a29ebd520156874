"""What is in each cluster: sizes, samples, providers, words and themes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.text import bigrams, content_tokens, english_stop_words, is_blank, tokens
from vecloom.operators.relational import top_n_per_group
from vecloom.schema import palette_colour
from vecloom.session import cut_lineage, least_shuffle_partitions

# Report sizes.
SAMPLE_SIZE = 5
PREVIEW_SIZE = 3
TOP_PROVIDERS = 5
TOP_WORDS = 10
TOP_THEMES = 5
CLOUD_WORDS = 50
MIN_DOCS = 2
MAX_DOC_SHARE = 0.9
#: Bytes of text whose terms one task counts; a term takes many times its bytes in the task's table.
TASK_BYTES = 16_000_000


def cluster_summary(df: DataFrame) -> DataFrame:
    """Count, first and last title of each cluster; null titles do not count.

    Ids are grouped, two titles a cluster are fetched by them.
    """
    named = F.when(F.col("title").isNotNull(), F.col("item_id"))
    ends = df.groupBy("cluster").agg(
        F.count("title").alias("count"), F.min(named).alias("first_id"), F.max(named).alias("last_id")
    )
    title = lambda at, into: df.select(F.col("item_id").alias(at), F.col("title").alias(into))
    # The tables of ends are as small as the number of clusters; Spark broadcasts them once it has seen their size.
    first = title("first_id", "first").join(ends, "first_id", "right")
    return title("last_id", "last").join(first, "last_id", "right").select("cluster", "count", "first", "last")


def cluster_distribution(df: DataFrame, decimals: int = 2) -> DataFrame:
    """Size and percentage of each cluster, and the number of clusters."""
    sizes = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))
    # The window runs over one row per cluster, not over the items.
    every = Window.partitionBy(F.lit(0))
    return sizes.select(
        "cluster",
        "count",
        F.round(F.col("count") / F.sum("count").over(every) * 100, decimals).alias("percentage"),
        F.count(F.lit(1)).over(every).alias("clusters"),
    )


def cluster_samples(df: DataFrame, n: int = SAMPLE_SIZE) -> DataFrame:
    """The first ``n`` items of each cluster in row order."""
    return top_n_per_group(df, ["cluster"], [F.col("item_id")], n, "sample_rank")


def random_samples(df: DataFrame, n: int = SAMPLE_SIZE, seed: int = 42) -> DataFrame:
    """``n`` pseudo-random items per cluster, the same for any partitioning.

    The order is two rounds of a Lehmer generator over the id, which cannot overflow
    and is reproducible in plain SQL.
    """
    modulus, factor = F.lit(2147483647).cast("long"), F.lit(48271).cast("long")
    mixed = F.pmod(F.col("item_id") + F.lit(seed), modulus)
    for _ in range(2):
        mixed = mixed * factor % modulus
    return top_n_per_group(df, ["cluster"], [mixed, F.col("item_id")], n, "sample_rank")


def cluster_info(df: DataFrame, n: int = SAMPLE_SIZE) -> DataFrame:
    """Per cluster: size, colour and the names of its first ``n`` items."""
    sizes = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))
    names = (
        cluster_samples(df.select("cluster", "item_id", "title"), n)
        .groupBy("cluster")
        .agg(F.array_sort(F.collect_list(F.struct("sample_rank", "title"))).alias("ranked"))
    )
    return sizes.join(names, "cluster").select(
        "cluster",
        "count",
        palette_colour(F.col("cluster")).alias("color"),
        F.transform("ranked", lambda r: r["title"]).alias("sample_games"),
    )


def top_providers(df: DataFrame, n: int = TOP_PROVIDERS, decimals: int = 1) -> DataFrame:
    """Most frequent providers per cluster with their share of the cluster.

    Equal counts rank by first appearance. Blank and unknown providers use up their
    rank and are then left out, as a report would print them.
    """
    counted = df.groupBy("cluster", F.coalesce("provider", F.lit("")).alias("provider")).agg(
        F.count(F.lit(1)).alias("count"), F.min("item_id").alias("first_item")
    )
    sizes = counted.groupBy("cluster").agg(F.sum("count").alias("size"))
    ranked = top_n_per_group(
        counted, ["cluster"], [F.desc("count"), F.col("first_item")], n, "rank"
    ).filter(~F.col("provider").isin("", "Unknown"))
    return ranked.join(sizes, "cluster").select(
        "cluster",
        "rank",
        "provider",
        "count",
        F.round(F.col("count") / F.col("size") * 100, decimals).alias("percentage"),
    )


def _word_counts(df: DataFrame, text: str, stop_words: Sequence[str]) -> DataFrame:
    """(cluster, term, tf): combined map-side, so a hot cluster or word stays small."""
    term = F.explode(tokens(F.col(text))).alias("term")
    exploded = df.select("cluster", term)
    if stop_words:
        exploded = exploded.filter(~F.col("term").isin(*stop_words))
    return exploded.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("tf"))


def top_words(
    df: DataFrame,
    text: str = "summary",
    n: int = TOP_WORDS,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """The most used words of each cluster, ties alphabetical.

    A cluster without any word appears once with the word ``N/A``.
    """
    stop = english_stop_words() if stop_words is None else stop_words
    ranked = top_n_per_group(
        _word_counts(df, text, stop), ["cluster"], [F.desc("tf"), F.col("term")], n
    )
    clusters = df.select("cluster").distinct()
    return clusters.join(ranked, "cluster", "left").select(
        "cluster",
        F.coalesce("rank", F.lit(1)).alias("rank"),
        F.coalesce("term", F.lit("N/A")).alias("term"),
        F.coalesce("tf", F.lit(0)).cast("long").alias("tf"),
    )


def term_weights(
    df: DataFrame,
    text: str = "summary",
    n: int = CLOUD_WORDS,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """Word-cloud weights: the ``n`` top words of a cluster relative to its top word."""
    stop = english_stop_words() if stop_words is None else stop_words
    ranked = top_n_per_group(
        _word_counts(df, text, stop), ["cluster"], [F.desc("tf"), F.col("term")], n
    )
    # At most n rows per cluster are left, so grouping them by cluster is bounded.
    peak = ranked.filter(F.col("rank") == 1).select("cluster", F.col("tf").alias("peak"))
    return ranked.join(peak, "cluster").select(
        "cluster", "rank", "term", "tf", F.round(F.col("tf") / F.col("peak"), 6).alias("weight")
    )


def term_statistics(
    df: DataFrame, text: str = "summary", stop_words: Sequence[str] | None = None
) -> DataFrame:
    """(cluster, term, tf, df) over words and word pairs.

    Terms of a document are sorted inside its row; a term's first place marks it once
    for the document count. Term and document counts therefore come from one map-side
    combined aggregate and no per-document shuffle is needed.
    """
    stop = english_stop_words() if stop_words is None else stop_words
    words = content_tokens(F.col(text), stop)
    docs = df.filter(~is_blank(F.col(text))).select("cluster", words.alias("words"))
    terms = docs.select(
        "cluster", F.sort_array(F.concat("words", bigrams(F.col("words")))).alias("terms")
    )
    marked = F.transform(
        "terms",
        lambda t, i: F.struct(
            t.alias("term"),
            F.when((i > 0) & (t == F.get("terms", i - 1)), 0).otherwise(1).alias("first"),
        ),
    )
    return (
        terms.select("cluster", F.inline(marked))
        .groupBy("cluster", "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.sum("first").alias("df"))
    )


def key_themes(
    df: DataFrame,
    text: str = "summary",
    n: int = TOP_THEMES,
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_DOC_SHARE,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """Leading words and word pairs of each cluster's non-blank texts.

    A theme occurs in at least ``min_docs`` documents and at most ``max_share`` of them.
    Clusters too small to satisfy both have no theme. The number of tasks that count and add up
    terms follows the bytes of text, so that a task's memory does not grow with the table.
    """
    spark = df.sparkSession
    key = "item_id" if "item_id" in df.columns else text
    rows = df.select(*dict.fromkeys(["cluster", text, key])).filter(~is_blank(F.col(text)))
    bytes_of = F.sum(F.octet_length(text).cast("long"))
    docs = cut_lineage(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), bytes_of.alias("bytes")), "docs")
    size = docs.agg(F.sum("bytes")).first()[0] or 0
    tasks = -(-size // TASK_BYTES)
    if tasks > spark.sparkContext.defaultParallelism:
        rows = rows.repartition(tasks, F.xxhash64(key))
    with least_shuffle_partitions(spark, tasks):
        often = cut_lineage(term_statistics(rows, text, stop_words).filter(F.col("df") >= min_docs), "terms")
    common = often.join(docs.drop("bytes"), "cluster").filter(F.col("df") <= F.lit(max_share) * F.col("docs"))
    return top_n_per_group(common, ["cluster"], [F.desc("tf"), F.col("term")], n).select(
        "cluster", "rank", "term", "tf", "df"
    )


def cluster_profile(df: DataFrame, text: str = "summary") -> DataFrame:
    """One row per cluster: size, share, providers, themes and sample titles.

    Every part is an aggregate keyed by cluster; the joins only see one row each. The needed
    columns are written once, so that the input, a join as a rule, is computed once.
    """
    df = cut_lineage(df.select("cluster", "item_id", "title", "provider", text), "profile")

    def listed(rows: DataFrame, value: str, rank: str, into: str) -> DataFrame:
        return rows.groupBy("cluster").agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct(rank, value))), lambda r: r[value]
                ),
                ", ",
            ).alias(into)
        )

    providers = top_providers(df).withColumn(
        "line", F.format_string("%s: %d (%s%%)", "provider", "count", F.col("percentage").cast("string"))
    )
    samples = cluster_samples(df.select("cluster", "item_id", F.coalesce("title", F.lit("")).alias("title")))
    profile = cluster_distribution(df, 1).drop("clusters")
    for part in (
        listed(providers, "line", "rank", "providers"),
        listed(key_themes(df, text), "term", "rank", "themes"),
        listed(samples, "title", "sample_rank", "samples"),
    ):
        profile = profile.join(part, "cluster", "left")
    return profile.select(
        "cluster",
        "count",
        "percentage",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("providers", "themes", "samples")],
    ).orderBy(F.desc("count"), "cluster")
