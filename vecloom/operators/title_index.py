"""Titles found by a table of their trigrams instead of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
#: Folders that postings, and titles, are dealt to by a hash; a look-up reads the folders of its trigrams and ids.
BUCKETS = 64


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; empty for texts of fewer code points."""
    # Cut into code points once: a substring is found by counting from the start, which long titles pay for squared.
    points = F.split(F.lower(text), "")
    joined = points
    for start in range(2, GRAM + 1):
        joined = F.zip_with(joined, F.slice(points, F.lit(start), F.size(points)), lambda a, b: F.concat(a, b))
    # The last places have no whole trigram.
    cut = F.filter(joined, lambda g: g.isNotNull())
    return F.coalesce(F.array_distinct(cut), F.array().cast("array<string>"))


def _bucket(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def _paths(path: str) -> tuple[str, str]:
    return f"{path.rstrip('/')}/postings", f"{path.rstrip('/')}/titles"


def build_title_index(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the index of (item_id, title, provider) below ``path``; ``mode="append"`` adds items to it.

    Two tables: postings (gram, item_id), and the titles with the columns a search returns. A posting of a
    common gram is as long as the gram is frequent and is spread over as many tasks and files as it
    fills; rows are sorted by gram in a file, so its row groups tell which grams they hold.
    Null titles are in no posting. Items must not be in the index already.
    """
    postings, titles = _paths(path)
    rows = df.select("item_id", "title", "provider").withColumn("bucket", _bucket(F.col("item_id")))
    rows.repartitionByRange("bucket", "item_id").sortWithinPartitions("bucket", "item_id").write.mode(mode).partitionBy(
        "bucket"
    ).parquet(titles)
    listed = df.filter(F.col("title").isNotNull()).select(F.explode(grams(F.col("title"))).alias("gram"), "item_id")
    # Dealt by ranges of (gram, id): a gram that very many titles hold fills several tasks.
    listed.withColumn("bucket", _bucket(F.col("gram"))).repartitionByRange("bucket", "gram", "item_id").sortWithinPartitions(
        "bucket", "gram", "item_id"
    ).write.mode(mode).partitionBy("bucket").parquet(postings)


def search_titles(spark: SparkSession, path: str, contains: str, **equals: str) -> DataFrame:
    """(item_id, title, provider) of the items whose title contains ``contains``, in any case.

    Items that stand in the postings of all trigrams of the wanted text are candidates; their titles are
    fetched by id and checked. Texts of fewer than three code points have no
    trigram: all titles are read for them, the answer is the same. ``equals`` are further conditions on
    the provider.
    """
    postings, titles = _paths(path)
    low = contains.lower()
    wanted = list(dict.fromkeys(low[i : i + GRAM] for i in range(len(low) - GRAM + 1)))
    found = spark.read.schema("item_id long, title string, provider string, bucket int").parquet(titles)
    if wanted:
        table = spark.read.schema("gram string, item_id long, bucket int").parquet(postings)
        deal = spark.range(1).select(F.array_distinct(F.array(*[_bucket(F.lit(g)) for g in wanted]))).first()[0]
        hits = (
            table.filter(F.col("bucket").isin(deal) & F.col("gram").isin(wanted))
            .groupBy("item_id")
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") == len(wanted))
            .select("item_id", _bucket(F.col("item_id")).alias("bucket"))
        )
        found = found.join(hits, ["bucket", "item_id"], "left_semi")
    for name, value in equals.items():
        found = found.filter(F.col(name) == value)
    return found.filter(F.contains(F.lower("title"), F.lit(low))).select("item_id", "title", "provider")
