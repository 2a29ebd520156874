"""The registered queries: each takes (spark, folder of tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom import schema as S
from vecloom.functions import text as X
from vecloom.functions.vector import as_double, cosine
from vecloom.operators import clustering as C
from vecloom.operators import embedding as E
from vecloom.operators import enrich as J
from vecloom.operators import ivf as I
from vecloom.operators import layout as L
from vecloom.operators import lsh as H
from vecloom.operators import memo as M
from vecloom.operators import neighbours as N
from vecloom.operators import ordering as O
from vecloom.operators import profile as P
from vecloom.operators import projection as V
from vecloom.operators import quality as Q
from vecloom.operators import relational as R
from vecloom.operators import silhouette as B
from vecloom.operators import sketches as K
from vecloom.operators import stats as Z
from vecloom.operators import title_index as Y
from vecloom.operators import vector_index as W
from vecloom.plans.views import documents_as_items, first_line, item_columns, item_vectors, items, labelled_ids
from vecloom.session import cut_lineage, new_path
from vecloom.sources import readers, writers
from vecloom.streaming import enrichment
from vecloom.streaming.refresh import refresh, refresh_from_disk

Query = Callable[[SparkSession, str], DataFrame]

VECTOR_SIZE = 64
# Aspect words that occur in the generated test texts.
TEST_ASPECTS = {
    "theme": ("the", "and"),
    "features": ("with", "by"),
    "verdict": ("was", "that"),
    "look_and_sound": ("this", "for"),
}

_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _rounded(name: str, decimals: int = 6):
    return F.round(F.col(name), decimals).alias(name)


# ---- sources and sinks -------------------------------------------------------------


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    writers.write_csv(items(spark, sf_dir), path)
    back = readers.read_summarised_csv(spark, path)
    # CSV cannot tell an empty field from a missing one.
    return back.select("item_id", *[F.coalesce(c, F.lit("")).alias(c) for c in back.columns[1:]])


@query
def tolerant_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean rows, padded rows, over-long rows (German) and short rows in one file."""
    path = new_path(spark, "dirty")
    docs = readers.read_table(spark, sf_dir, "documents").select(
        "lang", first_line().alias("title"), F.col("text").alias("review")
    )
    title, review = X.csv_quoted(F.col("title")), X.csv_quoted(F.col("review"))
    padded = F.concat_ws(",", F.concat(F.lit("  "), title), F.concat(F.lit(" "), review))
    line = F.when(F.col("lang") == "de", F.concat(padded, F.lit(',"extra"'))).otherwise(padded)
    short = labelled_ids(spark, sf_dir).select(F.format_string('"only %d"', "item_id").alias("value"))
    body = docs.select(line.alias("value")).unionByName(short)
    # Each part file starts with the header line, as every file of a CSV table does.
    header = "TITLE,Review_Text"
    body.mapInArrow(_with_header(header), "value string").write.text(path)
    return readers.read_reviews(spark, path)


@query
def mixed_header_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one folder with different headers: other names, another column order."""
    path = new_path(spark, "mixed")
    docs = readers.read_table(spark, sf_dir, "documents")
    title, review = X.csv_quoted(first_line()), X.csv_quoted(F.col("text"))
    forms = {
        "title,review": (F.col("lang") == "en", F.concat_ws(",", title, review)),
        "Review_Text,source,TITLE": (F.col("lang") == "de", F.concat_ws(",", review, F.lit("x"), title)),
        "name,body": (~F.col("lang").isin("en", "de"), F.concat_ws(",", title, review)),
    }
    for header, (rows, line) in forms.items():
        lines = docs.filter(rows).select(line.alias("value"))
        lines.mapInArrow(_with_header(header), "value string").write.mode("append").text(path)
    return readers.read_reviews(spark, path)


@query
def append_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written in two parts, the second appended to the first."""
    path = new_path(spark, "appended")
    table = items(spark, sf_dir)
    writers.write_csv(table.filter(F.col("structured_summary").isNotNull()), path)
    writers.append_csv(table.filter(F.col("structured_summary").isNull()), path)
    back = readers.read_summarised_csv(spark, path)
    return back.select("item_id", *[F.coalesce(c, F.lit("")).alias(c) for c in back.columns[1:]])


#: About so many records are stored as one JSON array.
ARRAY_RECORDS = 10_000


def _json_arrays(layout: DataFrame, key: str, records: int = ARRAY_RECORDS) -> DataFrame:
    """(cluster, block, value): the records of each block of a cluster as one JSON array, without their key."""
    sizes = layout.groupBy(F.col("cluster").alias("of")).agg(F.ceil(F.count(F.lit(1)) / records).alias("blocks"))
    blocks = layout.join(sizes, F.col("cluster").eqNullSafe(F.col("of"))).withColumn(
        "block", F.pmod(F.xxhash64(key), F.col("blocks"))
    )
    record = F.struct(*[c for c in layout.columns if c != key])
    return blocks.groupBy("cluster", "block").agg(F.to_json(F.collect_list(record)).alias("value"))


@query
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records stored as JSON arrays of bounded size, one file for each block of a cluster, and read back."""
    path = new_path(spark, "arrays")
    layout = S.to_summary_layout(
        item_vectors(spark, sf_dir).select(
            "*", *[F.get("embedding", F.lit(i)).alias(axis) for i, axis in enumerate("xyz")]
        ),
        "item_id",
    )
    arrays = _json_arrays(layout, "item_id").repartition("cluster", "block")
    arrays.write.partitionBy("cluster", "block").text(path)
    back = readers.read_json_records(spark, f"{path}/*/*/*.txt", S.SUMMARY_LAYOUT_SCHEMA, one_array=True)
    return back.select(
        "title", "provider", "cluster", *[_rounded(c) for c in ("tsneX", "tsneY", "tsneZ")], "summary"
    )


def _with_header(header: str):
    def add(batches):
        import pyarrow as pa

        # All batches of a stream have one schema.
        schema = pa.schema([("value", pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array([header])], schema=schema)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], schema=schema)

    return add


@query
def layout_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = _layout(spark, sf_dir)
    return layout.select("id", *[_rounded(c) for c in "xyz"], "cluster", "color", "name", "description")


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = item_vectors(spark, sf_dir)
    placed = vectors.select(
        "item_id",
        *[F.get("embedding", F.lit(i)).alias(axis) for i, axis in enumerate("xyz")],
        "cluster",
        # Items of one provider have no name, to show the default.
        F.when(F.col("provider") != "src3", F.col("title")).alias("name"),
        F.col("summary").alias("description"),
    )
    return S.to_layout(placed)


@query
def layout_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "layout")
    placed = item_vectors(spark, sf_dir).select(
        "*", *[F.get("embedding", F.lit(i)).alias(axis) for i, axis in enumerate("xyz")]
    )
    writers.write_json_records(S.to_summary_layout(placed), path)
    back = readers.read_json_records(spark, path, S.SUMMARY_LAYOUT_SCHEMA)
    return back.select(
        "title", "provider", "cluster", *[_rounded(c) for c in ("tsneX", "tsneY", "tsneZ")], "summary"
    )


@query
def cluster_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = P.cluster_info(item_vectors(spark, sf_dir))
    return info.select(
        "cluster",
        "count",
        "color",
        F.posexplode("sample_games").alias("position", "sample_game"),
    )


@query
def embedding_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, _ = Q.split_embedded(item_vectors(spark, sf_dir))
    return ok.select("item_id", "title")


# ---- schema and projection ---------------------------------------------------------


@query
def normalise_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = readers.read_table(spark, sf_dir, "documents")
    return S.normalise_columns(docs.toDF(*[c.upper() for c in docs.columns]))


@query
def resolve_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd column names, and the review spread over two columns by provider."""
    first = F.col("provider") < "src3"
    odd = items(spark, sf_dir).select(
        "item_id",
        F.col("title").alias("Item_Title"),
        F.when(first, F.col("review")).alias("Review_Text"),
        F.when(~first, F.col("review")).alias("Other_Review"),
        F.col("structured_summary").alias("Short_Summary"),
        F.col("provider").alias("Provider"),
    )
    return _item_columns(S.coalesce_review(S.resolve_columns(odd), ["review", "other_review"]))


def _item_columns(df: DataFrame) -> DataFrame:
    return df.select("item_id", "title", "review", "structured_summary", "provider")


@query
def combined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = items(spark, sf_dir).select(
        "item_id",
        F.col("title").alias("TitleText"),
        F.col("structured_summary").alias("SummaryText"),
        F.col("review").alias("ReviewText"),
    )
    return S.combine_text_columns(named).select("item_id", "combined_text")


@query
def vector_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "matrix")
    vectors = readers.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    writers.write_matrix_csv(S.unpack_vector(vectors, VECTOR_SIZE), path)
    wide = T.StructType(
        [T.StructField("item_id", T.LongType())]
        + [T.StructField(str(i), T.FloatType()) for i in range(VECTOR_SIZE)]
    )
    packed = S.pack_vector(readers.read_matrix_csv(spark, path, wide), VECTOR_SIZE)
    return packed.select(
        "item_id", F.posexplode(as_double(F.col("embedding"))).alias("dim", "value")
    ).select("item_id", "dim", _rounded("value"))


@query
def vector_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = readers.read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), as_double(F.col("embedding")).alias("embedding")
    )
    wide = S.unpack_vector(vectors, VECTOR_SIZE, prefix="e")
    return wide.select("item_id", *[_rounded(f"e{i}") for i in range(VECTOR_SIZE)])


@query
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = F.col("review")
    return items(spark, sf_dir).select(
        "item_id",
        X.truncate_plain(review).alias("for_embedding"),
        X.truncate_marked(review).alias("for_request"),
    )


@query
def text_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    review, title = F.col("review"), F.col("title")
    return items(spark, sf_dir).select(
        "item_id",
        F.length(X.strip(review)).cast("long").alias("stripped_length"),
        X.has_review(review).alias("passes"),
        F.when(X.has_review(review, X.MIN_SUMMARISABLE_CHARS), X.strip(review))
        .otherwise(X.placeholder_summary(title))
        .alias("gated_text"),
    )


@query
def summary_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(
        "item_id", X.summary_request(F.col("title"), F.col("review")).alias("request")
    )


@query
def embed_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.prefixed_input(R.with_title(items(spark, sf_dir))).select("item_id", "embed_text")


@query
def cluster_assignments_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cluster_table(item_vectors(spark, sf_dir))


# ---- filters -----------------------------------------------------------------------


@query
def with_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_summary(items(spark, sf_dir)).select("item_id", "title", "structured_summary")


@query
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = items(spark, sf_dir)
    done = R.with_summary(table, allow_empty=True)
    return J.pending_items(table, done).select("item_id", "title")


@query
def take_next_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.pending_items(items(spark, sf_dir), start=100, count=250).select("item_id", "title")


@query
def embedding_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = readers.read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), "embedding"
    )
    _, rejects = Q.split_embedded(items(spark, sf_dir).join(vectors, "item_id", "left"))
    return rejects.select("item_id", "title")


@query
def item_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.search_items(items(spark, sf_dir), title_contains="TION", provider="src3")
    return found.select("item_id", "title", "provider")


@query
def item_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by a stored trigram table, built from half of the items and extended by the others."""
    table, path = items(spark, sf_dir), new_path(spark, "titles")
    even = F.col("item_id") % 2 == 0
    Y.build_title_index(table.filter(even), path)
    Y.build_title_index(table.filter(~even), path, mode="append")
    return Y.search_titles(spark, path, "TION", provider="src3")


# ---- joins and sets ----------------------------------------------------------------


@query
def new_items_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.new_to_embed(items(spark, sf_dir), item_vectors(spark, sf_dir)).select("item_id", "title")


@query
def attach_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = item_vectors(spark, sf_dir).select("item_id", "title", "cluster")
    summarised = R.with_summary(items(spark, sf_dir))
    return R.attach_summary(vectors, summarised).select(
        "item_id", "title", "cluster", "summary", "summary_provider"
    )


@query
def upsert_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = items(spark, sf_dir)
    new = J.aspect_summary(J.pending_items(table), TEST_ASPECTS)
    return R.upsert(table, new).select("item_id", "structured_summary")


@query
def merge_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources: the item table, then the summaries of the clustered items."""
    main = items(spark, sf_dir)
    second = item_vectors(spark, sf_dir).select(
        "item_id", "title", F.lit(None).cast("string").alias("review"),
        F.col("summary").alias("structured_summary"),
    )
    merged = R.merge_summaries(main, second)
    return merged.select(
        "title",
        "review",
        "structured_summary",
        F.col("position.source").alias("first_source"),
        F.col("position.row").alias("first_row"),
    )


@query
def vector_item_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = item_vectors(spark, sf_dir)
    return joined.select(
        "item_id", "title", "provider", "cluster", F.size("embedding").alias("dimensions"),
        F.round(F.get(as_double(F.col("embedding")), F.lit(0)), 6).alias("first_value"),
    )


@query
def dedup_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts repeat few names: the costly step runs once per distinct (name, brand)."""
    parts = readers.read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("review")
    )

    def words(df: DataFrame) -> DataFrame:
        return df.select("content", F.size(X.tokens(F.concat_ws(" ", "title", "review"))).alias("n_words"))

    return R.enrich_distinct(parts, ["title", "review"], words).select("item_id", "n_words")


@query
def memo_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by a store that two runs share; ``asked_run`` is the run that had to ask for the content."""
    table, path = items(spark, sf_dir), new_path(spark, "memo")
    results = T.StructType(
        [T.StructField("structured_summary", T.StringType()), T.StructField("asked_run", T.IntegerType())]
    )

    def run(rows: DataFrame, number: int) -> DataFrame:
        def ask(df: DataFrame) -> DataFrame:
            return J.aspect_summary(df, TEST_ASPECTS).withColumn("asked_run", F.lit(number))

        return M.enrich_with_memo(rows.drop("structured_summary"), ["title", "review"], ask, results, path)

    run(table.filter(F.col("item_id") % 2 == 0), 1)
    return run(table, 2).select("item_id", "structured_summary", "asked_run")


@query
def combine_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled items are embedded already; other titles are embedded now, with the same model."""
    table = items(spark, sf_dir)
    known = table.filter(F.col("structured_summary").isNotNull())
    model = E.fit_vectoriser(E.embed_input(known, "review"))
    existing = model.transform(E.embed_input(known, "review")).select("item_id", "title", "embedding")
    rest = R.with_title(table.filter(F.col("structured_summary").isNull()))
    fresh = R.first_per_title(E.embed_input(rest, "review"), not_in=known)
    new = model.transform(fresh).select(*existing.columns)
    return R.combine_vectors(existing, new).select(
        "item_id",
        "title",
        F.round(F.aggregate(as_double(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 4).alias("total"),
    )


@query
def distinct_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_values(items(spark, sf_dir), "title")


# ---- aggregates and reports --------------------------------------------------------


@query
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cluster_summary(item_vectors(spark, sf_dir))


@query
def cluster_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cluster_distribution(readers.read_table(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster"))


@query
def top_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_providers(item_vectors(spark, sf_dir))


@query
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = Z.describe_vectors(readers.read_table(spark, sf_dir, "embeddings"))
    return stats.select("dim", "count", *[_rounded(c) for c in stats.columns[2:]])


@query
def quantile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles from the merged sketches of two halves, and whether their ranks are within the error."""
    vectors = readers.read_table(spark, sf_dir, "embeddings")
    halves = [K.quantile_sketches(vectors.filter(F.col("vec_id") % 2 == half)) for half in (0, 1)]
    found = K.sketched_quantiles(cut_lineage(K.merge_quantile_sketches(*halves), "sketches"))
    ranked = K.rank_of(vectors, found)
    close = (F.col("below") - K.RANK_ERROR <= F.col("share")) & (F.col("share") <= F.col("upto") + K.RANK_ERROR)
    return ranked.select("dim", "count", "share", close.alias("close"))


@query
def key_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct, lost and added keys between two runs, exact, and whether their stored sketches come close."""
    docs = readers.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    vectors = readers.read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"))
    runs = [
        [("items", labelled_ids(spark, sf_dir)), ("vectors", vectors.filter(F.col("item_id") % 3 != 0))],
        [("items", docs), ("vectors", vectors.filter(F.col("item_id") % 3 != 1))],
    ]
    before, after = (cut_lineage(K.key_sketches(run), "keys") for run in runs)
    close = K.compare_key_sketches(before, after)
    names = ("before", "after", "lost", "added")
    audits = []
    for (stage, old), (_, new) in zip(*runs, strict=True):
        audit = Q.consistency_audit([("before", old, None), ("after", new, None)])
        audits.append(
            audit.agg(
                F.lit(stage).alias("stage"),
                F.max(F.when(F.col("position") == 0, F.col("distinct_keys"))).alias("before"),
                F.max(F.when(F.col("position") == 1, F.col("distinct_keys"))).alias("after"),
                F.max("keys_lost").alias("lost"),
                F.max("keys_added").alias("added"),
            )
        )
    exact = audits[0].unionByName(audits[1])
    near = [F.abs(F.col(f"e.{n}") - F.col(f"s.{n}")) <= K.KEY_ERROR * F.col("s.either") for n in names]
    return (
        exact.alias("e")
        .join(close.alias("s"), "stage")
        .select("stage", *[f"e.{n}" for n in names], (near[0] & near[1] & near[2] & near[3]).alias("close"))
    )


@query
def consistency_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = item_vectors(spark, sf_dir)
    return Q.consistency_audit(
        [
            ("summaries", items(spark, sf_dir), "structured_summary"),
            (
                "embeddings",
                readers.read_table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "item_id"),
                "embedding",
            ),
            ("layout", _layout(spark, sf_dir).withColumnRenamed("id", "item_id"), "x"),
            ("clusters", S.cluster_table(vectors), "cluster"),
        ]
    )


@query
def title_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.title_audit(item_vectors(spark, sf_dir))


@query
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_words(item_vectors(spark, sf_dir))


@query
def key_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.key_themes(item_vectors(spark, sf_dir))


@query
def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.term_weights(item_vectors(spark, sf_dir))


@query
def cost_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.cost_ledger(items(spark, sf_dir))


@query
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.cost_estimate(items(spark, sf_dir))


@query
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cluster_profile(item_vectors(spark, sf_dir))


@query
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = readers.read_table(spark, sf_dir, "documents").select("doc_id")
    return O.with_row_number(docs, "doc_id", "row_id")


@query
def cluster_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = item_vectors(spark, sf_dir).select("cluster", "item_id", "title")
    return P.cluster_samples(table)


@query
def cluster_random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = item_vectors(spark, sf_dir).select("cluster", "item_id", "title")
    return P.random_samples(table)


# ---- vectors -----------------------------------------------------------------------


def _neighbour_columns(df: DataFrame) -> DataFrame:
    return df.select("item_id", "rank", "neighbour_id", "neighbour_title", _rounded("similarity"))


@query
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour_columns(N.similar_items(item_vectors(spark, sf_dir)))


@query
def similar_items_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour_columns(N.similar_items_preview(item_vectors(spark, sf_dir)))


@query
def recommend_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour_columns(N.recommend_items(item_vectors(spark, sf_dir)))


@query
def similar_items_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar of a cluster among those in the buckets that hyperplanes give."""
    return _neighbour_columns(H.similar_items_lsh(item_vectors(spark, sf_dir)))


@query
def lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the exact answer the hyperplane tables give by default."""
    vectors = item_vectors(spark, sf_dir)
    return I.recall(H.similar_items_lsh(vectors), N.similar_items(vectors))


def _ivf(spark: SparkSession, sf_dir: str, probes: int) -> DataFrame:
    return I.ivf_neighbours(item_vectors(spark, sf_dir), cells=8, probes=probes, block_rows=256)


@query
def recommend_items_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted file with all its cells probed: exact, in blocks."""
    return _neighbour_columns(_ivf(spark, sf_dir, 8))


@query
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the exact answer six of eight cells give."""
    return I.recall(_ivf(spark, sf_dir, 6), N.recommend_items(item_vectors(spark, sf_dir)))


def _text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with vectors of their reviews' words."""
    embedded = E.embed_documents(E.embed_input(items(spark, sf_dir), "review"), dimensions=VECTOR_SIZE)
    return cut_lineage(embedded.select("item_id", "title", "embedding"), "text-vectors")


def _indexed_neighbours(vectors: DataFrame) -> DataFrame:
    """An index of two items of three, to which the others are added, asked for the neighbours of all."""
    path = new_path(vectors.sparkSession, "vector-index")
    W.build_index(vectors.filter(F.col("item_id") % 3 != 0), path)
    W.add_items(vectors, path)
    queries = vectors.select(F.col("item_id").alias("query_id"), "embedding")
    return W.search_index(queries, path, others=True).select(
        F.col("query_id").alias("item_id"),
        "rank",
        F.col("item_id").alias("neighbour_id"),
        F.col("title").alias("neighbour_title"),
        "similarity",
    )


@query
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour_columns(_indexed_neighbours(_text_vectors(spark, sf_dir)))


@query
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the exact answer the stored index gives from a quarter of its cells."""
    vectors = _text_vectors(spark, sf_dir)
    return I.recall(_indexed_neighbours(vectors), N.recommend_items(vectors))


@query
def recommend_items_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search split into blocks around pivots, as large tables are."""
    return _neighbour_columns(N.recommend_items(item_vectors(spark, sf_dir), block_rows=128))


@query
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each vector to the one with the next id."""
    vectors = readers.read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), as_double(F.col("embedding")).alias("v")
    )
    following = vectors.select((F.col("item_id") - 1).alias("item_id"), F.col("v").alias("next_v"))
    return vectors.join(following, "item_id").select(
        "item_id", F.round(cosine(F.col("v"), F.col("next_v")), 6).alias("similarity")
    )


@query
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best items for the mean vector of every cluster."""
    vectors = item_vectors(spark, sf_dir).select("item_id", "title", "cluster", "embedding")
    centres = C.collect_centres(C.label_means(vectors))
    found = N.semantic_search(vectors, centres)
    return found.select(
        F.col("query_id").alias("query_id"), "rank", "item_id", "title", _rounded("similarity")
    )


@query
def search_query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best items for every vector of the table read backwards."""
    vectors = item_vectors(spark, sf_dir).select("item_id", "title", "embedding")
    asked = readers.read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("embedding")
    )
    return N.search_table(vectors, asked).select("query_id", "rank", "item_id", "title", _rounded("similarity"))


@query
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = readers.read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), "embedding"
    )
    return Z.standardise(vectors).select(
        "item_id", F.posexplode("embedding").alias("dim", "value")
    ).select("item_id", "dim", _rounded("value"))


@query
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = readers.read_table(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster")
    return C.label_means(vectors).select("cluster", "dim", _rounded("value"))


@query
def inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = readers.read_table(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster")
    return C.inertia(vectors).select("cluster", "count", _rounded("inertia"))


@query
def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = readers.read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("label").alias("cluster"), "embedding"
    )
    centres = C.collect_centres(C.label_means(vectors))
    return C.assign_nearest(vectors, centres).select("item_id", "cluster", _rounded("distance"))


@query
def cluster_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = readers.read_table(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster")
    return C.cluster_cohesion(vectors).select("cluster", "count", _rounded("cohesion"))


def _labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("label").alias("cluster"), "embedding"
    )


@query
def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.silhouette_exact(_labelled_vectors(spark, sf_dir)).select(
        "item_id", "cluster", _rounded("silhouette")
    )


@query
def silhouette_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact silhouette, clusters that cannot decide it left out by bounds."""
    return B.silhouette_bounded(_labelled_vectors(spark, sf_dir)).select("item_id", "cluster", _rounded("silhouette"))


@query
def silhouette_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances compared, those of all pairs, and the mean silhouette, for the eight octants of three dimensions."""
    at = lambda i: F.get("embedding", F.lit(i))
    octant = sum((F.when(at(i) > 0, 1 << i).otherwise(0) for i in (1, 2)), F.when(at(0) > 0, 1).otherwise(0))
    vectors = readers.read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), octant.alias("cluster"), F.slice("embedding", 1, 3).alias("embedding")
    )
    mean = B.silhouette_bounded(vectors).groupBy("labelling").agg(F.avg("silhouette").alias("silhouette"))
    return B.comparisons(vectors).join(mean, "labelling").select("items", "compared", "pairs", _rounded("silhouette"))


@query
def silhouette_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.silhouette_fast(_labelled_vectors(spark, sf_dir)).select(
        "item_id", "cluster", _rounded("silhouette")
    )


@query
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = C.kmeans_clusters(_labelled_vectors(spark, sf_dir), k=9)
    return labelled.select("item_id", "cluster", "distance")


@query
def kmeans_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres after three passes from given starts: the five vectors of lowest id."""
    vectors = _labelled_vectors(spark, sf_dir)
    first = vectors.orderBy("item_id").limit(5).collect()
    starts = [(i, r["embedding"]) for i, r in enumerate(first)]
    centres = C.refine_centres(vectors, starts, passes=3)
    moved = spark.createDataFrame(centres, "cluster int, centre array<double>")
    sizes = C.assign_nearest(vectors, centres).groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))
    return (
        moved.join(sizes, "cluster", "left")
        .select("cluster", F.coalesce("count", F.lit(0)).alias("count"), F.posexplode("centre").alias("dim", "value"))
        .select("cluster", "count", "dim", _rounded("value"))
    )


@query
def select_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.select_k(_labelled_vectors(spark, sf_dir), metric="euclidean")


@query
def select_k_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.select_k(_labelled_vectors(spark, sf_dir), metric="sq_euclidean")


@query
def pca_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pca_3d(_labelled_vectors(spark, sf_dir)).select("item_id", "x", "y", "z")


# ---- enrichment --------------------------------------------------------------------


@query
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = E.embed_documents(E.embed_input(items(spark, sf_dir), "review"))
    return embedded.select(
        "item_id", F.posexplode_outer(as_double(F.col("embedding"))).alias("dim", "value")
    ).select("item_id", "dim", _rounded("value", 4)).filter("value IS NULL OR value != 0")


def _measure(texts: list[str]) -> list[list[float]]:
    """Stand-in for a caller's model: length, blanks and sentence ends; refuses some texts."""
    if any(len(t) % 11 == 0 for t in texts):
        raise ValueError("text refused")
    return [[len(t), t.count(" "), t.count(".")] for t in texts]


@query
def embed_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from a caller's function, one text a request; a refused request has no vector but its error."""
    found = E.embed_with(E.embed_input(items(spark, sf_dir), "review"), _measure, request_rows=1)
    return found.select("item_id", "error", F.posexplode_outer(as_double(F.col("embedding"))).alias("dim", "value"))


@query
def aspect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.aspect_summary(items(spark, sf_dir), TEST_ASPECTS).select("item_id", "structured_summary")


def _reviewer(reviews: list[tuple[str, str]]) -> list[str | Exception | None]:
    """Stand-in for a caller's model: fails on tiny reviews, declines short ones."""
    answers: list[str | Exception | None] = []
    for _, review in reviews:
        length = len(review.strip(X.WHITESPACE))
        if length < X.MIN_SUMMARISABLE_CHARS:
            answers.append(ValueError("review too short"))
        else:
            answers.append(None if length < X.MIN_REVIEW_CHARS else review)
    return answers


@query
def enrich_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = J.summarise_with(items(spark, sf_dir), _reviewer)
    return Q.enrich_status(J.result_status(results))


@query
def incremental_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summarise what is pending, store it, and look again: nothing is left."""
    table = items(spark, sf_dir)
    first = J.pending_items(table)
    stored = cut_lineage(R.upsert(table, J.aspect_summary(first, TEST_ASPECTS)), "summarised")
    second = J.pending_items(stored)
    return first.agg(F.lit(1).alias("pass"), F.count(F.lit(1)).alias("n_rows")).unionByName(
        second.agg(F.lit(2).alias("pass"), F.count(F.lit(1)).alias("n_rows"))
    )


def _moody_reviewer(reviews: list[tuple[str, str]]) -> list[str | Exception | None]:
    """Stand-in for a caller's model: fails on some lengths and declines others."""
    kind = [len(review) % 7 for _, review in reviews]
    return [ValueError("try again") if k == 0 else None if k == 1 else t for k, (t, _) in zip(kind, reviews, strict=True)]


@query
def stream_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in three lots, some a second time; the middle lot's batch breaks off and is repeated."""
    documents = readers.read_table(spark, sf_dir, "documents")
    source, output, progress = (new_path(spark, name) for name in ("arriving", "outcomes", "progress"))
    broken: list[int] = []

    def break_once(batch: int) -> None:
        if batch == 1 and not broken:
            broken.append(batch)
            raise RuntimeError("the driver is lost before the batch is committed")

    def run() -> None:
        enrichment.enrich_stream(
            spark,
            source,
            documents.schema,
            lambda df: df.select(*item_columns()),
            _moody_reviewer,
            output,
            progress,
            after_batch=break_once,
        ).awaitTermination()

    lot = F.col("doc_id") % 3
    for number in range(3):
        arriving = documents.filter((lot == number) | ((lot < number) & (F.col("doc_id") % 10 == 0)))
        arriving.write.mode("append").parquet(source)
        try:
            run()
        except StreamingQueryException:
            run()
    done = enrichment.enriched(spark, output).select(
        "item_id",
        F.when(F.col("structured_summary").isNull(), "skipped").otherwise("completed").alias("status"),
        "structured_summary",
        "attempt",
    )
    failed = enrichment.rejects(spark, output).select(
        "item_id", F.when(F.col("final"), "failed").otherwise("open").alias("status"), "attempt"
    )
    return done.unionByName(failed, allowMissingColumns=True)


def _stream_model(spark: SparkSession, sf_dir: str):
    """The vectoriser of the labelled documents, and the means of their vectors by the stored vectors' labels."""
    known = E.embed_input(items(spark, sf_dir).filter(F.col("structured_summary").isNotNull()), "review")
    model = E.fit_vectoriser(known)
    clusters = readers.read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("label").alias("cluster")
    )
    means = C.label_means(model.transform(known).select("item_id", "embedding").join(clusters, "item_id"))
    return model, C.collect_centres(means)


@query
def stream_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled documents arrive as a stream, are embedded and get the nearest cluster mean.

    The vectoriser and the means come from the labelled documents; the clusters of those
    are the labels of their stored vectors.
    """
    model, centres = _stream_model(spark, sf_dir)
    output = new_path(spark, "assigned")
    refresh(
        spark,
        source=f"{sf_dir}/documents*.parquet",
        schema=readers.read_table(spark, sf_dir, "documents").schema,
        prepare=documents_as_items,
        done=labelled_ids(spark, sf_dir),
        embed=lambda df: model.transform(df, "review"),
        centres=centres,
        output=output,
        checkpoint=new_path(spark, "progress"),
    ).awaitTermination()
    return spark.read.schema("item_id long, title string, cluster int").parquet(output)


@query
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from a stream that stops, is started again from disk alone, and meets keys a second time."""
    documents = readers.read_table(spark, sf_dir, "documents")
    source, output, progress = (new_path(spark, name) for name in ("arriving", "assigned", "progress"))

    def run(model=None) -> None:
        refresh_from_disk(
            spark,
            source=source,
            schema=documents.schema,
            prepare=lambda df: df.select(*item_columns(), "arrived"),
            done=labelled_ids(spark, sf_dir),
            output=output,
            checkpoint=progress,
            model=model,
            unique_within="30 days",
        ).awaitTermination()

    early = F.col("doc_id") % 2 == 0
    documents.filter(early).write.parquet(source)
    run(_stream_model(spark, sf_dir))
    # Later files hold the other documents, and every third of all again.
    documents.filter(~early | (F.col("doc_id") % 3 == 0)).write.mode("append").parquet(source)
    documents.filter(F.col("doc_id") % 3 == 0).write.mode("append").parquet(source)
    run()
    return spark.read.schema("item_id long, title string, cluster int").parquet(output)


# ---- layout ------------------------------------------------------------------------


@query
def layout_affinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.affinities(item_vectors(spark, sf_dir)).select("source", "target", _rounded("p", 9))


#: Puts the test vectors into a box far wider than one grid of the layout.
WIDE_BOX = 400.0


@query
def layout_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact repulsion of points in a wide box, and whether the levels of grids come within their error of it."""
    points = readers.read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        *[(F.get("embedding", F.lit(i)).cast("double") * WIDE_BOX).alias(c) for i, c in enumerate("xyz")],
    )
    exact, _ = L.repulsive_forces(points, exact=True)
    levels, _ = L.repulsive_forces(points)
    told = levels.select("item_id", *[F.col(f"r{c}").alias(f"l{c}") for c in "xyz"])
    squares = lambda *values: sum((v * v for v in values[1:]), values[0] * values[0])
    both = cut_lineage(
        exact.join(told, "item_id").select(
            "item_id",
            *[F.col(f"r{c}") for c in "xyz"],
            squares(*[F.col(f"r{c}") for c in "xyz"]).alias("square"),
            squares(*[F.col(f"r{c}") - F.col(f"l{c}") for c in "xyz"]).alias("missed"),
        ),
        "forces",
    )
    mean = F.lit(both.agg(F.avg("square")).first()[0])
    return both.select(
        "item_id",
        *[F.round(F.col(f"r{c}") * 1e6, 1).alias(f"r{c}") for c in "xyz"],
        (F.col("missed") <= L.LEVEL_ERROR**2 * (F.col("square") + mean)).alias("within"),
    )


@query
def layout_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.layout_3d(item_vectors(spark, sf_dir))
