"""Results, sketches and indexes that are kept from run to run."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.operators import memo, sketches, title_index
from vecloom.operators.neighbours import search_table, semantic_search
from vecloom.operators.relational import search_items

ITEM = "item_id long, title string, review string"
RESULTS = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("error", T.StringType())])


def test_a_memo_asks_for_each_content_once_over_runs(spark, tmp_path):
    path, asked = str(tmp_path / "memo"), []

    def enrich(df):
        asked.append(sorted(r.review or "" for r in df.select("review").collect()))
        failed = F.when(F.col("review") == "bad", F.lit("no answer"))
        return df.select("content", F.length("review").alias("n"), failed.alias("error"))

    def run(rows):
        df = spark.createDataFrame(rows, ITEM)
        out = memo.enrich_with_memo(df, ["review"], enrich, RESULTS, path, failed="error", buckets=4)
        return {r.item_id: (r.n, r.error) for r in out.collect()}

    first = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "bad"), (4, "d", None), (5, "e", "")]
    assert run(first) == {1: (2, None), 2: (2, None), 3: (3, "no answer"), 4: (None, None), 5: (0, None)}
    assert asked == [["", "", "bad", "xx"]]
    # Stored contents are not asked for again; failed ones are. Null and empty texts differ.
    assert run([(9, "z", "yyy"), *first])[9] == (3, None)
    assert asked[1:] == [["bad", "yyy"]]
    # Another session knows nothing of the table but its folder.
    spark.sql(f"DROP TABLE {memo.open_memo(spark, path, RESULTS, 4)}")
    assert run(first[:2]) == {1: (2, None), 2: (2, None)}
    assert asked[2:] == [[]]
    assert run([]) == {}


def test_looking_up_a_memo_does_not_shuffle_the_store(spark, tmp_path):
    name = memo.open_memo(spark, str(tmp_path / "memo"), RESULTS, 4)
    wanted = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("content"))
    wanted.select("content", F.lit(1), F.lit("")).repartition(4, "content").write.insertInto(name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        missing = wanted.join(spark.table(name).select("content"), "content", "left_anti")
        plan = missing._jdf.queryExecution().executedPlan().toString()
        assert missing.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_merged_quantile_sketches_keep_the_rank_error(spark):
    n = 20_000
    df = spark.range(n).select(
        "id", F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double"), F.lit(1.0)).alias("embedding")
    )
    parts = [sketches.quantile_sketches(df.filter(F.col("id") % 3 == i)) for i in range(3)]
    found = sketches.sketched_quantiles(sketches.merge_quantile_sketches(*parts), (0.0, 0.1, 0.5, 1.0))
    rows = sketches.rank_of(df, found).collect()
    assert len(rows) == 12 and all(r["count"] == n for r in rows)
    for r in rows:
        assert r.below - sketches.RANK_ERROR <= r.share <= r.upto + sketches.RANK_ERROR


def test_key_sketches_tell_lost_and_added_keys(spark):
    keys = lambda lo, hi: spark.range(lo, hi).withColumnRenamed("id", "item_id")
    nothing = spark.createDataFrame([(None,)], "item_id long")
    before = sketches.key_sketches([("a", keys(0, 30_000).unionAll(keys(0, 30_000))), ("gone", keys(0, 10))])
    after = sketches.key_sketches([("a", keys(5_000, 40_000)), ("new", keys(0, 5)), ("none", nothing)])
    rows = {r.stage: r for r in sketches.compare_key_sketches(before, after).collect()}
    for name, exact in {"before": 30_000, "after": 35_000, "either": 40_000, "lost": 5_000, "added": 10_000}.items():
        assert abs(rows["a"][name] - exact) <= sketches.KEY_ERROR * 40_000
    assert (rows["gone"].lost, rows["gone"].added, rows["new"].lost, rows["new"].added) == (10, 0, 0, 5)
    assert rows["none"].after == 0


TITLES = ["Gold Mine", "gold", "MARIGOLDS", None, "", "go", "Go Go old", "ol dg", "Ünïgold ß", "a'b%_\\", "gold"]


@pytest.mark.parametrize("needle", ["gold", "GOLD", "go", "", "old g", "zzz", "ïgo", "%_", "go go", "gogo"])
def test_the_title_index_finds_what_a_scan_finds(spark, tmp_path_factory, needle):
    global _INDEX
    df = spark.createDataFrame([(i, t, f"p{i % 2}") for i, t in enumerate(TITLES)], "item_id long, title string, provider string")
    if "_INDEX" not in globals():
        _INDEX = str(tmp_path_factory.mktemp("titles") / "index")
        title_index.build_title_index(df.filter("item_id < 6"), _INDEX)
        title_index.build_title_index(df.filter("item_id >= 6"), _INDEX, mode="append")
    # A scan takes an empty text as no condition on the title; the index then wants a title.
    want = search_items(df, needle or None, provider="p0").filter("title IS NOT NULL")
    got = title_index.search_titles(spark, _INDEX, needle, provider="p0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_a_search_reads_only_the_postings_of_its_trigrams(spark, tmp_path):
    df = spark.range(200).select(
        F.col("id").alias("item_id"), F.concat(F.lit("item number "), F.col("id")).alias("title"), F.lit("p").alias("provider")
    )
    title_index.build_title_index(df, str(tmp_path / "index"))
    found = title_index.search_titles(spark, str(tmp_path / "index"), "r 17")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters", 1)[1]
    assert "In(gram" in plan or "gram" in plan.split("PushedFilters", 1)[1]
    assert found.count() == 11


@pytest.mark.parametrize("block_rows", [7, 40, 1000])
def test_a_table_of_queries_is_answered_like_a_list(spark, block_rows):
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(c, 0.3, (40, 6)) for c in np.eye(6)[:3] * 3] + [np.tile(draw.normal(size=6), (25, 1))])
    rows = [(i, f"t{i % 9}", [float(v) for v in r]) for i, r in enumerate(x)] + [(900, "zero", [0.0] * 6), (901, "none", None)]
    df = spark.createDataFrame(rows, "item_id long, title string, embedding array<double>")
    asked = [(i, [float(v) for v in r]) for i, r in enumerate(np.concatenate([draw.normal(size=(30, 6)), x[-2:], np.zeros((1, 6))]))]
    queries = spark.createDataFrame([*asked, (99, None)], "query_id long, embedding array<double>")
    got = search_table(df, queries, 4, block_rows=block_rows)
    want = semantic_search(df, asked, 4)
    norm = lambda t: sorted((r.query_id, r["rank"], r.item_id, r.title, round(r.similarity, 9)) for r in t.collect())
    assert norm(got) == norm(want)
    assert search_table(df, queries.limit(0), 4).count() == 0
    if block_rows == 7:
        assert search_table(df.limit(0), queries, 4).count() == 0
