import pytest
from pyspark.sql import functions as F

from vecloom.functions import text as X
from vecloom.operators import enrich as J
from vecloom.operators import ordering as O
from vecloom.operators import quality as Q
from vecloom.operators import relational as R
from vecloom.schema import SUMMARISED_SCHEMA


@pytest.fixture()
def dup_titles(spark):
    rows = [
        (1, "T", "p", None, None),
        (2, "T", "p", "r1", "s1"),
        (3, "T", "p", "r2", None),
        (4, "T", "q", "r3", "s2"),
        (5, "U", "q", "r4", None),
        (6, None, "q", "r5", "s5"),
        (7, " \t", "q", "r6", ""),
    ]
    return spark.createDataFrame(rows, SUMMARISED_SCHEMA)


def test_text_boundaries(spark):
    df = spark.createDataFrame([("x" * n,) for n in (49, 50, 99, 100, 8000, 8001, 8192, 8193)], "t string")
    rows = df.select(
        F.length("t").alias("n"),
        F.length(X.truncate_plain(F.col("t"))).alias("plain"),
        X.truncate_marked(F.col("t")).alias("marked"),
        X.has_review(F.col("t")).alias("ok"),
        X.has_review(F.col("t"), 50).alias("ok50"),
    ).collect()
    for r in rows:
        assert r.plain == min(r.n, 8192)
        assert r.marked == ("x" * 8000 + "..." if r.n > 8000 else "x" * r.n)
        assert r.ok == (r.n >= 100) and r.ok50 == (r.n >= 50)


def test_strip_and_blank(spark):
    df = spark.createDataFrame([(" \t\n a b \r\n",), (" \n",), (None,)], "t string")
    got = df.select(X.strip(F.col("t")), X.is_blank(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("a b", False), ("", True), (None, True)]


def test_bigrams_follow_stop_word_removal(spark):
    df = spark.createDataFrame([("Wild and free wild_spins, x",), ("one",), ("",)], "t string")
    words = X.content_tokens(F.col("t"), X.english_stop_words())
    got = [list(r[0]) for r in df.select(X.bigrams(words)).collect()]
    assert got == [["wild free", "free wild_spins"], [], []]


def test_summary_filters(dup_titles):
    assert {r.item_id for r in R.with_summary(dup_titles).collect()} == {2, 4, 6}
    assert {r.item_id for r in R.with_summary(dup_titles, allow_empty=True).collect()} == {2, 4, 6, 7}
    assert {r.item_id for r in R.with_title(dup_titles).collect()} == {1, 2, 3, 4, 5}


def test_pending_skips_null_titles_and_done_titles(dup_titles):
    assert {r.item_id for r in J.pending_items(dup_titles).collect()} == {1, 3, 5}
    done = R.with_summary(dup_titles)
    assert {r.item_id for r in J.pending_items(dup_titles, done).collect()} == {5}


def test_attach_summary_last_row_wins(spark, dup_titles):
    left = spark.createDataFrame([(10, "T"), (11, "Z")], "item_id long, title string")
    got = {r.title: (r.summary, r.summary_provider) for r in R.attach_summary(left, dup_titles).collect()}
    assert got == {"T": ("s2", "q"), "Z": (None, None)}
    earlier = dup_titles.filter("item_id <= 3")  # the last row has no summary: NULL wins
    assert R.attach_summary(left.filter("title = 'T'"), earlier).first()["summary"] is None


def test_merge_takes_last_summary_and_first_review(spark, dup_titles):
    second = spark.createDataFrame(
        [(1, "V", "p", "rv", "sv"), (2, "T", "p", "zz", "s9")], SUMMARISED_SCHEMA
    )
    got = {r.title: (r.review, r.structured_summary) for r in R.merge_summaries(dup_titles, second).collect()}
    assert got["T"] == ("", "s9")  # the first row of the title has no review
    assert got["V"] == ("rv", "sv")
    assert "U" not in got
    ordered = [r.title for r in R.merge_summaries(dup_titles, second).orderBy("position").collect()]
    assert ordered == ["T", " \t", "V"]


def test_upsert_is_idempotent_and_ignores_nulls(spark, dup_titles):
    new = spark.createDataFrame([(1, "n1"), (2, None)], "item_id long, structured_summary string")
    once = R.upsert(dup_titles, new)
    twice = R.upsert(once, new)
    want = {1: "n1", 2: "s1", 3: None, 4: "s2", 5: None, 6: "s5", 7: ""}
    assert {r.item_id: r.structured_summary for r in once.collect()} == want
    assert {r.item_id: r.structured_summary for r in twice.collect()} == want


def test_enrich_distinct_runs_once_per_content(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "ax", ""), (4, None, "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "item_id long, title string, review string")
    got = R.enrich_distinct(
        df, ["title", "review"], lambda d: d.select("content", F.col("item_id").alias("computed_by"))
    )
    assert {r.item_id: r.computed_by for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_combine_vectors_refuses_other_settings(spark):
    a = spark.createDataFrame([(1, [1.0])], "item_id long, embedding array<float>")
    b = spark.createDataFrame([(1, [9.0]), (2, [2.0])], "item_id long, embedding array<float>")
    got = {r.item_id: r.embedding for r in R.combine_vectors(a, b).collect()}
    assert got == {1: [1.0], 2: [2.0]}
    with pytest.raises(ValueError):
        R.combine_vectors(a, b, ({"prefix": ""}, {"prefix": "x"}))


@pytest.mark.parametrize("rows_per_bucket", [1, 7, 50, 1000])
def test_row_numbers_are_dense_for_any_bucketing(spark, rows_per_bucket):
    ids = [i * i * 3 + (5_000_000 if i > 80 else 0) for i in range(100)]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "item_id long").repartition(7)
    got = O.with_row_number(df, rows_per_bucket=rows_per_bucket)
    assert {r.item_id: r.row_number for r in got.collect()} == {v: n for n, v in enumerate(ids)}


def test_take_window(spark):
    df = spark.range(30_000).select((F.col("id") * 2).alias("item_id"))
    assert [r[0] for r in O.take_window(df, 3, 2).collect()] == [6, 8]
    far = O.take_window(df, 20_000, 3)
    assert sorted(r[0] for r in far.collect()) == [40_000, 40_002, 40_004]


def test_cost_matches_the_published_total(spark):
    ledger = Q.cost_ledger(spark.range(3549).withColumnRenamed("id", "item_id"))
    last = ledger.orderBy(F.desc("batch")).first()
    assert (last.batch, last.n_rows, last.processed, last.total) == (35, 49, 3549, 3549)
    assert last.cumulative_cost == pytest.approx(0.3549)


def test_audit_reports_lost_keys(spark):
    a = spark.createDataFrame([(1, "s"), (2, None), (3, "s")], "item_id long, s string")
    b = spark.createDataFrame([(1, "s"), (4, "s")], "item_id long, s string")
    rows = Q.consistency_audit([("a", a, "s"), ("b", b, None)]).orderBy("position").collect()
    assert (rows[0].n_rows, rows[0].n_valid, rows[0].mismatch) == (3, 2, False)
    assert (rows[1].n_rows, rows[1].keys_lost, rows[1].keys_added, rows[1].mismatch) == (2, 2, 1, True)


def test_failed_rows_do_not_stop_others(spark):
    df = spark.createDataFrame([(i, f"t{i}", "r" * i) for i in range(6)], "item_id long, title string, review string")

    def model(reviews):
        return [
            RuntimeError("no") if len(review) == 3 else None if len(review) == 0 else f" {title} "
            for title, review in reviews
        ]

    results = J.summarise_with(df, model)
    stored, rejects = J.apply_results(df.withColumn("structured_summary", F.lit(None).cast("string")), results)
    assert {r.item_id: r.structured_summary for r in stored.collect()} == {
        0: None, 1: "t1", 2: "t2", 3: None, 4: "t4", 5: "t5",
    }
    assert [(r.item_id, r.error) for r in rejects.collect()] == [(3, "RuntimeError: no")]
    status = Q.enrich_status(J.result_status(results)).first()
    assert tuple(status) == (6, 4, 1, 1)


def test_a_failed_request_fails_its_own_rows(spark):
    df = spark.createDataFrame([(i, f"t{i}", "r") for i in range(6)], "item_id long, title string, review string").coalesce(1)

    def model(reviews):
        if ("t2", "r") in reviews:
            raise RuntimeError("down")
        return ["ok"] * (len(reviews) if ("t4", "r") not in reviews else 1)

    rows = J.summarise_with(df, model, request_rows=2).collect()
    assert {r.item_id: r.structured_summary for r in rows} == {0: "ok", 1: "ok", 2: None, 3: None, 4: None, 5: None}
    assert {r.error.split(":")[0] for r in rows if r.error} == {"RuntimeError", "ValueError"}


def test_aspect_summary_picks_by_aspect_then_leading(spark):
    review = (
        "An opening line that says little. The music and graphics shine here! "
        "Bonus spins and wilds abound. Overall I recommend it? Last words."
    )
    df = spark.createDataFrame([(1, "T", review), (2, "S", "short"), (3, "N", None)], "item_id long, title string, review string")
    got = {r.item_id: r.structured_summary for r in J.aspect_summary(df).collect()}
    assert got[1].split("\n") == [
        "An opening line that says little.",
        "Bonus spins and wilds abound.",
        "Overall I recommend it?",
        "The music and graphics shine here!",
    ]
    assert got[2] == "S" + X.NO_DESCRIPTION and got[3] == "N" + X.NO_DESCRIPTION


def test_search_is_case_insensitive(spark):
    df = spark.createDataFrame([(1, "Big WIN", "p"), (2, "Big win", "q"), (3, None, "p")], "item_id long, title string, provider string")
    assert [r.item_id for r in R.search_items(df, "win", provider="p").collect()] == [1]
