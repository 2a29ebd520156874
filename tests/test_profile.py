import pytest
from pyspark.sql import functions as F

from vecloom.operators import profile as P

SCHEMA = "item_id long, title string, cluster int, summary string, provider string"


@pytest.fixture()
def tiny(spark):
    rows = [
        (1, "a", 0, "wild wild reels", ""),
        (2, None, 0, "wild bonus reels", ""),
        (3, "c", 0, "bonus wild reels", "acme"),
        (4, "d", 1, "alone here", "acme"),
        (5, "e", 2, "pair one", "x"),
        (6, "f", 2, "pair two", "y"),
        (7, None, 3, " ", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_first_and_last_skip_null_titles(tiny):
    got = {r.cluster: (r["count"], r["first"], r["last"]) for r in P.cluster_summary(tiny).collect()}
    assert got == {0: (2, "a", "c"), 1: (1, "d", "d"), 2: (2, "e", "f"), 3: (0, None, None)}


def test_shares_add_up(tiny):
    rows = P.cluster_distribution(tiny).collect()
    assert sum(r["count"] for r in rows) == 7
    assert all(r.clusters == 4 for r in rows)
    assert {r.cluster: r.percentage for r in rows}[0] == 42.86


def test_blank_provider_uses_up_its_rank(tiny):
    rows = P.top_providers(tiny, n=1).collect()
    assert {(r.cluster, r.provider) for r in rows} == {(1, "acme"), (2, "x")}
    two = [r for r in P.top_providers(tiny, n=2).collect() if r.cluster == 0]
    assert [(r.rank, r.provider, r["count"], r.percentage) for r in two] == [(2, "acme", 1, 33.3)]


def test_themes_need_two_documents_and_not_nearly_all(tiny):
    got = {}
    for r in P.key_themes(tiny).collect():
        got.setdefault(r.cluster, []).append((r.rank, r.term, r.tf, r.df))
    # "wild" and "reels" are in every document of cluster 0; "bonus" is in two of three.
    assert got == {0: [(1, "bonus", 2, 2), (2, "wild reels", 2, 2)]}


def test_top_words_ties_and_empty_cluster(tiny):
    got = {}
    for r in P.top_words(tiny).orderBy("cluster", "rank").collect():
        got.setdefault(r.cluster, []).append((r.term, r.tf))
    assert got[0] == [("wild", 4), ("reels", 3), ("bonus", 2)]
    assert got[2] == [("pair", 2), ("one", 1), ("two", 1)]
    assert got[3] == [("N/A", 0)]


def test_weights_are_relative_to_the_top_word(tiny):
    rows = {(r.cluster, r.term): r.weight for r in P.term_weights(tiny).collect()}
    assert rows[(0, "wild")] == 1.0 and rows[(0, "reels")] == 0.75


def test_samples_and_info(tiny):
    info = {r.cluster: r for r in P.cluster_info(tiny, n=2).collect()}
    assert info[0].sample_games == ["a", None] and info[0]["count"] == 3
    assert info[1].color == "#36A2EB"


def test_random_sample_ignores_partitioning(tiny):
    one = {(r.cluster, r.item_id) for r in P.random_samples(tiny.repartition(1), 2).collect()}
    many = {(r.cluster, r.item_id) for r in P.random_samples(tiny.repartition(5), 2).collect()}
    assert one == many and len([x for x in one if x[0] == 0]) == 2


def test_profile_has_every_cluster_sorted_by_size(tiny):
    rows = P.cluster_profile(tiny).collect()
    assert [(r.cluster, r["count"]) for r in rows] == [(0, 3), (2, 2), (1, 1), (3, 1)]
    assert rows[0].themes == "bonus, wild reels" and rows[2].themes == ""
    assert rows[1].providers == "x: 1 (50.0%), y: 1 (50.0%)"


def test_group_limit_reaches_the_map_side(tiny):
    plan = P.cluster_samples(tiny)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_word_counts_do_not_depend_on_row_order(tiny):
    shuffled = tiny.orderBy(F.desc("item_id")).repartition(3)
    assert sorted(P.top_words(tiny).collect()) == sorted(P.top_words(shuffled).collect())


def test_tasks_that_count_terms_follow_the_text(spark, monkeypatch):
    rows = [(i, i % 2, f"red fox kind{i % 5} jumps over dog sort{i % 3} twice") for i in range(60)] + [(60, 1, None), (61, 0, " ")]
    df = spark.createDataFrame(rows, "item_id long, cluster int, summary string")
    order = ("cluster", "rank")
    want = P.key_themes(df).orderBy(*order).collect()
    assert want
    seen = []
    plain = P.term_statistics

    def watched(part, *args):
        seen.append((part.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        return plain(part, *args)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(P, "term_statistics", watched)
    monkeypatch.setattr(P, "TASK_BYTES", 50)
    assert P.key_themes(df).orderBy(*order).collect() == want
    tasks = -(-sum(len(r[2]) for r in rows[:60]) // 50)
    assert seen == [(tasks, max(tasks, int(before)))] and tasks > spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert P.key_themes(df.drop("item_id")).orderBy(*order).collect() == want
