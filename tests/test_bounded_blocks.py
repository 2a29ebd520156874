"""What a search sends and holds follows the table, not the number of its blocks."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import enrich, neighbours, title_index, vector_index
from vecloom.operators import tiles
from vecloom.plans.catalog import _with_header


def test_a_bucket_of_many_rows_has_few_blocks_and_lists_without_titles(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, 4))
    rows = [(i, 0, i, [float(v) for v in r]) for i, r in enumerate(x)]
    vectors = spark.createDataFrame(rows, "item_id long, grp int, place long, u array<double>")
    best = neighbours.best_in_buckets(vectors, vectors, ["grp"], 3, block_rows=4)
    assert "title" not in neighbours.BEST_SCHEMA
    assert best.groupBy("item_id").count().agg(F.max("count")).first()[0] <= neighbours.HOLD_BLOCKS
    got = {r.item_id: [f.place for f in r.found] for r in neighbours.merged_lists(best, 3).collect()}
    want = np.argsort(-np.round(x @ x.T, 9), axis=1, kind="stable")[:, :3]
    assert got == {i: list(w) for i, w in enumerate(want)}


@pytest.mark.parametrize("n", [1, 3, 40, 500])
def test_best_positions_take_ties_in_order_and_leave_out_own_ids(monkeypatch, n):
    monkeypatch.setattr(neighbours, "STRIP_VALUES", 1000)
    draw = np.random.default_rng(2)
    x = draw.integers(-2, 3, (300, 3)).astype(float)
    ids = np.arange(300) % 290
    offsets, column, score = neighbours._best_positions(x, x, n, (ids, ids))
    for i in range(300):
        own = [(-(x[i] @ x[j]), j) for j in range(300) if ids[j] != ids[i]]
        assert list(column[offsets[i] : offsets[i + 1]]) == [j for _, j in sorted(own)[:n]]
    assert len(score) == offsets[-1]


def test_blocks_grow_with_the_table():
    assert tiles.block_count(600_000, 4096, 64) == tiles.MAX_BLOCKS
    assert tiles.block_count(6_000_000, 4096, 64) * tiles.TILE_VALUES >= 6_000_000 * 64
    assert tiles.block_count(10, 4096, 64) == 1


def test_fitting_an_index_does_not_hold_all_distances():
    x = np.random.default_rng(3).normal(size=(6000, 8))
    tracemalloc.start()
    try:
        centres = vector_index._fit(x, 1500, 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert centres.shape == (1500, 8)
    assert peak < 90e6  # one matrix of all distances has 72 MB, and there were three


def test_trigrams_of_long_titles_are_cut_in_one_go(spark):
    odd = "Aé🎰ß b🎰🎰"
    long = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80_000))
    rows = spark.createDataFrame([(1, odd), (2, "ab"), (3, ""), (4, None), (5, long)], "id int, t string")
    start = time.perf_counter()
    got = {r.id: r.g for r in rows.select("id", title_index.grams(F.col("t")).alias("g")).collect()}
    assert time.perf_counter() - start < 30
    for i, text in ((1, odd.lower()), (5, long)):
        assert got[i] == list(dict.fromkeys(text[k : k + 3] for k in range(len(text) - 2)))
    assert got[2] == got[3] == got[4] == []


def test_texts_pass_python_as_arrow_batches(spark):
    lines = spark.createDataFrame([("x",), ("y",)], "value string").filter("value IS NOT NULL").coalesce(1)
    got = lines.mapInArrow(_with_header("a,b"), "value string")
    assert [r.value for r in got.collect()] == ["a,b", "x", "y"]
    rows = spark.createDataFrame([(1, "t", "r"), (2, None, None)], "item_id long, title string, review string")
    done = enrich.summarise_with(rows, lambda part: [None if r is None else r + " " for _, r in part], keep=["title"])
    assert "MapInArrow" in done._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, done.collect())) == [(1, "r", None, "t"), (2, None, None, None)]
