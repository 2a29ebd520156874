import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import ivf, lsh
from vecloom.operators.neighbours import similar_items


@pytest.fixture(scope="module")
def shapeless(spark):
    """Vectors without structure in clusters of different sizes, with copies, zeros, nulls and no cluster."""
    draw = np.random.default_rng(8)
    rows = []
    for c, n in ((0, 300), (1, 40), (2, 3), (3, 1), (None, 5)):
        shift = draw.normal(size=16) * 4
        rows += [(len(rows) + i, f"t{i % 7}", c, [float(x) for x in draw.normal(size=16) + shift]) for i in range(n)]
    rows += [(1000 + i, None if i % 5 == 0 else f"c{i}", 0, rows[0][3]) for i in range(150)]
    rows += [(2000, "zero", 0, [0.0] * 16), (2001, "none", 0, None)]
    return spark.createDataFrame(rows, "item_id long, title string, cluster int, embedding array<double>").repartition(5)


def rows_of(df):
    return sorted((r.item_id, r.rank, r.neighbour_id, round(r.similarity, 9)) for r in df.collect())


def test_probes_are_the_buckets_across_the_nearest_hyperplanes():
    projections = np.random.default_rng(1).normal(size=(50, 5))
    got = lsh.probed_buckets(projections, 7)
    for p, buckets in zip(projections, got, strict=True):
        own = sum(1 << b for b in range(5) if p[b] > 0)
        every = [(sum(p[b] ** 2 for b in flips), own ^ sum(1 << b for b in flips)) for n in range(6) for flips in itertools.combinations(range(5), n)]
        assert buckets.tolist() == [bucket for _, bucket in sorted(every)[:7]] and buckets[0] == own


def test_all_buckets_probed_is_exact(spark, shapeless):
    known = shapeless.filter("cluster IS NOT NULL")
    got = lsh.similar_items_lsh(shapeless, bits=4, tables=1, probes=16, block_rows=32)
    assert rows_of(got) == rows_of(similar_items(known))


def test_blocks_do_not_change_what_is_found(spark, shapeless):
    whole = rows_of(lsh.similar_items_lsh(shapeless, bits=5, tables=3, probes=2))
    assert rows_of(lsh.similar_items_lsh(shapeless, bits=5, tables=3, probes=2, block_rows=16)) == whole
    assert len(whole) < len(rows_of(similar_items(shapeless)))


def test_defaults_find_nine_of_ten(spark, shapeless):
    known = shapeless.filter("cluster IS NOT NULL")
    row = ivf.recall(lsh.similar_items_lsh(known), similar_items(known)).first()
    assert row.recall >= 0.9


def test_focal_items_only(spark, shapeless):
    focal = shapeless.filter(F.col("item_id") < 10).select("item_id")
    whole = rows_of(lsh.similar_items_lsh(shapeless))
    assert rows_of(lsh.similar_items_lsh(shapeless, focal=focal)) == [r for r in whole if r[0] < 10]


def test_empty_table(spark, shapeless):
    assert lsh.similar_items_lsh(shapeless.limit(0)).count() == 0
