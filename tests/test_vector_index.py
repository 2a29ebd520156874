import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import vector_index as V
from vecloom.operators.ivf import recall
from vecloom.operators.neighbours import recommend_items


@pytest.fixture(scope="module")
def table(spark):
    """Thirty groups of vectors, copies of one, a zero and a null vector."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(30, 24)) * 3
    rows = [(i, f"t{i % 11}", [float(x) for x in centres[i % 30] + draw.normal(size=24)]) for i in range(1500)]
    rows += [(3000 + i, f"c{i}", rows[0][2]) for i in range(40)]
    rows += [(4000, "zero", [0.0] * 24), (4001, "none", None)]
    return spark.createDataFrame(rows, "item_id long, title string, embedding array<double>").repartition(5)


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/all"
    V.build_index(table, path, cells=32)
    return path


def as_queries(table):
    return table.select(F.col("item_id").alias("query_id"), "embedding")


def as_neighbours(found):
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("item_id").alias("neighbour_id"), F.round("similarity", 9).alias("s"))


def test_a_quarter_of_the_cells_finds_nine_of_ten(spark, table, index):
    probed = V.probed_cells(as_queries(table), index)
    assert {r.n for r in probed.select(F.size("cells").alias("n")).collect()} == {8}
    found = as_neighbours(V.search_index(as_queries(table), index, others=True))
    assert recall(found, recommend_items(table)).first().recall >= 0.9


def test_all_cells_and_vectors_are_exact(spark, table, index):
    queries = as_queries(table).filter("query_id < 60")
    found = as_neighbours(V.search_index(queries, index, n=5, probes=32, refine=400, others=True))
    exact = recommend_items(table, focal=table.filter("item_id < 60").select("item_id")).select("item_id", "rank", "neighbour_id", F.round("similarity", 9).alias("s"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))


def test_blocks_do_not_change_the_answer(spark, table, index):
    queries = as_queries(table).filter("query_id % 7 = 0 OR query_id >= 3000")
    whole = sorted(map(tuple, V.search_index(queries, index, refine=400).collect()))
    assert sorted(map(tuple, V.search_index(queries, index, refine=400, block_rows=9).collect())) == whole


def test_items_are_added_by_the_stored_model_once(spark, table, index, tmp_path):
    path = f"file://{tmp_path}/part"
    early = table.filter("item_id % 3 != 0")
    model = V.build_index(early, path, cells=32)
    V.add_items(table, path)
    V.add_items(table, path)
    stored = V.stored_items(spark, path)
    assert sorted(r.item_id for r in stored.select("item_id").collect()) == sorted([*range(1500), *range(3000, 3040)])
    again = V.read_model(spark, path)
    assert np.array_equal(again.centres, model.centres) and all(map(np.array_equal, again.codebooks, model.codebooks))
    found = as_neighbours(V.search_index(as_queries(table), path, others=True))
    assert recall(found, recommend_items(table)).first().recall >= 0.9


def test_few_queries_read_only_their_cells(spark, table, index):
    one = as_queries(table).filter("query_id = 7")
    plan = V.stored_items(spark, index).filter(F.col("cell").isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"cell#\d+ = 3\)\], PushedFilters: \[\]", plan)
    assert V.search_index(one, index, n=3).count() == 3


def test_codes_are_one_byte_a_part_and_near_the_vectors(spark, index):
    rows = V.stored_items(spark, index).toPandas()
    model = V.read_model(spark, index)
    assert {len(c) for c in rows.code} == {V.PARTS}
    x = np.stack(rows.u.to_numpy())
    codes = np.array([np.frombuffer(c, np.uint8) for c in rows.code])
    told = np.array([model.similarities(x[i : i + 1], rows.cell[i], codes[i : i + 1])[0, 0] for i in range(200)])
    assert np.abs(told - 1).mean() < 0.1


def test_queries_without_a_direction_and_empty_tables(spark, table, index, tmp_path):
    odd = spark.createDataFrame([(1, [0.0] * 24), (2, None)], "query_id long, embedding array<double>")
    assert V.search_index(odd, index).count() == 0
    with pytest.raises(ValueError, match="no vectors"):
        V.build_index(table.limit(0), f"file://{tmp_path}/x")


def test_few_vectors_make_few_cells(spark, table, tmp_path):
    path = f"file://{tmp_path}/few"
    few = table.filter("item_id < 5")
    assert len(V.build_index(few, path).centres) == 5
    assert V.search_index(as_queries(few), path, probes=5).count() == 25


def test_a_query_keeps_its_best_over_all_cells_of_a_block(monkeypatch):
    """Every cell's best went to the exchange, so that lists grew with the number of cells that a query probes."""
    import pyarrow as pa

    monkeypatch.setattr(V, "PENDING", 300)
    monkeypatch.setattr(V, "STRIP_VALUES", 200)
    monkeypatch.setattr(V, "BLOCK_ROWS", 7)
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 8))
    model = V.IndexModel(x[:12], tuple(draw.normal(0, 0.3, (256, 4)) for _ in range(2)))
    cells = model.nearest_cells(x, 1)[:, 0]
    codes = model.codes(x, cells)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(61, dtype=np.int32) * 8), pa.array(x[:60].ravel()))
    queries = pa.table({"strip": pa.array([i % 2 for i in range(60)], pa.int32()), "query_id": pa.array(range(60)), "u": vectors})
    held = pa.table({"cell": cells, "item_id": pa.array(range(400)), "code": pa.array([c.tobytes() for c in codes], pa.binary())})
    rows = V._best_by_code(model, 5, 9)(queries, held)
    assert sorted(rows.column("strip").to_pylist()) == [0, 1]
    asked, found, score = (
        np.frombuffer(b"".join(rows.column(c).to_pylist()), k) for c, k in (("query_id", np.int64), ("item_id", np.int64), ("score", np.float32))
    )
    near = model.nearest_cells(x[:60], 5)
    for q in range(60):
        told = {i: float(x[q] @ model.decoded(cells[i], codes[i : i + 1])[0]) for i in range(400) if cells[i] in near[q]}
        best = sorted(told, key=told.get)[-9:]
        assert sorted(found[asked == q]) == sorted(best)
        assert sorted(score[asked == q]) == pytest.approx(sorted(told[i] for i in best), rel=1e-5)


def test_small_blocks_of_items_queries_and_vectors(spark, table, index, monkeypatch):
    """Repeated ids too: every row of a query meets every row of an item."""
    queries = as_queries(table).filter("query_id % 5 = 0 OR query_id >= 3000")
    queries = queries.unionByName(queries.filter("query_id = 10"))
    whole = sorted(map(tuple, V.search_index(queries, index, refine=400).collect()))
    for name, value in (("HOLD_ROWS", 60), ("BLOCK_VALUES", 24 * 150), ("STRIP_QUERIES", 40), ("ASK_BLOCKS", 3)):
        monkeypatch.setattr(V, name, value)
    assert sorted(map(tuple, V.search_index(queries, index, refine=400, block_rows=30).collect())) == whole
    assert [r[1] for r in whole if r[0] == 10] == [1, 2, 3, 4, 5]
    ids = [r[2] for r in whole if r[0] == 10]
    assert ids[0] == ids[1] == 10
