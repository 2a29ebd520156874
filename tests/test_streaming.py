import pytest
from pyspark.sql import functions as F

from vecloom.plans.views import documents_as_items
from vecloom.schema import ITEM_SCHEMA
from vecloom.streaming.refresh import assign_new, refresh, refresh_from_disk


def test_stream_equals_batch_and_each_file_counts_once(spark, tmp_path):
    long = "a review that is long enough to pass the gate " * 3
    first = [(1, "a", "p", long), (2, "b", "p", "short"), (3, " ", "p", long), (4, "d", "p", long)]
    second = [(5, "e", "p", long), (6, "f", "p", long)]
    done = spark.createDataFrame([(4,)], "item_id long")
    centres = [(0, [0.0, 0.0]), (1, [10.0, 10.0])]

    def embed(df):
        at = (F.col("item_id") % 2 * 10).cast("float")
        return df.withColumn("embedding", F.when(F.col("item_id") != 6, F.array(at, at)))

    source, output = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        refresh(
            spark, source, ITEM_SCHEMA, lambda d: d, done, embed, centres, output, str(tmp_path / "cp")
        ).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(output).collect())

    spark.createDataFrame(first, ITEM_SCHEMA).write.parquet(source)
    assert run() == [(1, "a", 1)]
    assert run() == [(1, "a", 1)]
    spark.createDataFrame(second, ITEM_SCHEMA).write.mode("append").parquet(source)
    got = run()
    batch = assign_new(spark.createDataFrame(first + second, ITEM_SCHEMA), done, embed, centres)
    assert got == sorted(tuple(r) for r in batch.collect()) == [(1, "a", 1), (5, "e", 1)]


def test_documents_become_items(spark):
    docs = spark.createDataFrame([(1, "head\nbody", "en", "src", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert tuple(documents_as_items(docs).first()) == (1, "head", "src", "head\nbody")


LONG = "words of a review that is long enough to pass the gate number " * 3


def fitted(spark, texts, dimensions=16):
    from vecloom.operators.embedding import fit_vectoriser

    table = spark.createDataFrame([(t,) for t in texts], "review string")
    return fit_vectoriser(table, "review", dimensions)


def test_models_are_kept_in_versions(spark, tmp_path):
    from vecloom.streaming.model_store import load_model, save_model, versions

    path = str(tmp_path / "store")
    texts = [f"{LONG} {i} word{i % 3}" for i in range(9)]
    first, second = fitted(spark, texts), fitted(spark, texts[:4], 8)
    assert versions(spark, path) == []
    with pytest.raises(ValueError, match="no model version"):
        load_model(spark, path)
    assert save_model(spark, path, first, [(0, [0.0] * 16), (3, [0.5] * 16)]) == 1
    assert save_model(spark, path, second, [(0, [1.0] * 8)]) == 2
    with pytest.raises(ValueError, match="dimensions"):
        save_model(spark, path, second, [(0, [1.0] * 16)])
    one, latest = load_model(spark, path, 1), load_model(spark, path)
    assert (one.centres, one.version, latest.version) == ([(0, [0.0] * 16), (3, [0.5] * 16)], 1, 2)
    table = spark.createDataFrame([(t,) for t in texts], "review string")
    assert [r.embedding for r in one.embed(table).collect()] == [r.embedding for r in first.transform(table, "review").collect()]


def test_a_refresh_goes_on_from_disk_and_refuses_other_vectors(spark, tmp_path):
    texts = [f"{LONG} {i} word{i % 3}" for i in range(12)]
    model = fitted(spark, texts)
    centres = [(0, [0.0] * 16), (1, [0.3] * 16)]
    rows = [(i, f"t{i}", "p", text) for i, text in enumerate(texts)]
    done = spark.createDataFrame([(4,)], "item_id long")
    source, output, progress = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run(model=None):
        refresh_from_disk(spark, source, ITEM_SCHEMA, lambda d: d, done, output, progress, model).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(output).collect())

    spark.createDataFrame(rows[:7], ITEM_SCHEMA).write.parquet(source)
    with pytest.raises(ValueError, match="needs a model"):
        run()
    assert len(run((model, centres))) == 6
    spark.createDataFrame(rows[7:], ITEM_SCHEMA).write.mode("append").parquet(source)
    with pytest.raises(ValueError, match="other settings"):
        run((fitted(spark, texts[:3]), centres))
    batch = assign_new(spark.createDataFrame(rows, ITEM_SCHEMA), done, lambda d: model.transform(d, "review"), centres)
    assert run() == sorted(tuple(r) for r in batch.collect()) and batch.count() > 6


def test_keys_that_come_again_count_once(spark, tmp_path):
    def embed(df):
        return df.withColumn("embedding", F.array(F.lit(0.0).cast("float")))

    rows = [(i, f"t{i}", "p", LONG) for i in range(10)]
    source, output, progress = (str(tmp_path / n) for n in ("in", "out", "cp"))
    done = spark.createDataFrame([(0,)], "item_id long")

    def run():
        refresh(
            spark, source, ITEM_SCHEMA, lambda d: d, done, embed, [(0, [0.0])], output, progress, unique_within="1 day"
        ).awaitTermination()
        return sorted(r.item_id for r in spark.read.parquet(output).collect())

    spark.createDataFrame(rows[:6] + rows[:3], ITEM_SCHEMA).write.parquet(source)
    assert run() == [1, 2, 3, 4, 5]
    spark.createDataFrame(rows[2:] + rows[2:5], ITEM_SCHEMA).write.mode("append").parquet(source)
    assert run() == [1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_vectors_are_computed_once(spark):
    texts = [f"{LONG} {i}" for i in range(5)]
    model = fitted(spark, texts)
    table = spark.createDataFrame([(i, f"t{i}", "p", t) for i, t in enumerate(texts)], ITEM_SCHEMA)
    plan = assign_new(table, table.select("item_id").limit(0), lambda d: model.transform(d, "review"), [(0, [0.0] * 16)])
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
