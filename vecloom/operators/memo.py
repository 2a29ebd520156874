"""Results kept from run to run under a digest of what they were made from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.operators.relational import content_digest
from vecloom.session import cut_lineage

# Default width of a store; a store keeps the number it was made with.
BUCKETS = 64


def open_memo(spark: SparkSession, path: str, results: T.StructType, buckets: int = BUCKETS) -> str:
    """The name of the table of results stored at ``path``; an empty one is made where there is none.

    Rows are a content digest and its result columns, in files bucketed by the digest, so looking up
    contents shuffles the contents looked up and never the store. Nothing but the folder has to
    outlive a session: bucketed files tell their bucket by their name. ``buckets`` and the
    columns must be those that the store was made with.
    """
    name = f"memo_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in results)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (content STRING, {columns}) USING parquet "
        f"CLUSTERED BY (content) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    spark.catalog.refreshTable(name)
    return name


def enrich_with_memo(
    df: DataFrame,
    columns: Sequence[str],
    enrich: Callable[[DataFrame], DataFrame],
    results: T.StructType,
    path: str,
    key: str = "item_id",
    failed: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Run ``enrich`` once per content of ``columns`` over all runs that share ``path``.

    ``enrich`` gets one row per content that no earlier run has stored, with its digest in ``content``,
    and answers with ``content`` and the columns ``results``. New results are appended and
    come back joined to all rows of ``df``; contents without an answer have nulls and are asked again in the
    next run, as are those with a value in the column ``failed``, which are returned but not
    stored. One run writes at a time. A run that is lost before its append is committed has stored nothing, a run that is
    lost after it has stored all.
    """
    spark = df.sparkSession
    table = open_memo(spark, path, results, buckets)
    names = [f.name for f in results]
    keyed = df.withColumn("content", content_digest(list(columns)))
    # One id per content is all that is grouped and compared; a content of very many copies is one small row by then.
    wanted = keyed.groupBy("content").agg(F.min(key).alias(key))
    missing = wanted.join(spark.table(table).select("content"), "content", "left_anti")
    asked = keyed.join(missing.select(key), key, "left_semi")
    # Written once before it is stored and used, so that the seam is not called for each of the two.
    fresh = cut_lineage(enrich(asked).select("content", *names), "answers")
    good = fresh if failed is None else fresh.filter(F.col(failed).isNull())
    good.repartition(buckets, "content").write.insertInto(table)
    spark.catalog.refreshTable(table)
    known = spark.table(table)
    if failed is not None:
        known = known.unionByName(fresh.filter(F.col(failed).isNotNull()))
    return keyed.join(known, "content", "left").drop("content")
