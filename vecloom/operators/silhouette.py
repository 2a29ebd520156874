"""The exact Euclidean silhouette, comparing an item only with clusters that can decide it.

The mean distance from an item to a cluster lies between the distance to the cluster's mean and the root of
the mean squared distance; both follow from the cluster's size, mean and spread. Only the own
cluster, and clusters whose lower bound does not exceed the best upper bound, are compared item by item. Clusters
of any size are cut into blocks on both sides; a task adds up distances and returns one number per
item, so pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.vector import as_double
from vecloom.operators.clustering import _check_centres, _label_moments, _squared_by_product
from vecloom.operators.tiles import STRIP_VALUES, TILE_VALUES, matrix_of
from vecloom.session import cut_lineage

BLOCK_ROWS = 4096
#: Into how many blocks a cluster, and the items that ask it, are cut; only blocks of TILE_VALUES numbers are cut further.
HOLD_BLOCKS = 2
ASK_BLOCKS = 16
#: By which share a lower bound may exceed an upper one through rounding alone.
SLACK = 1e-9

_WANTED = "item_id long, labelling string, cluster int, v array<double>, needed array<int>"


def _needed(model: dict[str, tuple[np.ndarray, ...]], names: Sequence[str]):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            x = matrix_of(table, "v")
            for name in names:
                clusters, mean, spread = model[name]
                own = np.searchsorted(clusters, np.asarray(table.column(name)))
                square = np.maximum(_squared_by_product(x, mean), 0.0)
                low, high = np.sqrt(square), np.sqrt(square + spread)
                rows = np.arange(len(x))
                other = high.copy()
                other[rows, own] = np.inf
                take = low <= other.min(axis=1)[:, None] * (1 + SLACK) + SLACK
                take[rows, own] = True
                sizes = take.sum(axis=1)
                needed = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(clusters[np.nonzero(take)[1]].astype(np.int32))
                )
                yield from pa.table(
                    {
                        "item_id": table.column("item_id"),
                        "labelling": pa.array([name] * len(x), pa.string()),
                        "cluster": table.column(name),
                        "v": table.column("v"),
                        "needed": needed,
                    }
                ).to_batches()

    return choose


def _distance_sums(asks: pa.Table, holds: pa.Table) -> pa.Table:
    x, y = matrix_of(asks, "v"), matrix_of(holds, "v")
    total = np.zeros(len(x))
    if len(x) and len(y):
        strip = max(1, STRIP_VALUES // len(y))
        for start in range(0, len(x), strip):
            part = x[start : start + strip]
            square = _squared_by_product(part, y)
            # By product a small distance is mostly rounding: those are taken by difference.
            scale = (part**2).sum(1)[:, None] + (y**2).sum(1)[None, :]
            row, column = np.nonzero(square <= 1e-6 * scale)
            square[row, column] = ((part[row] - y[column]) ** 2).sum(axis=1)
            total[start : start + strip] = np.sqrt(np.maximum(square, 0.0)).sum(axis=1)
    return pa.table(
        {
            "item_id": asks.column("item_id"),
            "labelling": asks.column("labelling"),
            "cluster": asks.column("cluster"),
            "target": asks.column("target"),
            "total": pa.array(total),
        }
    )


def needed_clusters(df: DataFrame, labels: Sequence[str] = ("cluster",), column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(item_id, labelling, cluster, v, needed): the clusters each item must be compared with; and (labelling, target, n), their sizes."""
    rows = df.filter(F.col(column).isNotNull()).select(
        "item_id", as_double(F.col(column)).alias("v"), *[F.col(c).cast("int").alias(c) for c in labels]
    )
    moments = _label_moments(rows, labels)
    _check_centres([(r["cluster"], r["mean"]) for r in moments])
    model = {}
    for name in labels:
        own = sorted((r for r in moments if r["labelling"] == name), key=lambda r: r["cluster"])
        n = np.array([r["count"] for r in own], dtype=np.float64)
        spread = np.array([r["variance"].toArray().sum() for r in own]) * (n - 1) / np.maximum(n, 1)
        model[name] = (np.array([r["cluster"] for r in own]), np.array([r["mean"].toArray() for r in own]), spread)
    sizes = df.sparkSession.createDataFrame(
        [(r["labelling"], r["cluster"], r["count"]) for r in moments], "labelling string, target int, n long"
    )
    return rows.mapInArrow(_needed(model, list(labels)), _WANTED), sizes


def comparisons(df: DataFrame, labels: Sequence[str] = ("cluster",), column: str = "embedding") -> DataFrame:
    """(labelling, items, compared, pairs): distances that ``silhouette_bounded`` computes, and those of all pairs."""
    wanted, sizes = needed_clusters(df, labels, column)
    all_items = F.col("items") * F.col("items")
    return (
        wanted.select("item_id", "labelling", F.explode("needed").alias("target"))
        .groupBy("labelling", "target")
        .agg(F.count(F.lit(1)).alias("asking"))
        .join(sizes, ["labelling", "target"])
        .groupBy("labelling")
        .agg(F.sum("n").alias("items"), F.sum(F.col("asking") * F.col("n")).alias("compared"))
        .withColumn("pairs", all_items)
    )


def silhouette_bounded(
    df: DataFrame, labels: Sequence[str] = ("cluster",), column: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(item_id, labelling, cluster, silhouette): the rows of ``silhouette_exact`` from fewer distances.

    Labels are not null. Items without a vector take no part. A cluster of one item, and a labelling of one
    cluster, have 0.
    """
    wanted, sizes = needed_clusters(df, labels, column)
    wanted = cut_lineage(wanted, "needed")
    keys = ["labelling", "target"]
    holds = wanted.select("labelling", F.col("cluster").alias("target"), "item_id", "v")
    asks = wanted.select("item_id", "labelling", "cluster", "v", F.explode("needed").alias("target"))
    width = wanted.select(F.max(F.size("v"))).first()[0] or 1

    def blocks(rows, most: int):
        # A cluster that grows gets larger blocks, so that what is sent grows with the table.
        wide = F.ceil(rows * width / TILE_VALUES)
        return F.greatest(F.least(F.ceil(rows / block_rows), F.lit(most)), wide, F.lit(1)).cast("int")

    load = (
        asks.groupBy(*keys)
        .agg(blocks(F.count(F.lit(1)), ASK_BLOCKS).alias("ask_blocks"))
        .join(sizes.select(*keys, blocks(F.col("n"), HOLD_BLOCKS).alias("hold_blocks")), keys)
    )

    def own(number: str, salt: int):
        return F.pmod(F.xxhash64("item_id", F.lit(salt)), F.col(number).cast("long")).cast("int")

    def every(number: str):
        return F.explode(F.sequence(F.lit(0), F.col(number) - 1))

    at = [*keys, "hold_block", "ask_block"]
    held = (
        holds.join(load, keys)
        .withColumn("hold_block", own("hold_blocks", 1))
        .withColumn("ask_block", every("ask_blocks"))
        .select(*at, "v")
    )
    held = held.toDF(*held.columns)
    asked = (
        asks.join(load, keys)
        .withColumn("ask_block", own("ask_blocks", 2))
        .withColumn("hold_block", every("hold_blocks"))
        .select(*at, "item_id", "cluster", "v")
    )
    sums = (
        asked.groupBy(*at)
        .cogroup(held.groupBy(*at))
        .applyInArrow(_distance_sums, "item_id long, labelling string, cluster int, target int, total double")
        .groupBy("item_id", "labelling", "cluster", "target")
        .agg(F.sum("total").alias("total"))
        .join(sizes, keys)
    )
    mine, size = F.col("cluster") == F.col("target"), F.col("n").cast("double")
    ab = sums.groupBy("item_id", "labelling", "cluster").agg(
        F.max(F.when(mine, F.col("n"))).alias("own_n"),
        F.max(F.when(mine, F.col("total") / F.nullif(size - 1, F.lit(0.0)))).alias("a"),
        F.min(F.when(~mine, F.col("total") / size)).alias("b"),
    )
    top = F.greatest("a", "b")
    score = F.when((F.col("own_n") > 1) & (top > 0) & F.col("b").isNotNull(), (F.col("b") - F.col("a")) / top)
    return ab.select("item_id", "labelling", "cluster", F.coalesce(score, F.lit(0.0)).alias("silhouette"))
