"""Approximate nearest neighbours by an inverted file of k-means cells.

Items belong to the cell of their nearest centre; an item is compared with the items of the
``probes`` cells nearest to it. With all cells probed the answer is exact. Cells are cut into
blocks on both sides, so a task holds two blocks whatever a cell's size, and
returns one list per item and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.vector import as_double, unit
from vecloom.operators.clustering import fit_kmeans
from vecloom.operators.neighbours import SIMILARITY_DECIMALS, best_in_buckets, in_tie_order, merged_lists, with_titles
from vecloom.session import cut_lineage

CELLS = 64
PROBES = 8
BLOCK_ROWS = 4096

def _probe(centres: np.ndarray, probes: int):
    """(item_id, place, u, cells): the nearest cells of an item, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = np.asarray(batch.column(2).flatten(), np.float64).reshape(batch.num_rows, -1)
            gap = (centres**2).sum(axis=1)[None, :] - 2.0 * (u @ centres.T) if batch.num_rows else np.zeros((0, 0))
            cells = np.argsort(gap, axis=1, kind="stable")[:, :probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(cells) + 1, dtype=np.int32) * min(probes, len(centres))), pa.array(cells.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], lists], ["item_id", "place", "u", "cells"]
            )

    return run


def ivf_neighbours(
    df: DataFrame,
    n: int = 5,
    cells: int = CELLS,
    probes: int = PROBES,
    column: str = "embedding",
    centres: np.ndarray | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(item_id, rank, neighbour_id, neighbour_title, similarity) among the probed cells.

    ``centres`` are cells fitted before; without them k-means fits ``cells`` centres to the unit
    vectors. Items without a vector, or with a zero one, neither ask nor are found.
    """
    units = df.select("item_id", "title", unit(as_double(F.col(column))).alias("u")).filter(F.col("u").isNotNull())
    units = in_tie_order(units, "units")
    if centres is None:
        centres = fit_kmeans(units, cells, starts=1, column="u").centres
    placed = cut_lineage(
        units.select("item_id", "place", "u").mapInArrow(
            _probe(centres, min(probes, len(centres))), "item_id long, place long, u array<double>, cells array<int>"
        ),
        "placed",
    )
    holds = placed.select(F.get("cells", F.lit(0)).alias("cell"), "item_id", "place", "u")
    asks = placed.select(F.explode("cells").alias("cell"), "item_id", "u")
    found = merged_lists(best_in_buckets(holds, asks, ["cell"], n, block_rows, others=True), n)
    return with_titles(found, units).withColumn("similarity", F.round("similarity", SIMILARITY_DECIMALS))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: neighbours of the exact answer, how many of them were found, and the share."""
    keys = ["item_id", "neighbour_id"]
    hit = found.select(*keys, F.lit(1).alias("hit"))
    return (
        exact.select(keys)
        .join(hit, keys, "left")
        .agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
        .withColumn("recall", F.col("found") / F.nullif(F.col("wanted"), F.lit(0).cast("long")))
    )
