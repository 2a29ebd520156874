"""All-against-all vector work in bounded blocks.

Items are hashed into blocks of a bounded number of rows. Two blocks meet in one task,
which does a matrix product and returns per-item results only: pairs of items never
become rows. A hot cluster is just many blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.vector import as_double


#: Blocks that a table is cut into: a table that grows gets larger blocks, so that what is sent grows with the
#: table, until a block has TILE_VALUES numbers.
MAX_BLOCKS = 16
TILE_VALUES = 4_000_000
#: Distances that a task holds at a time.
STRIP_VALUES = 2_000_000


def block_count(rows: int, block_rows: int, width: int = 1) -> int:
    """Blocks of ``block_rows`` vectors of ``width`` numbers, or MAX_BLOCKS larger ones of at most TILE_VALUES numbers."""
    return max(1, min(-(-rows // block_rows), MAX_BLOCKS), -(-rows * width // TILE_VALUES))


def hash_block(key: Column, blocks: int | Column) -> Column:
    """Block of a row: depends on the key alone, so a recomputed task agrees."""
    blocks = F.lit(blocks) if isinstance(blocks, int) else blocks
    return F.pmod(F.xxhash64(key), blocks.cast("long")).cast("int")


def block_pairs(df: DataFrame, blocks: int, block: str = "block") -> DataFrame:
    """Send each row to every unordered block pair its block takes part in."""
    b = F.col(block)
    partners = F.sequence(F.lit(0), F.lit(blocks - 1))
    return (
        df.withColumn("partner", F.explode(partners))
        .withColumn("tile", F.least(b, "partner").cast("long") * blocks + F.greatest(b, "partner"))
        .drop("partner")
    )


def matrix_of(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    if len(values) == 0:
        return np.zeros((0, 0))
    return np.asarray(values.flatten(), dtype=np.float64).reshape(len(values), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] - 2.0 * (x @ y.T) + (y**2).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0.0))


def distance_sums(
    df: DataFrame, labels: Sequence[str], column: str = "embedding", block_rows: int = 4096
) -> DataFrame:
    """Distance sum from every item to every cluster of every labelling.

    Rows: item_id, labelling, own (the item's cluster), other, n (size of ``other``),
    total. Each unordered block pair is computed once and serves both sides. A task
    returns one row per item holding one number per cluster of all labellings, and the
    partial rows of an item are added up by one aggregate over blocks.
    """
    rows = df.filter(F.col(column).isNotNull()).select(
        "item_id", as_double(F.col(column)).alias("v"), *[F.col(c).cast("int").alias(c) for c in labels]
    )
    # One row per cluster of each labelling: the slots of the per-item sums.
    counted = (
        rows.select(
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("labelling"), F.col(c).alias("other")) for c in labels])
            ).alias("s"),
            F.size("v").alias("dimensions"),
        )
        .select("s.*", "dimensions")
        .groupBy("labelling", "other")
        .agg(F.count(F.lit(1)).alias("n"), F.max("dimensions").alias("dimensions"))
        .collect()
    )
    sizes = sorted((r["labelling"], r["other"], r["n"]) for r in counted)
    # Slots of one labelling are neighbours, in the order of its cluster numbers.
    known = {c: np.array([o for name, o, _ in sizes if name == c]) for c in labels}
    first_slot = {c: [name for name, _, _ in sizes].index(c) for c in labels if len(known[c])}
    total = sum(n for name, _, n in sizes if name == labels[0])
    blocks = block_count(total, block_rows, max((r["dimensions"] for r in counted), default=1))
    tiles = block_pairs(rows.withColumn("block", hash_block(F.col("item_id"), blocks)), blocks)
    width = len(sizes)
    names = list(labels)

    def membership(table: pa.Table) -> np.ndarray:
        one_hot = np.zeros((table.num_rows, width))
        row = np.arange(table.num_rows)
        for name in names:
            at = np.searchsorted(known[name], np.asarray(table.column(name)))
            one_hot[row, first_slot[name] + at] = 1.0
        return one_hot

    def sums(table: pa.Table) -> pa.Table:
        block = np.asarray(table.column("block"))
        first, last = block.min(), block.max()
        left, right = table.filter(pa.array(block == first)), table.filter(pa.array(block == last))
        x, y, mine, theirs = matrix_of(left, "v"), matrix_of(right, "v"), membership(left), membership(right)
        to_left, to_right = np.zeros((len(x), width)), np.zeros((len(y), width))
        strip = max(1, STRIP_VALUES // max(len(y), 1))
        for start in range(0, len(x), strip):
            d = _distances(x[start : start + strip], y)
            if first == last:
                row = np.arange(len(d))
                d[row, start + row] = 0.0
            else:
                to_right += d.T @ mine[start : start + strip]
            to_left[start : start + strip] = d @ theirs
        ids, out = [np.asarray(left.column("item_id"))], [to_left]
        if first != last:
            ids.append(np.asarray(right.column("item_id")))
            out.append(to_right)
        values = np.concatenate(out)
        offsets = np.arange(0, values.size + 1, width, dtype=np.int32)
        return pa.table(
            {
                "item_id": pa.array(np.concatenate(ids)),
                "sums": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel())),
            }
        )

    partial = tiles.groupBy("tile").applyInArrow(sums, "item_id long, sums array<double>")
    slots = F.array(
        *[
            F.struct(
                F.lit(i).alias("slot"),
                F.lit(name).alias("labelling"),
                F.lit(int(other)).alias("other"),
                F.lit(int(n)).cast("long").alias("n"),
            )
            for i, (name, other, n) in enumerate(sizes)
        ]
    )
    if blocks > 1:
        # One row per item and partner block: whole vectors are added up, nothing is exploded before.
        partial = partial.groupBy("item_id").agg(
            vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")
        )
    summed = partial.select("item_id", F.posexplode("sums").alias("slot", "total"))
    named = summed.withColumn("s", F.get(slots, F.col("slot"))).select(
        "item_id", "s.labelling", "s.other", "s.n", "total"
    )
    owners = rows.select(
        "item_id",
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("labelling"), F.col(c).alias("own")) for c in labels])
        ),
    )
    return named.join(owners, ["item_id", "labelling"])
