"""Approximate neighbours inside clusters by random hyperplanes.

A table of signatures has ``bits`` hyperplanes; the signs of a vector's projections are its bucket in that
table. Vectors are compared with those of the buckets that they probe: their own, and those across
the hyperplanes that they lie closest to. Vectors are taken from their cluster's mean, or all of a
cluster would lie on one side.

Hyperplanes have entries 1 and -1 that a digest of (seed, table, bit, dimension) gives, so they need no
storage and are the same everywhere. Buckets are cut into blocks of bounded size on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.vector import as_double
from vecloom.operators import neighbours as N
from vecloom.operators.clustering import _summary
from vecloom.operators.tiles import matrix_of
from vecloom.session import cut_lineage

SEED = 42
TABLES = 8
PROBES = 4
LEAST_BITS, MOST_BITS = 4, 24
#: Vectors that a bucket of the largest cluster holds on average, if ``bits`` is not given.
BUCKET_ROWS = 1024
#: The hyperplanes closest to a vector that its probes may cross.
CROSSED = 6


def hyperplanes(tables: int, bits: int, dimensions: int, seed: int = SEED) -> np.ndarray:
    """[table, bit, dimension]: 1 where the digest's first hex digit is below 8, else -1."""

    def sign(table: int, bit: int, dim: int) -> int:
        return 1 if md5(f"{seed}:{table}:{bit}:{dim}".encode()).digest()[0] < 128 else -1

    return np.array(
        [[[sign(t, b, d) for d in range(dimensions)] for b in range(bits)] for t in range(tables)], np.float64
    )


def probed_buckets(projections: np.ndarray, probes: int) -> np.ndarray:
    """The buckets a vector probes, by the sum of its squared distances from the hyperplanes crossed; its own first."""
    bits = projections.shape[1]
    own = (projections > 0) @ (1 << np.arange(bits))
    crossed = min(bits, CROSSED)
    near = np.argsort(np.abs(projections), axis=1, kind="stable")[:, :crossed]
    cost = np.take_along_axis(projections, near, 1) ** 2
    subsets = (np.arange(1 << crossed)[:, None] >> np.arange(crossed)) & 1
    best = np.argsort(cost @ subsets.T, axis=1, kind="stable")[:, :probes]
    flips = np.einsum("ipc,ic->ip", subsets[best], 1 << near)
    return own[:, None] ^ flips


def _with_buckets(tables: int, bits: int, probes: int, seed: int, names: list[str]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            x = matrix_of(table, "centred")
            if planes is None:
                planes = hyperplanes(tables, bits, x.shape[1], seed)
            found = np.concatenate([probed_buckets(x @ p.T, probes) for p in planes], axis=1).astype(np.int32)
            width = found.shape[1]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, found.size + 1, width, dtype=np.int32)), pa.array(found.ravel())
            )
            yield from table.select(names).append_column("buckets", lists).to_batches()

    return place


def hyperplane_search(
    tables: int = TABLES,
    probes: int = PROBES,
    bits: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
    block_rows: int = N.BLOCK_ROWS,
    seed: int = SEED,
):
    """A search for ``neighbour_lists``: candidates of the probed buckets instead of the whole group."""

    def search(pool: DataFrame, n: int) -> DataFrame:
        pool = pool.filter(F.col("grp").isNotNull())
        means = _summary(pool, "grp", F.col("u"), "mean")
        largest = means.agg(F.max("count")).first()[0] or 1
        wide = bits or min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(largest / bucket_rows)))))
        names = ["item_id", "grp", "place", "u", "wanted"]
        kind = pool.schema["grp"].dataType.simpleString()
        centred = F.zip_with("u", "mean", lambda x, m: x - m)
        placed = cut_lineage(
            pool.join(means.select("grp", "mean"), "grp")
            .select(*names, centred.alias("centred"))
            .mapInArrow(
                _with_buckets(tables, wide, probes, seed, names),
                f"item_id long, grp {kind}, place long, u array<double>, wanted boolean, buckets array<int>",
            ),
            "signatures",
        )
        each = placed.select("*", F.posexplode("buckets").alias("at", "bucket")).withColumn(
            "hash_table", F.floor(F.col("at") / min(probes, 1 << min(wide, CROSSED))).cast("int")
        )
        own = F.col("at") % min(probes, 1 << min(wide, CROSSED)) == 0
        found = N.best_in_buckets(
            each.filter(own).select("grp", "hash_table", "bucket", "item_id", "place", "u"),
            each.filter("wanted").select("grp", "hash_table", "bucket", "item_id", "u"),
            ["grp", "hash_table", "bucket"],
            n,
            block_rows,
        )
        # A neighbour may be met in several buckets.
        return N.merged_lists(found, n, repeated=True)

    return search


def similar_items_lsh(df: DataFrame, n: int = 5, focal: DataFrame | None = None, column: str = "embedding", **options):
    """For every item about the ``n`` most similar others of its cluster: item_id, rank, neighbour_id, neighbour_title, similarity.

    Takes the options of ``hyperplane_search``; more tables or probes find more. Similarities are exact, and
    so is the order of what is found. Copies of a vector are searched once. Items without a cluster or
    a vector neither ask nor are found; the vectors of a cluster must have one length.
    """
    return N.nearest_neighbours(
        df, n, group="cluster", focal=focal, column=column, search=hyperplane_search(**options)
    )
