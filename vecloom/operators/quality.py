"""Audits between stages, rejects, job accounting and cost ledgers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.ordering import with_row_number

# Price per embedded row and rows per ledger line.
UNIT_COST = 0.0001
LEDGER_BATCH = 100
ESTIMATE_SAMPLE = 100


def split_embedded(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose embedding succeeded, and the rejects."""
    ok = F.col("embedding").isNotNull()
    return df.filter(ok), df.filter(~ok)


def consistency_audit(stages: Sequence[tuple[str, DataFrame, str | None]]) -> DataFrame:
    """Compare adjacent stages by row count and by key.

    Each stage is (name, table with item_id, column that must be non-null or None).
    Per stage: rows, valid rows, distinct keys, and against the stage before it the
    count mismatch flag, the keys that got lost and the keys that appeared.
    """
    every = range(len(stages))
    # One pass over all stages: how many rows, and valid rows, of each stage a key has.
    tagged = reduce(
        DataFrame.unionByName,
        [
            table.select(
                "item_id",
                F.lit(p).alias("position"),
                (F.col(needed).isNotNull() if needed else F.lit(True)).alias("valid"),
            )
            for p, (_, table, needed) in enumerate(stages)
        ],
    )
    here = [F.col("position") == p for p in every]
    keys = tagged.groupBy("item_id").agg(
        *[F.count_if(here[p]).alias(f"n_{p}") for p in every],
        *[F.count_if(here[p] & F.col("valid")).alias(f"v_{p}") for p in every],
    )
    has = [F.col(f"n_{p}") > 0 for p in every]
    nothing = F.lit(0).cast("long")
    total = lambda name: F.coalesce(F.sum(name), nothing)
    totals = keys.agg(
        F.array(
            *[
                F.struct(
                    F.lit(p).alias("position"),
                    F.lit(stages[p][0]).alias("stage"),
                    total(f"n_{p}").alias("n_rows"),
                    total(f"v_{p}").alias("n_valid"),
                    F.count_if(has[p]).alias("distinct_keys"),
                    (F.count_if(has[p - 1] & ~has[p]) if p else nothing).alias("keys_lost"),
                    (F.count_if(~has[p - 1] & has[p]) if p else nothing).alias("keys_added"),
                )
                for p in every
            ]
        ).alias("s")
    )
    # One row per stage from here on.
    rows = totals.select(F.explode("s").alias("s")).select("s.*")
    before = F.lag("n_rows").over(Window.orderBy("position"))
    return rows.withColumn("mismatch", F.coalesce(before != F.col("n_rows"), F.lit(False)))


def title_audit(df: DataFrame) -> DataFrame:
    """Total and distinct titles and clusters; missing ones count as '' and -1."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(F.coalesce("title", F.lit(""))).alias("distinct_titles"),
        F.countDistinct(F.coalesce("cluster", F.lit(-1))).alias("distinct_clusters"),
    )


def enrich_status(df: DataFrame, status: str = "status") -> DataFrame:
    """Processed, completed, skipped and failed counts of a job."""
    return df.agg(
        F.count(F.lit(1)).alias("processed"),
        *[
            F.count_if(F.col(status) == s).alias(s)
            for s in ("completed", "skipped", "failed")
        ],
    )


def cost_ledger(df: DataFrame, unit_cost: float = UNIT_COST, batch: int = LEDGER_BATCH) -> DataFrame:
    """Rows, cost and running totals of each batch of ``batch`` rows in row order.

    A batch's running row count is its last row number plus one, so the running totals
    need no window over the batches.
    """
    total = df.count()
    batches = (
        with_row_number(df.select("item_id"), "item_id", "rn")
        .groupBy(F.floor(F.col("rn") / batch).cast("long").alias("batch"))
        .agg(F.count(F.lit(1)).alias("n_rows"), (F.max("rn") + 1).alias("processed"))
    )
    return batches.select(
        "batch",
        "n_rows",
        F.round(F.col("n_rows") * unit_cost, 6).alias("cost"),
        "processed",
        F.lit(total).cast("long").alias("total"),
        F.round(F.col("processed") * unit_cost, 6).alias("cumulative_cost"),
    )


def cost_estimate(df: DataFrame, unit_cost: float = UNIT_COST, sample: int = ESTIMATE_SAMPLE) -> DataFrame:
    """Cost of the first ``sample`` rows and its extrapolation to the whole table."""
    tried = df.select("item_id").orderBy("item_id").limit(sample)
    measured = tried.agg(
        F.count(F.lit(1)).alias("sample_rows"),
        F.round(F.count(F.lit(1)) * unit_cost, 6).alias("sample_cost"),
    )
    total = F.lit(df.count()).cast("long")
    per_row = F.col("sample_cost") / F.nullif("sample_rows", F.lit(0))
    return measured.select(
        "sample_rows",
        "sample_cost",
        total.alias("total"),
        F.round(per_row * total, 6).alias("estimated_cost"),
    )
