"""Dense row numbers and row windows without a single-task global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000
MAX_RANGES = 256
_RANGE, _PART, _START, _WITHIN = "__range", "__part", "__start", "__within"


def _range_cuts(df: DataFrame, key: str, ranges: int) -> list[int]:
    """Approximate quantiles of ``key``: at most ``MAX_RANGES + 1`` numbers."""
    share = [i / ranges for i in range(ranges + 1)]
    found = df.agg(F.percentile_approx(key, share, 10 * ranges).alias("cuts")).first()
    return sorted(set(found["cuts"] or []))


def with_row_number(
    df: DataFrame, key: str = "item_id", into: str = "row_number", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Number rows 0, 1, … in the order of the unique, non-null integer column ``key``.

    Rows fall into key buckets; a bucket's first number is the count of all rows in
    earlier buckets, and only the numbering inside a bucket needs a sort. The buckets
    are approximate quantile ranges, each cut into equal widths, but the numbers are
    exact whatever the buckets are, and a recomputed task yields the same numbers
    because a row's bucket depends on nothing but its key.
    """
    total = df.count()
    buckets = -(-total // rows_per_bucket)
    if buckets <= 1:
        # A single task here sorts at most rows_per_bucket rows.
        return df.withColumn(into, (F.row_number().over(Window.orderBy(key)) - 1).cast("long"))

    ranges = min(MAX_RANGES, buckets)
    cuts = _range_cuts(df, key, ranges)
    placed = df.withColumn(_RANGE, _range_of(F.col(key), cuts)).withColumn(
        _PART, _part_of(F.col(key), F.col(_RANGE), cuts, -(-buckets // ranges))
    )
    sizes = placed.groupBy(_RANGE, _PART).agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket, so this running total is small whatever the data size.
    before = Window.orderBy(_RANGE, _PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        _RANGE, _PART, F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias(_START)
    )
    within = Window.partitionBy(_RANGE, _PART).orderBy(key)
    return (
        placed.join(starts, [_RANGE, _PART])
        .withColumn(_WITHIN, F.row_number().over(within) - 1)
        .withColumn(into, F.col(_START) + F.col(_WITHIN))
        .drop(_RANGE, _PART, _START, _WITHIN)
    )


def _range_of(value: Column, cuts: list[int]) -> Column:
    """Number of cuts ≤ value, as a balanced decision tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= F.lit(cuts[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(cuts))


def _part_of(value: Column, range_no: Column, cuts: list[int], parts: int) -> Column:
    """Equal-width part of a value inside its range; the open end ranges have one part."""
    if parts <= 1 or len(cuts) < 2:
        return F.lit(0)
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    low, high = F.get(edges, range_no - 1), F.get(edges, range_no)
    share = (value - low).cast("double") / (high - low)
    return F.coalesce(F.floor(share * parts).cast("int"), F.lit(0))


def take_window(df: DataFrame, start: int, count: int, key: str = "item_id") -> DataFrame:
    """Rows ``[start, start + count)`` in key order.

    When the window is near the front Spark's top-k does it without a full sort; a
    window further in uses the distributed row numbers.
    """
    if start + count <= 10_000:
        return df.orderBy(key).offset(start).limit(count)
    numbered = with_row_number(df, key, "__rn")
    return numbered.filter(
        (F.col("__rn") >= start) & (F.col("__rn") < start + count)
    ).drop("__rn")
