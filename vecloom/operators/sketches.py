"""Mergeable sketches: quantiles per dimension and distinct keys per stage, kept and combined between runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.stats import QUARTILES, long_form

#: Size of a quantile sketch, and the rank error (a share of the rows) that it keeps with great certainty.
QUANTILE_SIZE = 800
RANK_ERROR = 0.02
#: Size of a key sketch (2^14 registers), and its error as a share of the distinct keys compared.
KEY_BITS = 14
KEY_ERROR = 0.04


def quantile_sketches(df: DataFrame, column: str = "embedding", size: int = QUANTILE_SIZE) -> DataFrame:
    """(dim, sketch): a KLL sketch of every dimension, a few kilobytes whatever the number of rows."""
    return long_form(df, column).groupBy("dim").agg(F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))


def merge_quantile_sketches(*parts: DataFrame) -> DataFrame:
    """The sketches of several tables as sketches of their union."""
    together = reduce(DataFrame.unionByName, [p.select("dim", "sketch") for p in parts])
    return together.groupBy("dim").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, shares: Sequence[float] = QUARTILES) -> DataFrame:
    """(dim, count, share, value): a value of the table whose rank is within RANK_ERROR of the share."""
    return sketches.select(
        "dim",
        F.kll_sketch_get_n_double("sketch").alias("count"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(float(s)).alias("share"),
                        F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("value"),
                    )
                    for s in shares
                ]
            )
        ).alias("q"),
    ).select("dim", "count", "q.share", "q.value")


def rank_of(df: DataFrame, found: DataFrame, column: str = "embedding") -> DataFrame:
    """``found`` (dim, share, value) with ``below`` and ``upto``: shares of rows smaller, and not larger, than the value."""
    values = long_form(df, column).filter(F.col("value").isNotNull()).withColumnRenamed("value", "own")
    counted = values.join(F.broadcast(found), "dim").groupBy("dim", "share").agg(
        (F.count_if(F.col("own") < F.col("value")) / F.count(F.lit(1))).alias("below"),
        (F.count_if(F.col("own") <= F.col("value")) / F.count(F.lit(1))).alias("upto"),
    )
    return found.join(counted, ["dim", "share"])


def key_sketches(stages: Sequence[tuple[str, DataFrame]], key: str = "item_id", bits: int = KEY_BITS) -> DataFrame:
    """(stage, sketch): an HLL sketch of the keys of each stage; null keys do not count.

    The table is as many rows as there are stages, to be stored with the run and compared with a later one.
    """
    tagged = reduce(
        DataFrame.unionByName, [t.select(F.lit(name).alias("stage"), F.col(key).alias("key")) for name, t in stages]
    )
    return tagged.groupBy("stage").agg(F.hll_sketch_agg("key", F.lit(bits)).alias("sketch"))


def compare_key_sketches(before: DataFrame, after: DataFrame) -> DataFrame:
    """(stage, before, after, either, lost, added): estimated distinct keys of two runs, from their sketches alone.

    Lost and added keys are what the union has more than one run; each estimate is within KEY_ERROR of ``either``.
    A stage that one run lacks has no keys there.
    """
    both = before.select("stage", F.col("sketch").alias("b")).join(
        after.select("stage", F.col("sketch").alias("a")), "stage", "full"
    )
    nothing = F.lit(0).cast("long")
    b, a = (F.coalesce(F.hll_sketch_estimate(c), nothing) for c in "ba")
    either = F.coalesce(F.hll_sketch_estimate(F.hll_union("b", "a")), b + a)
    counts = both.select("stage", b.alias("before"), a.alias("after"), either.alias("either"))
    return counts.select(
        "*",
        F.greatest(F.col("either") - F.col("after"), nothing).alias("lost"),
        F.greatest(F.col("either") - F.col("before"), nothing).alias("added"),
    )
