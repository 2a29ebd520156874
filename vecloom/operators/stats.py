"""Per-dimension statistics and standardisation of vector columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.vector import as_double, constant

QUARTILES = (0.25, 0.5, 0.75)
ACCURACY = 2000


def long_form(df: DataFrame, column: str = "embedding") -> DataFrame:
    """(dim, value) rows of a vector column."""
    return df.select(F.posexplode(as_double(F.col(column))).alias("dim", "value"))


def dimension_moments(df: DataFrame, column: str = "embedding") -> DataFrame:
    """(dim, count, mean, std, variance, min, max), sample spread, one row per dimension.

    The summarizer works on whole vectors, so the table is never exploded for it.
    """
    metrics = ("mean", "std", "variance", "min", "max")
    vectors = df.filter(F.col(column).isNotNull()).select(
        array_to_vector(as_double(F.col(column))).alias("v")
    )
    one_row = vectors.agg(Summarizer.metrics("count", *metrics).summary(F.col("v")).alias("s"))
    arrays = one_row.select(
        F.col("s.count").alias("count"), *[vector_to_array(f"s.{m}").alias(m) for m in metrics]
    )
    return arrays.select("count", F.posexplode(F.arrays_zip(*metrics)).alias("dim", "m")).select(
        "dim", "count", *[F.col(f"m.{m}").alias(m) for m in metrics]
    )


def exact_quantiles(
    values: DataFrame, shares: Sequence[float] = QUARTILES, accuracy: int = ACCURACY
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per ``dim`` (columns ``q0``, ``q1``, …).

    Approximate quantiles a little below and above each wanted share cut a dimension
    into a few ranges. Counting the ranges tells which of them hold the wanted ranks,
    and only those, a sliver of the values, are ordered. The answer is exact however
    good the approximation is. Equal values are counted before they are ordered, so a
    value that holds a large share of the rows is one row there.
    """
    margin = 2.0 / accuracy
    points = sorted({min(max(s + d, 0.0), 1.0) for s in shares for d in (-margin, margin)})
    edges = values.groupBy("dim").agg(
        F.percentile_approx("value", points, accuracy).alias("edges"),
        F.count("value").alias("total"),
    )
    bucket = sum(
        ((F.col("value") > F.get("edges", F.lit(i))).cast("int") for i in range(1, len(points))),
        (F.col("value") > F.get("edges", F.lit(0))).cast("int"),
    )
    placed = values.filter(F.col("value").isNotNull()).join(edges, "dim").select(
        "dim", "value", "total", bucket.alias("bucket")
    )
    sizes = placed.groupBy("dim", "total", "bucket").agg(F.count(F.lit(1)).alias("size"))
    # dims × ranges rows.
    upto = F.sum("size").over(Window.partitionBy("dim").orderBy("bucket"))
    rank = [F.lit(s) * (F.col("total") - 1) for s in shares]
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("q"),
                F.floor(r).alias("low"),
                F.ceil(r).alias("high"),
                (r - F.floor(r)).alias("weight"),
            )
            for i, r in enumerate(rank)
        ]
    )
    needed = (
        sizes.withColumn("start", upto - F.col("size"))
        .withColumn(
            "wanted",
            F.filter(
                wanted,
                lambda w: (w["high"] >= F.col("start")) & (w["low"] < F.col("start") + F.col("size")),
            ),
        )
        .filter(F.size("wanted") > 0)
        .select("dim", "bucket", "start", "wanted")
    )
    inside = Window.partitionBy("dim", "bucket").orderBy("value")
    ordered = (
        placed.select("dim", "bucket", "value")
        .join(F.broadcast(needed), ["dim", "bucket"], "left_semi")
        .groupBy("dim", "bucket", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(needed, ["dim", "bucket"])
        .withColumn("end", F.col("start") + F.sum("n").over(inside))
        .withColumn("begin", F.col("end") - F.col("n"))
    )

    def at(rank: str):
        hit = (F.col(f"w.{rank}") >= F.col("begin")) & (F.col(f"w.{rank}") < F.col("end"))
        return F.max(F.when(hit, F.col("value"))).alias(rank)

    found = (
        ordered.select("dim", "value", "begin", "end", F.explode("wanted").alias("w"))
        .groupBy("dim", F.col("w.q").alias("q"))
        .agg(at("low"), at("high"), F.max("w.weight").alias("weight"))
    )
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("weight")
    return found.groupBy("dim").agg(
        *[F.max(F.when(F.col("q") == i, value)).alias(f"q{i}") for i in range(len(shares))]
    )


def describe_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Per dimension: count, mean, std, min, quartiles and max."""
    quartiles = exact_quantiles(long_form(df, column))
    return dimension_moments(df, column).join(quartiles, "dim").select(
        "dim",
        "count",
        "mean",
        "std",
        "min",
        F.col("q0").alias("q25"),
        F.col("q1").alias("q50"),
        F.col("q2").alias("q75"),
        "max",
    )


def standardise(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Shift and scale every dimension to mean 0 and population deviation 1.

    A constant dimension becomes 0. The moments are two numbers per dimension, so the
    scaling itself is a shuffle-free expression over literals.
    """
    moments = dimension_moments(df, column).orderBy("dim").collect()
    mu = constant(r["mean"] for r in moments)
    # From the sample variance to the population deviation.
    sigma = constant((r["variance"] * (r["count"] - 1) / r["count"]) ** 0.5 for r in moments)
    scaled = F.zip_with(
        F.zip_with(as_double(F.col(column)), mu, lambda x, m: x - m),
        sigma,
        lambda d, s: F.when(s > 0, d / s).otherwise(F.lit(0.0)),
    )
    return df.withColumn(column, scaled)
