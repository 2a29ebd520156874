"""Vector expressions over ``array<double>`` columns, in a fixed summation order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def constant(values: Iterable[float]) -> Column:
    """A vector of known finite numbers as one array expression."""
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """Unit vector; NULL for a zero vector.

    The norm is repeated as an array beside the vector: inside a lambda it would be
    computed again for every element.
    """
    length = F.nullif(norm(v), F.lit(0.0))
    return F.when(
        length.isNotNull(), F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, n: x / n)
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )
