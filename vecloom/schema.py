"""Table schemas and the operators that bring foreign column layouts into them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM_SCHEMA = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("review", T.StringType()),
    ]
)

SUMMARISED_SCHEMA = T.StructType(
    ITEM_SCHEMA.fields + [T.StructField("structured_summary", T.StringType())]
)

VECTOR_SCHEMA = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

CLUSTER_SCHEMA = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("summary", T.StringType()),
        T.StructField("provider", T.StringType()),
    ]
)

# Layout records of the projected view: keyed by row id, coloured per cluster.
LAYOUT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("color", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

# Layout records of the summarised view (field names are part of the file format).
SUMMARY_LAYOUT_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("tsneX", T.DoubleType()),
        T.StructField("tsneY", T.DoubleType()),
        T.StructField("tsneZ", T.DoubleType()),
        T.StructField("summary", T.StringType()),
    ]
)

# Cluster colour by cluster number.
CLUSTER_PALETTE = (
    "#FF6384",
    "#36A2EB",
    "#FFCE56",
    "#4BC0C0",
    "#9966FF",
    "#FF9F40",
    "#E7E9ED",
    "#FF6384",
    "#4BC0C0",
)


class ColumnResolutionError(ValueError):
    """No column of the table can play the requested role."""


def normalise_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name; refuse names that differ only in case."""
    lowered = [name.lower() for name in df.columns]
    clashes = sorted({n for n in lowered if lowered.count(n) > 1})
    if clashes:
        raise ColumnResolutionError(f"columns differ only in case: {clashes}")
    return df.toDF(*lowered)


def _first_containing(columns: Sequence[str], part: str) -> str | None:
    return next((c for c in columns if part in c.lower()), None)


def title_column(columns: Sequence[str]) -> str:
    """Exact name, else the first name containing it, else the first column."""
    if "title" in columns:
        return "title"
    return _first_containing(columns, "title") or columns[0]


def summary_column(columns: Sequence[str]) -> str:
    """Exact name, else the first name containing ``summary``, else an error."""
    if "structured_summary" in columns:
        return "structured_summary"
    found = _first_containing(columns, "summary")
    if found is None:
        raise ColumnResolutionError("no summary column")
    return found


def review_column(columns: Sequence[str]) -> str | None:
    """``review_text``, else ``review``, else any name containing ``review``."""
    for exact in ("review_text", "review"):
        if exact in columns:
            return exact
    return _first_containing(columns, "review")


def resolve_columns(df: DataFrame) -> DataFrame:
    """Rename whatever plays title, review and summary to the standard names."""
    df = normalise_columns(df)
    wanted = {
        title_column(df.columns): "title",
        summary_column(df.columns): "structured_summary",
    }
    review = review_column([c for c in df.columns if c not in wanted])
    if review:
        wanted[review] = "review"
    return df.withColumnsRenamed(wanted)


def coalesce_review(df: DataFrame, names: Sequence[str], into: str = "review") -> DataFrame:
    """First non-null of several review columns, in the given order."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.coalesce(*[F.col(f"`{n}`") for n in names]).alias(into))


def with_default_columns(df: DataFrame) -> DataFrame:
    """Add or fill the optional columns every later step relies on."""
    have = set(df.columns)

    def present(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    return df.withColumns(
        {
            "structured_summary": present("structured_summary"),
            "name": F.coalesce(present("name"), F.format_string("Game %d", F.col("item_id"))),
            "description": F.coalesce(present("description"), F.lit("")),
            "provider": F.coalesce(present("provider"), F.lit("")),
        }
    )


def combine_text_columns(df: DataFrame, marker: str = "Text", into: str = "combined_text") -> DataFrame:
    """Join all columns whose name contains ``marker`` with single blanks.

    A null column contributes an empty string and keeps its separator.
    """
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns if marker in c]
    if not parts:
        raise ColumnResolutionError(f"no column name contains {marker!r}")
    return df.withColumn(into, F.concat_ws(" ", *parts))


def pack_vector(df: DataFrame, size: int, into: str = "embedding") -> DataFrame:
    """Replace the last ``size`` columns by one ``array<float>`` column."""
    if size > len(df.columns):
        raise ColumnResolutionError(f"{size} vector columns wanted, {len(df.columns)} present")
    keep, packed = df.columns[:-size], df.columns[-size:]
    vector = F.array(*[F.col(f"`{c}`").cast("float") for c in packed])
    return df.select(*[F.col(f"`{c}`") for c in keep], vector.alias(into))


def unpack_vector(df: DataFrame, size: int, column: str = "embedding", prefix: str = "") -> DataFrame:
    """Replace a vector column by ``size`` scalar columns ``{prefix}0..``."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != column]
    cells = [F.get(F.col(column), F.lit(i)).alias(f"{prefix}{i}") for i in range(size)]
    return df.select(*keep, *cells)


def palette_colour(cluster: Column, palette: Sequence[str] = CLUSTER_PALETTE) -> Column:
    """Colour of a cluster number; NULL outside the palette."""
    return F.get(F.array(*[F.lit(c) for c in palette]), cluster.cast("int"))


def to_layout(df: DataFrame) -> DataFrame:
    """Cast and name the columns of the coloured layout records."""
    df = with_default_columns(df)
    return df.select(
        F.col("item_id").cast("long").alias("id"),
        F.col("x").cast("double").alias("x"),
        F.col("y").cast("double").alias("y"),
        F.col("z").cast("double").alias("z"),
        F.col("cluster").cast("int").alias("cluster"),
        palette_colour(F.col("cluster")).alias("color"),
        "name",
        "description",
    )


def to_summary_layout(df: DataFrame, *also: str) -> DataFrame:
    """Cast and name the columns of the summarised layout records; ``also`` names columns to carry along."""
    return df.select(
        "title",
        F.coalesce(F.col("provider"), F.lit("")).alias("provider"),
        F.col("cluster").cast("int").alias("cluster"),
        F.col("x").cast("double").alias("tsneX"),
        F.col("y").cast("double").alias("tsneY"),
        F.col("z").cast("double").alias("tsneZ"),
        "summary",
        *also,
    )


def cluster_table(df: DataFrame) -> DataFrame:
    """The item-to-cluster table; ``provider`` is always present."""
    return df.select(
        F.col("item_id").cast("long").alias("item_id"),
        "title",
        F.col("cluster").cast("int").alias("cluster"),
        "summary",
        F.coalesce(F.col("provider"), F.lit("")).alias("provider"),
    )
