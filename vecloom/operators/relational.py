"""Keyed joins, merges and set operations between item tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.text import is_blank


def with_summary(df: DataFrame, allow_empty: bool = False, column: str = "structured_summary") -> DataFrame:
    """Rows that have a summary; ``allow_empty`` keeps the empty string too."""
    present = F.col(column).isNotNull()
    return df.filter(present if allow_empty else present & (F.col(column) != ""))


def missing_summary(df: DataFrame, column: str = "structured_summary") -> DataFrame:
    return df.filter(F.col(column).isNull())


def with_title(df: DataFrame) -> DataFrame:
    """Rows with a usable title; a null title is never turned into text."""
    return df.filter(~is_blank(F.col("title")))


def not_yet_done(df: DataFrame, done: DataFrame, on: str = "title") -> DataFrame:
    """Rows whose key is absent from ``done``."""
    keys = done.select(on).filter(F.col(on).isNotNull()).distinct()
    return df.filter(F.col(on).isNotNull()).join(keys, on, "left_anti")


def first_per_title(
    df: DataFrame, not_in: DataFrame | None = None, order: str = "item_id"
) -> DataFrame:
    """One row per title, the first in row order, for titles absent from ``not_in``.

    Only the title and its smallest order value are grouped (combined map-side) and
    compared with ``not_in``; a title that holds a large share of the rows is one small
    row by then. The full rows are fetched last, by their unique order value.
    """
    firsts = df.groupBy("title").agg(F.min(order).alias(order))
    if not_in is not None:
        firsts = not_yet_done(firsts, not_in)
    return df.join(firsts.select(order), order, "left_semi")


def attach_summary(df: DataFrame, summaries: DataFrame) -> DataFrame:
    """Look up (summary, provider) by title; the last row of a title wins.

    Only titles and ids are grouped; the texts are fetched once, by their unique id.
    """
    last = summaries.filter(F.col("title").isNotNull()).groupBy("title").agg(F.max("item_id").alias("item_id"))
    latest = summaries.join(last.select("item_id"), "item_id", "left_semi").select(
        "title", F.col("structured_summary").alias("summary"), F.col("provider").alias("summary_provider")
    )
    return df.join(latest, "title", "left")


def upsert(df: DataFrame, new: DataFrame, key: str = "item_id", column: str = "structured_summary") -> DataFrame:
    """Write new values into their rows; rows without a new value stay as they are."""
    fresh = new.filter(F.col(column).isNotNull()).select(key, F.col(column).alias("__new"))
    return (
        df.join(fresh, key, "left")
        .withColumn(column, F.coalesce("__new", F.col(column)))
        .drop("__new")
        .select(*df.columns)
    )


def merge_summaries(*sources: DataFrame) -> DataFrame:
    """Union the sources in the given order and keep one row per summarised title.

    Columns of every source: item_id, title, review, structured_summary. The summary is
    the title's last non-null one, the review that of its first row (empty when that is
    null, whatever later rows hold), and ``position`` gives the order of the title's
    first summarised row.
    """
    columns = ["title", "review", "structured_summary"]
    tagged = [s.select(F.lit(i).alias("source"), F.col("item_id").alias("row"), *columns) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, tagged).filter(F.col("title").isNotNull())
    # Long columns only, so that they are hashed, not sorted; the texts are fetched by (source, row).
    every = range(len(sources))
    summarised = F.col("structured_summary").isNotNull()
    own = lambda i, *more: F.when(reduce(lambda a, b: a & b, more, F.col("source") == i), F.col("row"))
    ends = rows.groupBy("title").agg(
        *[F.min(own(i)).alias(f"any_{i}") for i in every],
        *[F.min(own(i, summarised)).alias(f"first_{i}") for i in every],
        *[F.max(own(i, summarised)).alias(f"last_{i}") for i in every],
    )

    def pick(name: str, order) -> Column:
        found = [
            F.when(F.col(f"{name}_{i}").isNotNull(), F.struct(F.lit(i).alias("source"), F.col(f"{name}_{i}").alias("row")))
            for i in order
        ]
        return F.coalesce(*found)

    at = ends.select(
        "title", pick("first", every).alias("position"), pick("any", every).alias("r"), pick("last", reversed(every)).alias("s")
    ).filter(F.col("position").isNotNull())
    at_row = lambda name, text: rows.select(F.struct("source", "row").alias(name), text)
    return (
        at.join(at_row("r", "review"), "r")
        .join(at_row("s", "structured_summary"), "s")
        .select("title", F.coalesce("review", F.lit("")).alias("review"), "structured_summary", "position")
    )


def content_digest(columns: list[str]) -> Column:
    """SHA-256 of some text columns together; null counts as different from empty."""
    lengths = [F.coalesce(F.length(c), F.lit(-1)).cast("string") for c in columns]
    texts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("|", *lengths, *texts), 256)


def enrich_distinct(
    df: DataFrame,
    columns: list[str],
    enrich: Callable[[DataFrame], DataFrame],
    key: str = "item_id",
) -> DataFrame:
    """Run ``enrich`` once per distinct content of ``columns`` and join back to all rows.

    Copies are matched by a digest of the content, so neither the grouping nor the join
    moves long texts twice. ``enrich`` gets one representative row per content and must
    keep the digest column ``content``.
    """
    keyed = df.withColumn("content", content_digest(columns))
    representatives = keyed.groupBy("content").agg(F.min(key).alias(key)).select(key)
    enriched = enrich(keyed.join(representatives, key, "left_semi"))
    added = [c for c in enriched.columns if c not in keyed.columns]
    return keyed.join(enriched.select("content", *added), "content", "left").drop("content")


def combine_vectors(existing: DataFrame, new: DataFrame, settings: tuple[dict, dict] | None = None) -> DataFrame:
    """Existing and new vectors in one table, one row per item (existing rows win).

    ``settings`` are the embedding settings of the two tables; vectors made under
    different settings live in different spaces and are refused.
    """
    if settings and settings[0] != settings[1]:
        raise ValueError(f"vectors come from different embedding settings: {settings}")
    fresh = new.join(existing.select("item_id"), "item_id", "left_anti")
    return existing.unionByName(fresh)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def search_items(
    df: DataFrame, title_contains: str | None = None, **equals: str | int
) -> DataFrame:
    """Attribute filter plus case-insensitive title match."""
    for name, value in equals.items():
        df = df.filter(F.col(name) == value)
    if title_contains:
        df = df.filter(F.contains(F.lower("title"), F.lit(title_contains.lower())))
    return df


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, into: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group.

    Spark turns the rank filter into a group limit before the shuffle, so every task
    forwards at most ``n`` rows of a group however large the group is.
    """
    ranked = df.withColumn(into, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(into) <= n)
