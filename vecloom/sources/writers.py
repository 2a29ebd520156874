"""Writers: CSV, JSON records, the nested cluster map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORDS_PER_FILE = 100_000


def write_csv(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    header: bool = True,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Quoted CSV; the writer escapes embedded quotes once by doubling them.

    Files are bounded in rows because a reader of multi-line fields cannot split one.
    Padding of the values is kept.
    """
    df.write.mode(mode).options(
        header=header,
        quoteAll=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        maxRecordsPerFile=records_per_file,
    ).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    write_csv(df, path, mode="append")


def write_matrix_csv(df: DataFrame, path: str) -> None:
    """Plain headerless numbers, readable in parallel."""
    df.write.mode("overwrite").csv(path, header=False)


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, written by every task in parallel."""
    df.write.mode(mode).json(path)


def cluster_info_json(info: DataFrame) -> DataFrame:
    """One row with the JSON map ``{cluster: {count, color, sample_games}}``.

    ``info`` has one row per cluster, so the map is as small as the number of clusters.
    """
    entry = F.struct(
        F.col("cluster").cast("string").alias("key"),
        F.struct("count", "color", "sample_games").alias("value"),
    )
    return info.agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json")
    )
