"""Readers: header CSV, headerless matrix CSV, tolerant review CSV, JSON records."""

from __future__ import annotations

import csv
import os
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.text import strip
from vecloom.schema import SUMMARISED_SCHEMA, ColumnResolutionError

CORRUPT = "_corrupt_row"
#: Different header lines that the files of one table may have.
MAX_HEADERS = 100


def read_header_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """CSV with a header line and quoted fields that may span lines.

    Without a schema every column is a string: column types are never guessed by an
    extra pass over the data. A file with multi-line fields is read by one task, so
    large tables belong in many files (see ``write_csv``).
    """
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_summarised_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_header_csv(spark, path, SUMMARISED_SCHEMA)


def read_matrix_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headerless CSV of numbers; single-line records, so files split across tasks."""
    return spark.read.schema(schema).csv(path, header=False, mode="FAILFAST")


def _files_by_header(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(column names, files) for every header line that occurs in the files of a table."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
        "value",
    )
    first = lines.groupBy("file").agg(F.min(F.struct("at", "value")).alias("line"))
    groups = (
        first.groupBy(F.col("line.value").alias("header"))
        .agg(F.sort_array(F.collect_list("file")).alias("files"))
        .limit(MAX_HEADERS + 1)
        .collect()
    )
    if len(groups) > MAX_HEADERS:
        raise ColumnResolutionError(f"more than {MAX_HEADERS} different headers below {path}")
    found = []
    for row in sorted(groups, key=lambda r: r["files"]):
        names = next(csv.reader([row["header"].removeprefix("\ufeff")], skipinitialspace=True), [])
        found.append((names, [unquote(f) for f in row["files"]]))
    return found


def _review_positions(names: list[str]) -> tuple[int, int]:
    lowered = [n.strip().lower() for n in names]
    title_at = lowered.index("title") if "title" in lowered else None
    review_at = next((i for i, n in enumerate(lowered) if n in ("review", "review_text")), None)
    if title_at is None or review_at is None:
        title_at, review_at = 0, len(names) - 1
    if title_at == review_at:
        raise ColumnResolutionError("a review table needs at least two columns")
    return title_at, review_at


def read_reviews(
    spark: SparkSession, path: str, limit: int | None = None, multi_line: bool = True
) -> DataFrame:
    """Title and review of a review CSV in whatever shape it comes.

    The title is the column named ``title`` and the review the one named ``review`` or
    ``review_text`` in any case; without them the first and the last column are taken. Every
    file counts by its own header line, so files of a table may order or name their
    columns differently. Undecodable bytes become replacement characters, leading blanks are
    skipped, rows that end before the last needed column are dropped, longer rows are kept.

    With ``multi_line`` a quoted field may hold line breaks, and a file is read by one task;
    without it, large files are split.
    """
    parts = [
        _read_review_files(spark, files, len(names), *_review_positions(names), multi_line)
        for names, files in _files_by_header(spark, path)
    ]
    if not parts:
        return spark.createDataFrame([], "title string, review_text string")
    reviews = reduce(DataFrame.unionByName, parts)
    return reviews.limit(limit) if limit else reviews


def _read_review_files(
    spark: SparkSession, files: list[str], width: int, title_at: int, review_at: int, multi_line: bool
) -> DataFrame:
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(width)]
    schema = T.StructType(fields + [T.StructField(CORRUPT, T.StringType())])
    # A pruned parse would not notice that a row is short.
    rows = spark.read.schema(schema).option("columnPruning", False).csv(
        files,
        header=True,
        enforceSchema=True,
        multiLine=multi_line,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=True,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=CORRUPT,
    )
    last_needed = F.col(f"c{max(title_at, review_at)}")
    short = F.col(CORRUPT).isNotNull() & last_needed.isNull()
    return rows.filter(~short).select(
        F.coalesce(strip(F.col(f"c{title_at}")), F.lit("")).alias("title"),
        F.coalesce(strip(F.col(f"c{review_at}")), F.lit("")).alias("review_text"),
    )


def read_json_records(
    spark: SparkSession, path: str, schema: T.StructType, one_array: bool = False
) -> DataFrame:
    """JSON objects, one per line, or one array per file with ``one_array``."""
    return spark.read.schema(schema).json(path, multiLine=one_array)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Distribute a narrow scan by key; a scan with enough splits is left alone.

    A table of few files gives fewer tasks than there are cores, and costly text work
    after the scan would run on a few of them. Project before spreading, so that only
    the needed columns move.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)
