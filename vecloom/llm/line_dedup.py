"""Line dedup on levelled sorted runs of line hashes.

``LineRuns`` keeps what earlier batches had as Parquet runs of (line hash, documents),
sorted by hash. A batch first merge-anti-joins the lines already settled (found in enough
documents), and adds the rest as a run of level 0. When a level holds ``fanout`` runs they
are merged into one run of the next level; lines that have reached ``min_docs`` move to the
settled runs. Nothing is rewritten more often than once a level.

Hashes have 128 bits. A run's size is that of its distinct lines, combined before the
shuffle, so a line shared by all documents is one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.packed import WHITE, arrow_rows, as_bytes, free_name, id_and_text, replace_text, rows_of, small_slices
from vecloom.session import new_path

MIN_DOCS = 10
BATCHES = 4
FANOUT = 2
KEY = ["hi", "lo"]

_LINES = pa.schema([("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())]
)


def line_key(line: bytes) -> bytes:
    """Stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased (bytes methods are ASCII)."""
    return line.strip(WHITE).lower()


def _hash(key: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _line_hashes(min_chars: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in rows_of([batch]):
                keys = {line_key(line) for line in (text or b"").split(b"\n")}
                out += [
                    (doc_id, *_hash(key))
                    for key in keys
                    if len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars
                ]
                if len(out) > 50_000:
                    yield arrow_rows(_LINES, out)
                    out = []
            yield arrow_rows(_LINES, out)

    return hashes


def without_lines(text: bytes, gone: list | None) -> tuple[list[bytes], int]:
    """(lines that stay, number of lines before)."""
    lines = text.split(b"\n")
    if not gone:
        return lines, len(lines)
    keys = {(g["hi"], g["lo"]) for g in gone}
    return [line for line in lines if _hash(line_key(line)) not in keys], len(lines)


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, gone in rows_of([batch]):
            kept, before = without_lines(text or b"", gone)
            out.append((doc_id, before, before - len(kept), b"\n".join(kept).decode("utf-8", "replace")))
        yield arrow_rows(_RESULT, out)


def _drop_in_rows(text_col: str, gone_col: str, gone_id: str):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, text_col):
            gone = batch.column(gone_col).to_pylist()
            texts = [
                b"\n".join(without_lines(text, g)[0]) for text, g in zip(as_bytes(batch.column(text_col)), gone, strict=True)
            ]
            yield replace_text(batch, text_col, texts, drop=[gone_col, gone_id])

    return drop


class LineRuns:
    """Runs of (hi, lo, docs) by level, and the settled keys, in one shared folder."""

    def __init__(self, spark: SparkSession, root: str | None = None, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark = spark
        self.root = root or new_path(spark, "line-runs")
        self.min_docs = min_docs
        self.fanout = fanout
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []
        self._made = 0

    def _write(self, rows: DataFrame) -> str:
        self._made += 1
        path = f"{self.root}/run-{self._made:05d}"
        rows.sortWithinPartitions(*KEY).write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("hi long, lo long, docs long").parquet(*paths)

    def settled_keys(self) -> DataFrame:
        if not self.settled:
            return self.spark.createDataFrame([], "hi long, lo long, docs long")
        return self._read(self.settled)

    def add(self, lines: DataFrame) -> None:
        """One batch of (doc_id, hi, lo); a document's lines all come in one batch."""
        if self.settled:
            lines = lines.join(self.settled_keys().select(*KEY).hint("merge"), KEY, "left_anti")
        run = lines.groupBy("doc_id", *KEY).agg(F.lit(1)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"))
        self.levels[0].append(self._write(run))
        self._compact(force=False)

    def _compact(self, force: bool) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                self._merge(self.levels[level], level)
            level += 1
        if force and (rest := [path for paths in self.levels for path in paths]):
            self._merge(rest, len(self.levels) - 1)

    def _merge(self, paths: list[str], level: int) -> None:
        total = self._read(paths).groupBy(*KEY).agg(F.sum("docs").alias("docs"))
        merged = self._read([self._write(total)])
        path = f"{self.root}/run-{self._made:05d}"
        if merged.filter(F.col("docs") >= self.min_docs).limit(1).count():
            self.settled.append(self._write(merged.filter(F.col("docs") >= self.min_docs).coalesce(8)))
            path = self._write(merged.filter(F.col("docs") < self.min_docs))
        self.levels = [[p for p in old if p not in paths] for old in self.levels]
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(path)

    def finish(self) -> DataFrame:
        """Merge everything that is left; the keys found in at least ``min_docs`` documents."""
        self._compact(force=True)
        return self.settled_keys().select(*KEY)


def repeated_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """(doc_id, gone): of each document that has any, the hashes of its lines that go."""
    spark = docs.sparkSession
    staged = new_path(spark, "lines")
    docs.mapInArrow(_line_hashes(min_chars), "doc_id long, hi long, lo long").withColumn(
        "batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    ).write.partitionBy("batch").parquet(staged)
    lines = spark.read.schema("doc_id long, hi long, lo long, batch int").parquet(staged)
    runs = LineRuns(spark, min_docs=min_docs, fanout=fanout)
    for number in range(batches):
        runs.add(lines.filter(F.col("batch") == number).drop("batch"))
    return (
        lines.join(runs.finish(), KEY, "left_semi")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct(*KEY)).alias("gone"))
    )


def line_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, n_lines (before), n_dropped and kept (text of the other lines).

    A text is split at \\n; a null or empty text is one empty line. Lines whose key has at
    least ``min_chars`` code points and occurs in at least ``min_docs`` documents go from
    every document. Rows that share an id are one document in the count and keep their own
    rows; rows with a null id count together as one document and lose nothing. Other
    columns are not read. An empty table gives an empty result.
    """
    docs = id_and_text(documents, id_col, text_col)
    return (
        docs.join(repeated_lines(docs, **options).hint("shuffle_hash"), "doc_id", "left")
        .select("doc_id", "text", "gone")
        .mapInArrow(_drop, "doc_id long, n_lines long, n_dropped long, kept string")
    )


def drop_repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``documents``, all columns, with their texts cleared of repeated lines.

    As ``line_dedup``; a null text becomes an empty one, and a text that loses all its lines stays
    as an empty one.
    """
    gone_id, gone_col = (free_name(documents.columns, name) for name in ("_gone_lines_id", "_gone_lines"))
    gone = repeated_lines(id_and_text(documents, id_col, text_col), **options).withColumnsRenamed(
        {"doc_id": gone_id, "gone": gone_col}
    )
    return documents.join(
        gone.hint("shuffle_hash"), F.col(f"`{id_col}`").cast("long") == F.col(gone_id), "left"
    ).mapInArrow(_drop_in_rows(text_col, gone_col, gone_id), documents.schema)
