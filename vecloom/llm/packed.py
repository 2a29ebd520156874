"""Helpers shared by the text operators: byte words, 64-bit keys and packed exchanges.

A *packed exchange* moves keys between tasks as numpy buffers inside binary columns: one
row holds all keys that one task has for one bucket. Spark deals, spills and retries the
rows as any others; a key costs eight bytes in the shuffle, not a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word and line contracts: \x20 and \x09-\x0D. ``bytes.split()``
#: and ``bytes.strip(WHITE)`` use exactly this set.
WHITE = b" \t\n\r\x0b\x0c"
#: Words gathered before a task packs them.
CHUNK_WORDS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)


def buckets_of(spark: SparkSession, factor: int = 1) -> int:
    """How many buckets a packed exchange uses: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


def id_and_text(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text as bytes, under fixed names, whatever else the table has."""
    return documents.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"),
    )


def free_name(taken: Iterable[str], name: str) -> str:
    """The name, with underscores behind it until no column has it; Spark does not tell case apart."""
    taken = {column.lower() for column in taken}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Rabin-Karp hashes modulo 2**64 of all windows of a sequence of word keys.

    Prefix sums of ``key[i] * base**-i`` give every window by one subtraction, and
    multiplying by ``base**i`` makes the value independent of the window's place.
    """

    BASE = 0xD1342543DE82EF95

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, np.uint64)

    def windows(self, keys: np.ndarray, width: int) -> np.ndarray:
        n = len(keys)
        if n < width:
            return np.empty(0, np.uint64)
        if len(self._up) < n + 1:
            size = max(n + 1, 2 * len(self._up))
            up, down = np.full(size, self.BASE, np.uint64), np.full(size, pow(self.BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self._up, self._down = np.cumprod(up), np.cumprod(down)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(keys * self._down[:n], out=total[1:])
        return mix((total[width:] - total[:-width]) * self._up[: n - width + 1])


def bucket_numbers(keys: np.ndarray, buckets: int) -> np.ndarray:
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(kind)


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys by bucket, and (numbers, starts with the end appended) of the buckets."""
    numbers = bucket_numbers(keys, buckets)
    order = np.argsort(numbers, kind="stable")
    there, starts = np.unique(numbers[order], return_index=True)
    return order, there, np.append(starts, len(keys))


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length form of an array: (values, lengths)."""
    if not len(values):
        return values, np.empty(0, np.uint32)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[starts], np.diff(np.append(starts, len(values))).astype(np.uint32)


def joined(buffers: Iterable[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(buffers), kind)


def small_slices(batches: Iterable[pa.RecordBatch], text_col: str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of text, one row at least.

    A batch holds a number of rows, however long; what a task derives from a slice is bounded.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(start, end - start)


def replace_text(batch: pa.RecordBatch, text_col: str, texts: list[bytes], drop: Iterable[str] = ()) -> pa.RecordBatch:
    """The batch with new texts in its text column, all others as they are but for those to drop."""
    names = [name for name in batch.schema.names if name not in set(drop)]
    arrays = [
        pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()) if n == text_col else batch.column(n)
        for n in names
    ]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def as_bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8") for t in column.to_pylist()]


def arrow_rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


@contextmanager
def shuffles_end_with_their_job(spark: SparkSession):
    """Inside, Spark deletes a job's shuffle files when the job has written its table.

    Only for jobs that end in a written table; nothing reads their shuffles afterwards.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def narrow(values: np.ndarray) -> bytes:
    """Counts as one byte each, with those of 255 and more appended in full."""
    big = values >= 255
    return np.where(big, 255, values).astype(np.uint8).tobytes() + values[big].astype(np.int64).tobytes()


def widen(buffer: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(buffer, np.uint8, n).astype(np.int64)
    values[values == 255] = np.frombuffer(buffer, np.int64, offset=n)
    return values
