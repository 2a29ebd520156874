"""Target-distribution importance resampling, drawn by a parallel sort by regular sampling.

Texts are bags of hashed features: all runs of one to three words, each in one of a fixed
number of buckets. The log ratio of target to source counts makes an array of gains; a
document's weight is the sum of its features' gains, and a Gumbel draw of its id is added, so that the
highest scores are a sample without replacement.

Ranks come from a sort in parallel. Tasks sort their scores in bounded runs; elements at regular
places of the runs give splitters; the parts of the runs between two splitters go to one
task, which merges them; prefix counts of the segments make its places exact ranks.

The bucket of a feature needs the crc32 of its words joined by blanks. It is put together from the
words' own values: appending n bytes to a text multiplies its crc by a matrix of bits that depends on n only,
looked up here for four bytes at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.packed import arrow_rows, buckets_of, id_and_text, rows_of
from vecloom.session import cut_lineage

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Rows of a sorted run, and of a merged segment on average at most.
RUN_ROWS = 1_000_000
SEGMENT_ROWS = 1_000_000
#: About how many run elements the splitters are chosen from; a run gives every 64th at most.
SAMPLES = 16_384
LEAST_STRIDE = 64
#: Words of a text looked at in one go.
SLICE_WORDS = 500_000

#: Bytes that are not of a word become blanks, A-Z become a-z.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256)
)
_TABLE_LENGTHS = 64


@cache
def _byte_table() -> np.ndarray:
    """What a zero register becomes by each byte of reflected CRC-32."""
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = (values >> np.uint32(1)) ^ np.where(values & 1, np.uint32(0xEDB88320), np.uint32(0))
    return values


@cache
def _shift_tables() -> np.ndarray:
    """[n, k, b]: the register that holds byte b at place k, after n zero bytes."""
    step = _byte_table()
    values = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    tables = [values]
    for _ in range(_TABLE_LENGTHS):
        values = (values >> np.uint32(8)) ^ step[values & 255]
        tables.append(values)
    return np.array(tables)


def _blank_after(crcs: np.ndarray) -> np.ndarray:
    """crc32 of the texts with a blank appended."""
    inner = ~crcs
    return ~((inner >> np.uint32(8)) ^ _byte_table()[(inner ^ np.uint32(32)) & np.uint32(255)])


def _joined(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of left texts followed by right ones of these lengths."""
    tables, out, rest = _shift_tables(), left, lengths
    while True:
        n = np.minimum(rest, _TABLE_LENGTHS)
        out = (
            tables[n, 0, out & 255]
            ^ tables[n, 1, (out >> np.uint32(8)) & 255]
            ^ tables[n, 2, (out >> np.uint32(16)) & 255]
            ^ tables[n, 3, out >> np.uint32(24)]
        )
        rest = rest - n
        if not rest.any():
            return out ^ right


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def feature_buckets(words: list[bytes], buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the features that start at each word, in arrays of bounded length."""
    for start in range(0, len(words), SLICE_WORDS):
        some = words[start : start + SLICE_WORDS + LONGEST - 1]
        crcs = np.fromiter(map(crc32, some), np.uint32, len(some))
        lengths = np.fromiter(map(len, some), np.int64, len(some))
        run = crcs
        yield run[:SLICE_WORDS] % buckets
        for n in range(1, LONGEST):
            if len(some) <= n:
                break
            run = _joined(_blank_after(run[: len(some) - n]), crcs[n:], lengths[n:])
            yield run[:SLICE_WORDS] % buckets


def n_features(words: int) -> int:
    return sum(max(0, words - n) for n in range(LONGEST))


def _count(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for _, text in rows_of(batches):
            for part in feature_buckets(words_of(text), buckets):
                counts += np.bincount(part, minlength=buckets)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there])], schema=schema)

    return count


def bucket_counts(texts: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; a task gives one partial sum for each bucket, and Spark adds them."""
    counted = (
        id_and_text(texts, id_col, text_col)
        .mapInArrow(_count(buckets), "bucket int, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
    )
    counts = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():
        counts[bucket] = n
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of the B buckets, in doubles."""
    n = len(source)
    all_source, all_target = float(int(source.sum()) + n), float(int(target.sum()) + n)
    return np.array(
        [
            math.floor(1000.0 * math.log(float(t + 1) * all_source / (float(s + 1) * all_target)))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def gumbel(doc_id: int | None, seed: int) -> int:
    number = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((number + 0.5) / 4294967296.0)))


def _score(gains: np.ndarray, seed: int):
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_features", "weight", "score")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in rows_of([batch]):
                words = words_of(text)
                weight = sum(int(gains[part].sum()) for part in feature_buckets(words, len(gains)))
                rows.append((doc_id, len(words), n_features(len(words)), weight, weight + gumbel(doc_id, seed)))
            yield arrow_rows(schema, rows)

    return score


# Sorting by regular sampling. A key is (minus score, id, row); rows differ, so no key repeats.

_KEY = np.dtype([("low", "<i8"), ("id", "<i8"), ("row", "<i8")])
_LAST_ID = np.iinfo(np.int64).max


def _ordered(keys: np.ndarray) -> np.ndarray:
    return keys[np.lexsort((keys["row"], keys["id"], keys["low"]))]


def _place(keys: np.ndarray, splitter: np.void) -> int:
    """How many sorted keys come before the splitter."""
    low, high = 0, len(keys)
    for name in _KEY.names:
        part = keys[name][low:high]
        low, high = low + np.searchsorted(part, splitter[name], "left"), low + np.searchsorted(part, splitter[name], "right")
    return int(low)


def _sort_runs(run_rows: int):
    schema = pa.schema([("run", pa.int64()), ("keys", pa.binary())])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def run() -> pa.RecordBatch:
            keys = _ordered(np.concatenate(held))
            return arrow_rows(schema, [(int(keys["row"][0]), keys.tobytes())])

        for batch in batches:
            score, doc_id, row = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for start in range(0, len(row), run_rows):
                keys = np.empty(len(row[start : start + run_rows]), _KEY)
                keys["low"], keys["id"], keys["row"] = (c[start : start + run_rows] for c in (-score, doc_id, row))
                held.append(keys)
                n += len(keys)
                if n >= run_rows:
                    yield run()
                    held, n = [], 0
        if held:
            yield run()

    return sort


def _sample(stride: int):
    schema = pa.schema([("low", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, keys in rows_of(batches):
            # Runs begin at different places, so that short ones are sampled in proportion.
            start = crc32(str(number).encode()) % stride
            some = np.frombuffer(keys, _KEY)[start::stride]
            yield pa.RecordBatch.from_arrays([pa.array(some[n]) for n in _KEY.names], schema=schema)

    return sample


def _cut(splitters: np.ndarray):
    schema = pa.schema([("segment", pa.int32()), ("n", pa.int64()), ("keys", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buffer in rows_of(batches):
            keys = np.frombuffer(buffer, _KEY)
            edges = [0, *(_place(keys, s) for s in splitters), len(keys)]
            parts = [
                (number, b - a, keys[a:b].tobytes())
                for number, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
                if b > a
            ]
            yield arrow_rows(schema, parts)

    return cut


def _merge(before: dict[int, int], drawn: int) -> Callable:
    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys = _ordered(np.concatenate([np.frombuffer(b, _KEY) for b in group["keys"]]))
        first = before[int(key[0])]
        keys = keys[: max(0, drawn - first)]
        return pd.DataFrame({"row_id": keys["row"], "rank": first + 1 + np.arange(len(keys), dtype=np.int64)})

    return merge


def top_ranks(
    scored: DataFrame, drawn: int, n: int, run_rows: int = RUN_ROWS, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """(row_id, rank) of the ``drawn`` first of n rows by score descending, then doc_id, then row_id.

    ``scored`` holds score, doc_id (nulls last) and a unique row_id. Segments beyond the last drawn rank are
    counted but not exchanged.
    """
    spark = scored.sparkSession
    keys = scored.select("score", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("doc_id"), "row_id")
    runs = cut_lineage(keys.mapInArrow(_sort_runs(run_rows), "run long, keys binary"), "sorted-runs")
    stride = max(LEAST_STRIDE, -(-n // SAMPLES))
    segments = max(buckets_of(spark), -(-n // segment_rows))
    samples = runs.mapInArrow(_sample(stride), "low long, id long, row long").collect()
    samples = _ordered(np.array([tuple(r) for r in samples], _KEY))
    places = np.unique(np.linspace(0, len(samples), segments + 1).astype(int)[1:-1])
    splitters = samples[places[places < len(samples)]]
    cut = cut_lineage(runs.mapInArrow(_cut(splitters), "segment int, n long, keys binary"), "segments")
    sizes = dict(cut.groupBy("segment").agg(F.sum("n")).collect())
    before, total = {}, 0
    for number in sorted(sizes):
        before[number] = total
        total += sizes[number]
    last = max((s for s, first in before.items() if first < drawn), default=-1)
    return (
        cut.filter(F.col("segment") <= last)
        .groupBy("segment")
        .applyInPandas(_merge(before, drawn), "row_id long, rank long")
    )


def resample_to_target(
    documents: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    run_rows: int = RUN_ROWS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight, score and rank (null: not drawn).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text with A-Z lower-cased. The highest
    ``percent`` of a hundred scores, rounded down, of the documents with at least ``min_words`` words are
    drawn, ties to the smaller id, null ids last. Null and empty texts have no words and a weight
    of 0. Rows that share an id are documents each, ranked in no fixed order if their texts are equal too. Without
    a target text the gains favour what is rare in the documents. Other columns are not read. An
    empty table gives an empty result.
    """
    source = bucket_counts(documents, id_col, text_col, buckets)
    wanted = bucket_counts(
        target.select(F.lit(0).alias("doc_id"), F.col(f"`{target_text_col}`").alias("text")), "doc_id", "text", buckets
    )
    gains = bucket_gains(source, wanted)
    scored = id_and_text(documents, id_col, text_col).mapInArrow(
        _score(gains, seed), "doc_id long, n_words long, n_features long, weight long, score long"
    )
    scored = cut_lineage(scored.withColumn("row_id", F.monotonically_increasing_id()), "scored")
    able = scored.filter(F.col("n_words") >= min_words)
    n = able.count()
    drawn = percent * n // 100
    if drawn == 0:
        return scored.withColumn("rank", F.lit(None).cast("long")).drop("row_id")
    ranks = top_ranks(able, drawn, n, run_rows, segment_rows)
    return scored.join(ranks, "row_id", "left").drop("row_id")
