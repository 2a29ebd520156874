"""Substring dedup: words covered by a token window that an earlier document also has.

Every window of ``width`` consecutive words gets a Rabin-Karp hash. The hashes go to
buckets in one packed exchange, eight bytes a window; a bucket finds, for each hash, the
smallest document id, and sends later documents the hashes they repeat, packed by groups
of documents. A document then recomputes its own hashes and merges the repeated windows into maximal removal
intervals.

A hash has 64 bits; two different windows among w share one with probability about
w**2 / 2**65 in all, and a single window is wrongly removed with about w / 2**64.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.packed import (
    CHUNK_WORDS,
    RollingHash,
    arrow_rows,
    buckets_of,
    by_bucket,
    crc_mod,
    id_and_text,
    joined,
    rows_of,
    runs,
    word_keys,
)

WINDOW_WORDS = 13

_PACKED = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept", pa.string()),
    ]
)


def _pack(width: int, buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash()
        ids, keys, gathered = [], [], 0

        def flush() -> pa.RecordBatch:
            all_keys = np.concatenate(keys)
            all_ids = np.repeat(np.array(ids, np.int64), [len(k) for k in keys])
            order, there, starts = by_bucket(all_keys, buckets)
            all_keys, all_ids = all_keys[order], all_ids[order]
            out = []
            for number, start, end in zip(there.tolist(), starts[:-1], starts[1:], strict=True):
                values, lengths = runs(all_ids[start:end])
                out.append((number, values.tobytes(), lengths.tobytes(), all_keys[start:end].tobytes()))
            return arrow_rows(_PACKED, out)

        for doc_id, text in rows_of(batches):
            if doc_id is None or not text:
                continue
            windows = roll.windows(word_keys(text.split()), width)
            if len(windows):
                ids.append(doc_id)
                keys.append(windows)
                gathered += len(windows)
                if gathered >= CHUNK_WORDS:
                    yield flush()
                    ids, keys, gathered = [], [], 0
        if keys:
            yield flush()

    return pack


def _repeats(groups: int):
    def repeats(bucket: pd.DataFrame) -> pd.DataFrame:
        """The windows that a document with a smaller id has too, packed by document group."""
        keys = joined(bucket["keys"], np.uint64)
        ids = np.repeat(joined(bucket["ids"], np.int64), joined(bucket["counts"], np.uint32))
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        first = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.append(starts, len(keys))))
        later = ids > first
        keys, ids = keys[later], ids[later]
        there, inverse = np.unique(ids, return_inverse=True)
        group = np.array([zlib.crc32(b"%d" % i) % groups for i in there.tolist()], np.int64)[inverse]
        order = np.lexsort((ids, group))
        keys, ids, group = keys[order], ids[order], group[order]
        out = []
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))[: len(group)]
        for start, end in zip(starts, [*starts[1:], len(group)], strict=True):
            values, lengths = runs(ids[start:end])
            out.append((group[start], values.tobytes(), lengths.tobytes(), keys[start:end].tobytes()))
        return pd.DataFrame(out, columns=["doc_group", "ids", "counts", "keys"])

    return repeats


def covered(hit: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Which words lie in a window that is hit."""
    edge = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(width: int):
    def cut(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        roll = RollingHash()
        packed = {name: repeats.column(name).to_pylist() for name in ("ids", "counts", "keys")}
        keys, ids = joined(packed["keys"], np.uint64), joined(packed["ids"], np.int64)
        ids = np.repeat(ids, joined(packed["counts"], np.uint32))
        order = np.argsort(ids, kind="stable")
        keys = keys[order]
        there, lengths = runs(ids[order])
        ends = np.cumsum(lengths, dtype=np.int64)
        repeated = {i: keys[e - n : e] for i, e, n in zip(there.tolist(), ends, lengths, strict=True)}
        out = []
        for doc_id, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
            words = (text or b"").split()
            spans = []
            kept = words
            if doc_id in repeated:
                own = roll.windows(word_keys(words), width)
                gone = covered(np.isin(own, repeated[doc_id]), width, len(words))
                kept = [word for word, out_ in zip(words, gone.tolist(), strict=True) if not out_]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
            out.append((doc_id, len(words), len(words) - len(kept), spans, b" ".join(kept).decode("utf-8", "replace")))
        return pa.Table.from_batches([arrow_rows(_RESULT, out)])

    return cut


def substring_dedup(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW_WORDS
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, spans (word intervals removed) and kept (text).

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of ``width`` words that covers
    it also starts in a document with a smaller id; windows are judged on the input.

    Null or empty text: no words, nothing removed. Null id: never a source of repeats and
    left whole. Rows that share an id count as one document for "smaller", so a repeat
    between them is no repeat. Documents of fewer than ``width`` words lose nothing. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    docs = id_and_text(documents, id_col, text_col)
    buckets = buckets_of(spark)
    repeated = (
        docs.mapInArrow(_pack(width, buckets), "bucket int, ids binary, counts binary, keys binary")
        .groupBy("bucket")
        .applyInPandas(_repeats(buckets), "doc_group long, ids binary, counts binary, keys binary")
    )
    docs = docs.withColumn("doc_group", F.coalesce(crc_mod(F.col("doc_id"), buckets), F.lit(0)).cast("long"))
    return (
        docs.groupBy("doc_group")
        .cogroup(repeated.groupBy("doc_group"))
        .applyInArrow(
            _cut(width),
            "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string",
        )
    )
