"""Text to vectors: the seam for a caller's model and the built-in offline vectoriser."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, IDFModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.text import (
    EMBED_PREFIX,
    content_tokens,
    english_stop_words,
    is_blank,
    truncate_plain,
)

try:  # CPython's own is twice as fast on short texts as the one of OpenSSL
    from _md5 import md5
except ImportError:
    from hashlib import md5

# Fixed value: texts per request to a caller's model.
REQUEST_ROWS = 10
#: Words whose terms are counted at a time, unless one text has more.
SLICE_WORDS = 500_000

EmbedBatch = Callable[[list[str]], Sequence[Sequence[float]]]


def embed_input(
    df: DataFrame, text: str = "structured_summary", prefix: str = "", limit: int | None = None
) -> DataFrame:
    """Rows with something to embed and the exact text to be embedded."""
    source = F.col(text) if limit is None else truncate_plain(F.col(text), limit)
    return df.filter(~is_blank(F.col(text))).withColumn(
        "embed_text", F.concat(F.lit(prefix), source) if prefix else source
    )


def prefixed_input(df: DataFrame, text: str = "structured_summary") -> DataFrame:
    return embed_input(df, text, EMBED_PREFIX)


def embed_with(
    df: DataFrame, embed: EmbedBatch, text: str = "embed_text", request_rows: int = REQUEST_ROWS
) -> DataFrame:
    """Vectors from a caller's function: (item_id, embedding, error).

    Filters belong before this call. A request that fails leaves the vectors of its own
    rows NULL with the error text; nothing shifts, because every vector stays with its
    key. Parallelism is the number of partitions.
    """
    schema = "item_id long, embedding array<float>, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), request_rows):
                part = frame.iloc[start : start + request_rows]
                vectors: list = [None] * len(part)
                error = None
                try:
                    got = embed(part[text].tolist())
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                    vectors = [None if v is None else [float(x) for x in v] for v in got]
                except Exception as failure:  # a failed request must not fail the job
                    error = f"{type(failure).__name__}: {failure}"
                yield pd.DataFrame(
                    {"item_id": part["item_id"].to_numpy(), "embedding": vectors, "error": error}
                )

    return df.select("item_id", text).mapInPandas(run, schema)


@dataclass(frozen=True)
class HashedVectoriser:
    """Hashed words and word pairs, weighted by rarity, scaled to unit length."""

    dimensions: int
    idf: IDFModel
    stop_words: tuple[str, ...]

    def transform(self, df: DataFrame, text: str = "embed_text") -> DataFrame:
        """Add ``embedding``; NULL where the text has no known term."""
        weighted = self.idf.transform(_term_vectors(df, text, self.dimensions, self.stop_words))
        unit = Normalizer(p=2.0, inputCol="__weighted", outputCol="__unit").transform(weighted)
        values = vector_to_array("__unit", "float32")
        some = F.exists(values, lambda x: x != 0)
        return unit.withColumn("embedding", F.when(some, values)).drop(
            "__tf", "__weighted", "__unit"
        )

    @property
    def settings(self) -> dict:
        return {"dimensions": self.dimensions, "stop_words": self.stop_words}


def term_buckets(terms: list[bytes], dimensions: int) -> np.ndarray:
    """The dimension of each term: the first 32 bits of its MD5 digest, modulo the dimensions."""
    digests = b"".join([md5(term).digest() for term in terms])
    return np.frombuffer(digests, ">u4")[::4].astype(np.int64) % dimensions


def _bytes_of(terms: pa.LargeBinaryArray) -> list[bytes]:
    """As ``to_pylist``, which takes ten times as long."""
    _, offsets, data = terms.buffers()
    edges = np.frombuffer(offsets, np.int64, len(terms) + 1, terms.offset * 8).tolist()
    data = data.to_pybytes() if data is not None else b""
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def count_terms(words: pa.ListArray, dimensions: int) -> np.ndarray:
    """Words and neighbouring word pairs of each list by dimension (lists × dimensions).

    A digest is taken once for each distinct word and pair.
    """
    sizes = np.asarray(words.value_lengths().fill_null(0), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    coded = words.flatten().dictionary_encode()
    distinct, code = coded.dictionary.cast(pa.large_binary()), np.asarray(coded.indices, dtype=np.int64)
    buckets = term_buckets(_bytes_of(distinct), dimensions)
    inside = np.flatnonzero(row[1:] == row[:-1])
    pairs, place = np.unique(code[inside] * len(distinct) + code[inside + 1], return_inverse=True)
    halves = [distinct.take(pa.array(part)) for part in np.divmod(pairs, max(len(distinct), 1))]
    joined = pc.binary_join_element_wise(*halves, pa.scalar(b" ", pa.large_binary()))
    pair_buckets = term_buckets(_bytes_of(joined), dimensions)
    places = np.concatenate([row * dimensions + buckets[code], row[inside] * dimensions + pair_buckets[place]])
    return np.bincount(places, minlength=len(sizes) * dimensions).reshape(len(sizes), dimensions)


def _term_counts(words: Column, dimensions: int) -> Column:
    @F.arrow_udf("array<double>")
    def count_by_md5(lists: pa.Array) -> pa.Array:
        ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64))
        found, start = [np.zeros((0, dimensions))], 0
        while start < len(lists):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_WORDS, side="right")))
            found.append(count_terms(lists[start:stop], dimensions).astype(np.float64))
            start = stop
        offsets = np.arange(len(lists) + 1, dtype=np.int32) * dimensions
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).ravel()))

    return count_by_md5(words)


def _term_vectors(df: DataFrame, text: str, dimensions: int, stop_words: Sequence[str]) -> DataFrame:
    words = content_tokens(F.coalesce(F.col(text), F.lit("")), stop_words)
    return df.withColumn("__tf", array_to_vector(_term_counts(words, dimensions)))


def fit_vectoriser(
    df: DataFrame,
    text: str = "embed_text",
    dimensions: int = 256,
    stop_words: Sequence[str] | None = None,
) -> HashedVectoriser:
    """Learn term rarities over all texts; the model has ``dimensions`` numbers."""
    stop = tuple(english_stop_words() if stop_words is None else stop_words)
    idf = IDF(inputCol="__tf", outputCol="__weighted").fit(
        _term_vectors(df.select(text), text, dimensions, stop)
    )
    return HashedVectoriser(dimensions, idf, stop)


def embed_documents(df: DataFrame, text: str = "embed_text", dimensions: int = 256) -> DataFrame:
    """Fit the offline vectoriser on ``df`` and embed every row with it."""
    return fit_vectoriser(df, text, dimensions).transform(df, text)
