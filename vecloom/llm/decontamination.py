"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are compared as token sequences. A token run of ``min_match``
words that a document shares with an item seeds a pair. The pair is then tiled: running
Karp-Rabin, starting from the longest seeded match and going down, marks the longest
matches of unmarked tokens in both texts, until none of ``min_match`` tokens is left. Tiles
do not overlap but may come in any order, so a passage that was reordered is covered as
well as one that was copied. A document is contaminated by an item if its tiles cover
``coverage`` of the item.

The seeds of the benchmark are sent to the tasks in blocks of a checked size; a benchmark
of more seeds is compared block by block, each block against all documents. Items are never
split between blocks, and documents are never shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.packed import arrow_rows, as_bytes, id_and_text, rows_of, small_slices

MIN_MATCH = 5
COVERAGE = 0.5
#: Bound of the benchmark tokens that one broadcast holds.
BLOCK_TOKENS = 500_000

_OUTER = b".,;:!?\"'()[]{}<>*#%&$-_~"
_PAIRS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("row", pa.int64()),
        ("item_id", pa.int64()),
        ("item_tokens", pa.int64()),
        ("covered", pa.int64()),
        ("tiles", pa.list_(pa.struct([("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())]))),
    ]
)
_PAIRS_DDL = (
    "doc_id long, row long, item_id long, item_tokens long, covered long, "
    "tiles array<struct<item_start: long, doc_start: long, length: long>>"
)


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, outer ASCII punctuation stripped; words of nothing else go."""
    return [t for w in (text or b"").lower().split() if (t := w.strip(_OUTER))]


class BenchmarkBlock:
    """Items as token numbers, and an index of their ``width``-token runs."""

    def __init__(self, items: list[tuple[int, bytes]], min_match: int):
        self.min_match = min_match
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        self.seeds: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = {}
        for item_id, text in items:
            tokens = tokens_of(text)
            ids = [self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens]
            if not ids:
                continue
            width = min(min_match, len(ids))
            index = self.seeds.setdefault(width, {})
            for at in range(len(ids) - width + 1):
                index.setdefault(tuple(ids[at : at + width]), []).append((len(self.items), at))
            self.items.append((item_id, np.array(ids, np.int64)))
        self.hashed = {width: self._hash_all(width, index) for width, index in self.seeds.items()}

    @staticmethod
    def roll(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """Karp-Rabin values of the runs of ``width`` token numbers at ``starts``."""
        value = np.zeros(len(starts), np.uint64)
        for k in range(width):
            value = value * np.uint64(0x9E3779B97F4A7C15) + ids[starts + k].astype(np.uint64)
        return value

    def _hash_all(self, width: int, index: dict) -> np.ndarray:
        runs = np.array(list(index), np.int64)
        return np.unique(self.roll(runs.ravel(), np.arange(len(runs)) * width, width))

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(t, 0) for t in tokens], np.int64)

    def seed_hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For every item that shares a seed: (item position, document position)."""
        hits: dict[int, list[tuple[int, int]]] = {}
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for width, index in self.seeds.items():
            # Only runs of benchmark words can be seeds, and most texts have few of them.
            starts = np.flatnonzero(known[width:] - known[:-width] == width) if len(ids) >= width else known[:0]
            if not len(starts):
                continue
            value, hashed = self.roll(ids, starts, width), self.hashed[width]
            found = hashed[np.minimum(np.searchsorted(hashed, value), len(hashed) - 1)] == value
            for at in starts[found].tolist():
                for item, pos in index.get(tuple(ids[at : at + width].tolist()), ()):
                    hits.setdefault(item, []).append((pos, at))
        return hits

    def contaminates(self, ids: np.ndarray, min_match: int, coverage: float) -> bool:
        return any(
            sum(t[2] for t in tile(own, ids, seeds, min_match)) >= needed(len(own), coverage)
            for item, seeds in self.seed_hits(ids).items()
            for own in [self.items[item][1]]
        )


def needed(item_tokens: int, coverage: float) -> int:
    """Fewest covered tokens that contaminate."""
    return math.ceil(coverage * item_tokens - 1e-9)


def tile(item: np.ndarray, doc: np.ndarray, seeds: list[tuple[int, int]], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of one pair: (item start, document start, length), longest first.

    Ties go to the smallest item position, then the smallest document position.
    """
    min_match = min(min_match, len(item))
    free_item = np.ones(len(item) + 1, bool)
    free_item[-1] = False
    taken: set[int] = set()
    tiles = []
    # Matches start where no longer one starts on the same diagonal a token earlier.
    seeded = set(seeds)
    starts = sorted(s for s in seeded if (s[0] - 1, s[1] - 1) not in seeded)
    pending = []
    for p, d in starts:
        length = min_match
        while p + length < len(item) and d + length < len(doc) and item[p + length] == doc[d + length]:
            length += 1
        pending.append((-length, p, d))
    # Running down the lengths: a match that lost tokens to a longer tile comes back with the free
    # stretches that are left of it.
    heapq.heapify(pending)
    while pending:
        negative, p, d = heapq.heappop(pending)
        length = -negative
        blocked = [k for k in range(length) if not free_item[p + k] or d + k in taken]
        if not blocked:
            tiles.append((p, d, length))
            free_item[p : p + length] = False
            taken.update(range(d, d + length))
            continue
        edge = 0
        for stop in [*blocked, length]:
            if stop - edge >= min_match:
                heapq.heappush(pending, (edge - stop, p + edge, d + edge))
            edge = stop + 1
    return tiles


def _tile_documents(block, min_match: int):
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value
        for batch in batches:
            out = []
            for doc_id, row, text in rows_of([batch]):
                ids = known.numbers(tokens_of(text))
                for item, seeds in sorted(known.seed_hits(ids).items()):
                    item_id, own = known.items[item]
                    found = tile(own, ids, seeds, min_match)
                    spans = [dict(zip(("item_start", "doc_start", "length"), t, strict=True)) for t in found]
                    out.append((doc_id, row, item_id, len(own), sum(t[2] for t in found), spans))
            yield arrow_rows(_PAIRS, out)

    return tiles


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_tokens: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about ``block_tokens`` tokens; only one block is on the driver at a time."""
    items = id_and_text(benchmark, id_col, text_col).filter("doc_id is not null and text is not null")
    size = F.size(F.split(F.col("text").cast("string"), r"\s+"))
    sized = items.select("doc_id", "text", size.cast("long").alias("n"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_tokens))
    for number in range(blocks):
        part = sized.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == number)
        yield [(r.doc_id, bytes(r.text)) for r in part.orderBy("doc_id", "text").toLocalIterator()]


def contaminated_pairs(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Per document and item at or above ``coverage``: doc_id, row, item_id, item_tokens, covered, tiles.

    Tokens are words with A-Z lower-cased and outer ASCII punctuation stripped. An item of fewer
    than ``min_match`` tokens must occur whole. ``row`` is a digest of id and text and tells
    rows of one id apart.

    Null and empty texts and items match nothing; items with a null id are not used; documents
    with a null id are compared and reported with it. Repeated rows and items are reported
    each. Other columns are not read. Empty tables give an empty result.
    """
    spark = documents.sparkSession
    docs = id_and_text(documents, id_col, text_col).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    found = [
        docs.mapInArrow(
            _tile_documents(spark.sparkContext.broadcast(BenchmarkBlock(items, min_match)), min_match), _PAIRS_DDL
        )
        for items in benchmark_blocks(benchmark, item_id_col, item_text_col, block_tokens)
    ]
    return reduce(DataFrame.union, found).filter(F.col("covered") >= F.ceil(F.lit(coverage) * F.col("item_tokens") - 1e-9))


def decontamination_report(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per contaminated pair, the share of the item that is covered, and its rank in the document."""
    order = Window.partitionBy("doc_id", "row").orderBy(F.desc("coverage"), "item_id")
    return (
        contaminated_pairs(documents, benchmark, **options)
        .withColumn("coverage", F.col("covered") / F.col("item_tokens"))
        .withColumn("n_tiles", F.size("tiles"))
        .withColumn("item_rank", F.row_number().over(order))
    )


def _keep_clean(block, min_match: int, coverage: float, text_col: str):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value
        for batch in small_slices(batches, text_col):
            clean = [
                not known.contaminates(known.numbers(tokens_of(text)), min_match, coverage)
                for text in as_bytes(batch.column(text_col))
            ]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return keep


def clean_documents(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The rows of ``documents``, all columns, that no item contaminates; one pass, no shuffle."""
    spark = documents.sparkSession
    left = documents
    for items in benchmark_blocks(benchmark, item_id_col, item_text_col, block_tokens):
        block = spark.sparkContext.broadcast(BenchmarkBlock(items, min_match))
        left = left.mapInArrow(_keep_clean(block, min_match, coverage, text_col), documents.schema)
    return left
