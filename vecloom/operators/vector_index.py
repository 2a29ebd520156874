"""A stored inverted file with product codes: built once, extended, and searched from disk.

The index is a folder of three tables. ``model`` holds the coarse centres and the codebooks, ``cells`` the
items, partitioned by the cell of their nearest centre: id, title, unit vector, and a code of one byte for each
part of what the centre leaves of the vector. A search reads codes only of the cells that are probed,
ranks items by the similarity that their codes give, and compares the best with their true vectors.

Centres and codebooks are fitted on a bounded sample by hash; every item is indexed. Items can be added
without fitting again. Queries are a table of any length. Blocks of queries meet blocks of many cells' codes, where each
query keeps the best of all cells that it probes; what moves between tasks are vectors and lists, not pairs with vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.functions.vector import as_double, dot, unit
from vecloom.operators.neighbours import SIMILARITY_DECIMALS, STRIP_VALUES, _near_order
from vecloom.operators.relational import top_n_per_group
from vecloom.operators.tiles import matrix_of
from vecloom.session import cut_lineage

#: Vectors that the model is fitted on at most, and for each cell at least if there are as many.
SAMPLE_ROWS = 16_384
SAMPLE_PER_CELL = 32
LEAST_CELLS, MOST_CELLS = 16, 4096
#: A quarter of the cells are probed if ``probes`` is not given.
PROBED_SHARE = 4
PARTS = 8
CODEWORDS = 256
FIT_ROUNDS = 20
#: Candidates by codes for each neighbour asked for that are compared with their vectors.
REFINE = 20
BLOCK_ROWS = 8192
#: Queries that are ranked together, and blocks of them at least that are sent to tasks if there are enough.
STRIP_QUERIES = 4096
ASK_BLOCKS = 16
#: Items whose codes one task holds at most, and numbers of a block of vectors, of either side, that one task compares.
HOLD_ROWS = 1_000_000
BLOCK_VALUES = 8_000_000
#: Scores that a task keeps before it drops all but the best, and pairs of vectors that it holds at a time.
PENDING = 4_000_000
PAIR_ROWS = 50_000
#: Cells of a query that are ranked first, to know what the others have to reach.
FIRST_CELLS = 2
SEED = 42

_CELLS = "item_id long, title string, u array<double>, code binary, cell int"
_MODEL = "kind string, part int, number int, vector array<double>"
_LISTS = "strip int, query_id binary, cell binary, item_id binary, score binary"
_WANTED = "strip int, hold int, query_id binary, cell binary, item_id binary, times binary"
_EXACT = "query_id long, cell int, item_id long, title_key long, similarity double"


@dataclass(frozen=True)
class IndexModel:
    """Coarse centres, and the codewords of each part of the vectors."""

    centres: np.ndarray
    codebooks: tuple[np.ndarray, ...]

    @property
    def edges(self) -> list[int]:
        return np.cumsum([0] + [book.shape[1] for book in self.codebooks]).tolist()

    def nearest_cells(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, the nearest first."""
        square, cells = (self.centres**2).sum(axis=1)[None, :], len(self.centres)

        def nearest(gap: np.ndarray) -> np.ndarray:
            if n == 1:
                return gap.argmin(axis=1)[:, None]
            some = np.sort(np.argpartition(gap, n - 1, axis=1)[:, :n], axis=1) if n < cells else np.arange(cells)[None, :].repeat(len(gap), 0)
            return np.take_along_axis(some, np.argsort(np.take_along_axis(gap, some, 1), axis=1, kind="stable"), 1)

        found = [nearest(square - 2.0 * (part @ self.centres.T)).astype(np.int32) for part in _strips(x, cells)]
        return np.concatenate(found) if found else np.zeros((0, min(n, len(self.centres))), np.int32)

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """One byte a part: the codeword nearest to what the cell's centre leaves."""
        rest, edges = x - self.centres[cells], self.edges
        return np.stack(
            [_nearest(rest[:, a:b], book) for a, b, book in zip(edges[:-1], edges[1:], self.codebooks, strict=True)], axis=1
        ).astype(np.uint8)

    def similarities(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Products of queries with the vectors that the codes of a cell's items stand for."""
        return queries @ self.decoded(cell, codes).T.astype(queries.dtype)

    def decoded(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that the codes of a cell's items stand for."""
        return self.centres[cell] + np.concatenate([book[codes[:, part]] for part, book in enumerate(self.codebooks)], axis=1)


def _strips(x: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Parts of x whose distances to ``width`` centres are at most STRIP_VALUES numbers."""
    rows = max(1, STRIP_VALUES // max(width, 1))
    return (x[start : start + rows] for start in range(0, len(x), rows))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres**2).sum(axis=1)[None, :]
    found = [(square - 2.0 * (part @ centres.T)).argmin(axis=1) for part in _strips(x, len(centres))]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _fit(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of a sample: Lloyd's steps from drawn rows; a centre that loses its rows takes the farthest one."""
    draw = np.random.default_rng(seed)
    centres = x[draw.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        near = _nearest(x, centres)
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        moved = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
        empty = np.flatnonzero(size == 0)
        if len(empty):
            gap = ((x - moved[near]) ** 2).sum(axis=1)
            moved[empty] = x[np.argsort(-gap, kind="stable")[: len(empty)]]
        if np.allclose(moved, centres, rtol=0, atol=1e-9):
            break
        centres = moved
    return centres


def _units(df: DataFrame, column: str, *names: str) -> DataFrame:
    return df.select(*names, unit(as_double(F.col(f"`{column}`"))).alias("u")).filter(F.col("u").isNotNull())


def fit_model(units: DataFrame, cells: int | None = None, parts: int = PARTS, seed: int = SEED) -> IndexModel:
    """Centres and codebooks of unit vectors ``u``, from the SAMPLE_ROWS (or SAMPLE_PER_CELL a cell) of least hash.

    Without ``cells`` there are about four times the square root of the rows, 16 to 4096.
    """
    n = units.count()
    if not n:
        raise ValueError("no vectors to fit an index on")
    cells = cells or min(MOST_CELLS, max(LEAST_CELLS, round(4 * n**0.5)))
    rows = max(SAMPLE_ROWS, SAMPLE_PER_CELL * cells)
    sample = units.select("u").orderBy(F.xxhash64("u", F.lit(seed)), "u").limit(rows).toArrow()
    x = matrix_of(sample, "u")
    centres = _fit(x, cells, seed)
    rest = x - centres[_nearest(x, centres)]
    edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    return IndexModel(centres, tuple(_fit(rest[:, a:b], CODEWORDS, seed) for a, b in zip(edges[:-1], edges[1:], strict=True)))


def _write_model(spark: SparkSession, model: IndexModel, path: str) -> None:
    rows = [("centre", 0, i, c.tolist()) for i, c in enumerate(model.centres)]
    rows += [("codeword", p, i, w.tolist()) for p, book in enumerate(model.codebooks) for i, w in enumerate(book)]
    spark.createDataFrame(rows, _MODEL).coalesce(1).write.parquet(f"{path}/model")


def read_model(spark: SparkSession, path: str) -> IndexModel:
    rows = spark.read.schema(_MODEL).parquet(f"{path}/model").collect()
    parts: dict[tuple[str, int], list] = {}
    for kind, part, _, vector in sorted((r.kind, r.part, r.number, r.vector) for r in rows):
        parts.setdefault((kind, part), []).append(vector)
    centres = np.array(parts.pop(("centre", 0)))
    return IndexModel(centres, tuple(np.array(parts[key]) for key in sorted(parts)))


def _encode(model: IndexModel):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            x = matrix_of(table, "u")
            cells = model.nearest_cells(x, 1)[:, 0]
            codes = pa.array([row.tobytes() for row in model.codes(x, cells)], pa.binary())
            yield from table.append_column("code", codes).append_column("cell", pa.array(cells)).to_batches()

    return encode


def _store(units: DataFrame, model: IndexModel, path: str, mode: str) -> None:
    # Dealing by ranges reads its input twice.
    placed = cut_lineage(units.mapInArrow(_encode(model), _CELLS), "encoded")
    # A cell of any size is as many tasks as it fills, and a small one is one file, not several.
    placed = placed.repartitionByRange("cell", F.xxhash64("item_id"))
    placed.write.mode(mode).partitionBy("cell").parquet(f"{path}/cells")


def build_index(
    df: DataFrame, path: str, cells: int | None = None, parts: int = PARTS, column: str = "embedding", seed: int = SEED
) -> IndexModel:
    """Fits a model on a bounded sample and stores every item with a vector below ``path``.

    ``df`` has item_id, title and the vectors; null and zero vectors are left out.
    """
    units = cut_lineage(_units(df, column, "item_id", "title"), "units")
    model = fit_model(units, cells, parts, seed)
    _write_model(df.sparkSession, model, path)
    _store(units, model, path, "errorifexists")
    return model


def stored_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_CELLS).parquet(f"{path}/cells")


def add_items(df: DataFrame, path: str, column: str = "embedding") -> None:
    """Adds the items whose ids the index does not have yet, by the stored model; each id once."""
    spark = df.sparkSession
    units = _units(df, column, "item_id", "title").dropDuplicates(["item_id"])
    new = units.join(stored_items(spark, path).select("item_id"), "item_id", "left_anti")
    # Written first, as the table that is added to is read for it.
    _store(cut_lineage(new, "added"), read_model(spark, path), path, "append")


def _probe(model: IndexModel, probes: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            cells = model.nearest_cells(matrix_of(table, "u"), probes)
            offsets = np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)
            yield from table.append_column(
                "cells", pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.ravel()))
            ).to_batches()

    return probe


class _Best:
    """The best ``n`` scores of each query, from lists that come one after another."""

    def __init__(self, queries: int, n: int) -> None:
        self.n, self.floor = n, np.full(queries, -np.inf, np.float32)
        self.rows, self.at, self.scores, self.pending = [], [], [], 0

    def add(self, rows: np.ndarray, items: np.ndarray, scores: np.ndarray) -> None:
        """Scores (rows × items); only those above what a query has ``n`` of are kept."""
        row, column = np.nonzero(scores > self.floor[rows][:, None])
        self.rows.append(rows[row])
        self.at.append(items[column])
        self.scores.append(scores[row, column])
        self.pending += len(row)
        if self.pending > PENDING:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query rows, items and scores of the best, by query."""
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        row, at, score = (np.concatenate(x) for x in (self.rows, self.at, self.scores))
        # Short numbers are sorted by their digits.
        order = np.argsort(row.astype(np.uint16) if len(self.floor) <= 1 << 16 else row, kind="stable")
        row, at, score = row[order], at[order], score[order]
        size = np.bincount(row, minlength=len(self.floor))
        start, kept = np.cumsum(size) - size, np.ones(len(row), bool)
        full = np.flatnonzero(size >= self.n)
        full = full[np.argsort(-size[full], kind="stable")]
        while len(full):
            width = size[full[0]]
            some, full = np.split(full, [max(1, PENDING // width)])
            place = np.arange(width)
            there = place < size[some][:, None]
            where = np.where(there, start[some][:, None] + place, 0)
            table = np.where(there, score[where], -np.inf)
            order = np.argpartition(-table, self.n - 1, axis=1)
            self.floor[some] = np.take_along_axis(table, order[:, self.n - 1 : self.n], 1)[:, 0]
            drop = order[:, self.n :]
            kept[np.take_along_axis(where, drop, 1)[np.take_along_axis(there, drop, 1)]] = False
        row, at, score = row[kept], at[kept], score[kept]
        self.rows, self.at, self.scores, self.pending = [row], [at], [score], len(row)
        return row, at, score


def _best_by_code(model: IndexModel, probes: int, n: int):
    """Of each strip of queries the ``n`` items of a block of cells that are best by their codes, in one row."""

    def best(queries: pa.Table, held: pa.Table) -> pa.Table:
        found = {name: [] for name in ("strip", "query_id", "cell", "item_id", "score")}
        if queries.num_rows and held.num_rows:
            held = held.sort_by([("cell", "ascending"), ("item_id", "ascending")])
            cell, ids = np.asarray(held.column("cell")), np.asarray(held.column("item_id"))
            codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(held.num_rows, -1)
            there, first = np.unique(cell, return_index=True)
            spans = np.append(first, len(cell))
            strips, x, asked = np.asarray(queries.column("strip")), matrix_of(queries, "u"), np.asarray(queries.column("query_id"))
            for strip in np.unique(strips):
                mine = np.flatnonzero(strips == strip)
                mine = mine[np.argsort(asked[mine], kind="stable")]
                near = model.nearest_cells(x[mine], probes)
                part, top = x[mine].astype(np.float32), _Best(len(mine), n)
                for some in (near[:, :FIRST_CELLS], near[:, FIRST_CELLS:]):
                    order = np.argsort(some, axis=None, kind="stable")
                    probed = some.ravel()[order]
                    edges = np.searchsorted(probed, there), np.searchsorted(probed, there, side="right")
                    for number, start, stop, a, b in zip(there, spans[:-1], spans[1:], *edges, strict=True):
                        if a == b:
                            continue
                        rows = order[a:b] // some.shape[1]
                        for at in range(start, stop, BLOCK_ROWS):
                            items = np.arange(at, min(at + BLOCK_ROWS, stop))
                            told = model.decoded(number, codes[items]).T.astype(np.float32)
                            step = max(1, STRIP_VALUES // len(items))
                            for r in range(0, len(rows), step):
                                top.add(rows[r : r + step], items, part[rows[r : r + step]] @ told)
                    top.settle()
                row, at, score = top.settle()
                columns = (strip, asked[mine][row].tobytes(), cell[at].tobytes(), ids[at].tobytes(), score.tobytes())
                for name, value in zip(found, columns, strict=True):
                    found[name].append(value)
        types = (pa.int32(), *[pa.binary()] * 4)
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(found.items(), types, strict=True)})

    return best


def _wanted_pairs(n: int, blocks: int, others: bool):
    """The ``n`` best of a strip's queries over all blocks of cells, dealt to the blocks of items' vectors.

    Rows of one query id and of one item id are told apart by their number only.
    """

    def merge(rows: pa.Table) -> pa.Table:
        kinds = {"query_id": np.int64, "cell": np.int32, "item_id": np.int64, "score": np.float32}
        query, cell, item, score = (np.frombuffer(b"".join(rows.column(c).to_pylist()), k) for c, k in kinds.items())
        if others:
            kept = query != item
            query, cell, item, score = query[kept], cell[kept], item[kept], score[kept]
        order = np.lexsort((item, -score, query))
        query, cell, item = query[order], cell[order], item[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < n
        query, cell, item = query[kept], cell[kept], item[kept]
        block = _item_block(item, blocks)
        order = np.lexsort((cell, item, query, block))
        block, query, cell, item = block[order], query[order], cell[order], item[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(query))).astype(np.int32)
        block, query, cell, item = block[at], query[at], cell[at], item[at]
        numbers, starts = np.unique(block, return_index=True)
        parts = [slice(a, b) for a, b in zip(starts, np.append(starts[1:], len(block)), strict=True)]
        strip = rows.column("strip")[0].as_py()
        columns = {"query_id": query, "cell": cell, "item_id": item, "times": times}
        return pa.table(
            {"strip": pa.array([strip] * len(parts), pa.int32()), "hold": pa.array(numbers, pa.int32())}
            | {c: pa.array([v[p].tobytes() for p in parts], pa.binary()) for c, v in columns.items()}
        )

    return merge


def _item_block(item: np.ndarray, blocks: int) -> np.ndarray:
    """Block of an item's vector, as ``F.pmod`` of its id."""
    return (item % blocks).astype(np.int32)


def _exact_best(n: int):
    """The ``n`` best pairs of each query in a block of items, and all that equal the last of them."""
    schema = pa.schema([("query_id", pa.int64()), ("cell", pa.int32()), ("item_id", pa.int64()), ("title_key", pa.int64()), ("similarity", pa.float64())])

    def best(rows: pa.Table) -> pa.Table:
        kind = np.asarray(rows.column("kind"))
        pairs = rows.filter(pa.array(kind == 0))
        queries = rows.filter(pa.array(kind == 1)).sort_by("id")
        held = rows.filter(pa.array(kind == 2)).sort_by([("cell", "ascending"), ("id", "ascending")])
        if not (pairs.num_rows and queries.num_rows and held.num_rows):
            return schema.empty_table()
        kinds = {"query_ids": np.int64, "cells": np.int32, "item_ids": np.int64, "times": np.int32}
        query, cell, item, times = (np.frombuffer(b"".join(pairs.column(c).to_pylist()), k) for c, k in kinds.items())
        asked, x = np.asarray(queries.column("id")), matrix_of(queries, "u")
        ids, cells, y = np.asarray(held.column("id")), np.asarray(held.column("cell")), matrix_of(held, "u")
        keys = np.asarray(held.column("title_key"))
        # An id may be there several times: every row of the query meets every row of the item.
        starts = np.searchsorted(cells, np.arange(cells.max() + 2))
        low, high = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        by_cell = np.argsort(cell, kind="stable")
        edges = np.searchsorted(cell[by_cell], np.arange(cells.max() + 2))
        for number in range(int(cells.max()) + 1):
            mine = by_cell[edges[number] : edges[number + 1]]
            if len(mine):
                inside = ids[starts[number] : starts[number + 1]]
                low[mine] = np.searchsorted(inside, item[mine]) + starts[number]
                high[mine] = np.searchsorted(inside, item[mine], side="right") + starts[number]
        first, last = np.searchsorted(asked, query), np.searchsorted(asked, query, side="right")
        many = (last - first) * (high - low)
        pair = np.repeat(np.arange(len(query)), many)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        wide = (high - low)[pair]
        left, right = first[pair] + place // np.maximum(wide, 1), low[pair] + place % np.maximum(wide, 1)
        similarity = np.empty(len(pair))
        for at in range(0, len(pair), PAIR_ROWS):
            part = slice(at, at + PAIR_ROWS)
            similarity[part] = np.einsum("ij,ij->i", x[left[part]], y[right[part]])
        again = np.repeat(np.arange(len(pair)), np.minimum(times[pair], n))
        told, asks = np.round(similarity, SIMILARITY_DECIMALS)[again], query[pair][again]
        order = np.lexsort((-told, asks))
        told, asks, again = told[order], asks[order], again[order]
        begin = np.searchsorted(asks, asks)
        end = np.minimum(begin + n, np.searchsorted(asks, asks, side="right")) - 1
        kept = told >= told[end]
        again, asks = again[kept], asks[kept]
        columns = (asks, cells[right[again]], ids[right[again]], keys[right[again]], similarity[again])
        return pa.table([pa.array(c) for c in columns], schema=schema)

    return best


def probed_cells(queries: DataFrame, path: str, probes: int | None = None, column: str = "embedding") -> DataFrame:
    """(query_id, u, cells): unit vectors of the queries and the cells that a search reads for them."""
    model = read_model(queries.sparkSession, path)
    probes = probes or max(1, len(model.centres) // PROBED_SHARE)
    return _units(queries, column, "query_id").mapInArrow(
        _probe(model, min(probes, len(model.centres))), "query_id long, u array<double>, cells array<int>"
    )


def search_index(
    queries: DataFrame,
    path: str,
    n: int = 5,
    probes: int | None = None,
    refine: int = REFINE,
    column: str = "embedding",
    others: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, item_id, title, similarity): about the n items most similar to each query vector.

    ``queries`` has a unique query_id and the vectors. The items of the ``probes`` nearest cells (a quarter of all if not
    given) are ranked by their codes, the best ``refine`` · n of a query by their vectors; similarities are exact.
    With ``others`` an item is not found by a query that has its id. Null and zero vectors find nothing.
    """
    spark = queries.sparkSession
    model = read_model(spark, path)
    probes = min(probes or max(1, len(model.centres) // PROBED_SHARE), len(model.centres))
    width = model.centres.shape[1]
    asked = cut_lineage(_units(queries.filter(F.col("query_id").isNotNull()), column, "query_id"), "asked")

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, rows = np.zeros(len(model.centres), bool), 0
        for batch in batches:
            for start in range(0, batch.num_rows, STRIP_QUERIES):
                part = pa.Table.from_batches([batch.slice(start, STRIP_QUERIES)])
                there[model.nearest_cells(matrix_of(part, "u"), probes).ravel()] = True
            rows += batch.num_rows
        cells = np.append(np.flatnonzero(there), -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.where(cells < 0, rows, 0))], ["cell", "rows"])

    # At most as many as the model has centres: they prune the cells' folders.
    probed = {r.cell: r.rows for r in asked.select("u").mapInArrow(cells_of, "cell int, rows long").groupBy("cell").agg(F.sum("rows").alias("rows")).collect()}
    rows = probed.pop(-1, 0)
    held = stored_items(spark, path).filter(F.col("cell").isin([*probed])).filter(F.col("item_id").isNotNull())
    counts = {r.cell: r.n for r in held.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    # Numbers of blocks divide one another, so a strip of queries lies in one block of either kind.
    ask_blocks = max(1, -(-rows * width // BLOCK_VALUES))
    parts = max(1, min(-(-rows // (ask_blocks * min(block_rows, STRIP_QUERIES))), -(-ASK_BLOCKS // ask_blocks)))
    strips = ask_blocks * parts * max(1, -(-rows // (ask_blocks * parts * STRIP_QUERIES)))
    # A block holds cells that are near to one another; items of a cell that is larger are dealt to several.
    room = max(1, min(HOLD_ROWS, max(block_rows, -(-total // 2))))
    plan, block, filled = [], -1, room
    for cell in _near_order(model.centres).tolist():
        n_cell = counts.get(cell, 0)
        subs = -(-n_cell // room)
        if subs > 1:
            plan.append((cell, block + 1, subs))
            block, filled = block + subs, room
        elif n_cell:
            if filled + n_cell > room:
                block, filled = block + 1, 0
            filled += n_cell
            plan.append((cell, block, 1))
    hold_blocks = block + 1
    blocks = F.broadcast(spark.createDataFrame(plan, "cell int, first int, subs int"))
    strip = F.pmod(F.xxhash64("query_id"), F.lit(strips).cast("long")).cast("int")
    ask = F.pmod(F.col("strip"), F.lit(ask_blocks * parts))
    asks = asked.select(
        strip.alias("strip"), F.explode(F.sequence(F.lit(0), F.lit(max(hold_blocks, 1) - 1))).alias("hold"), "query_id", "u"
    ).withColumn("ask", ask)
    holds = held.join(blocks, "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("item_id"), F.col("subs").cast("long")).cast("int")).alias("hold"),
        F.explode(F.sequence(F.lit(0), F.lit(ask_blocks * parts - 1))).alias("ask"),
        "cell",
        "item_id",
        "code",
    )
    holds = holds.toDF(*holds.columns)
    lists = (
        asks.groupBy("hold", "ask")
        .cogroup(holds.groupBy("hold", "ask"))
        .applyInArrow(_best_by_code(model, probes, refine * n + (1 if others else 0)), _LISTS)
    )
    item_blocks = max(1, -(-total * width // BLOCK_VALUES))
    wanted = cut_lineage(lists.groupBy("strip").applyInArrow(_wanted_pairs(refine * n, item_blocks, others), _WANTED), "wanted")

    def shaped(df: DataFrame, kind: int, ask: Column, hold: Column, **columns) -> DataFrame:
        names = {"id": "long", "cell": "int", "title_key": "long", "u": "array<double>", "query_ids": "binary", "cells": "binary", "item_ids": "binary", "times": "binary"}
        filled = [columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in names.items()]
        return df.select(ask.alias("ask"), hold.alias("hold"), F.lit(kind).alias("kind"), *filled)

    def every(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    of_ask = F.pmod(strip, F.lit(ask_blocks))
    title_key = F.xxhash64("title")
    met = (
        shaped(wanted, 0, F.pmod("strip", F.lit(ask_blocks)), F.col("hold"),
               query_ids=F.col("query_id"), cells=F.col("cell"), item_ids=F.col("item_id"), times=F.col("times"))
        .unionByName(shaped(asked, 1, of_ask, every(item_blocks), id=F.col("query_id"), u=F.col("u")))
        .unionByName(shaped(held, 2, every(ask_blocks), F.pmod("item_id", F.lit(item_blocks)).cast("int"),
                            id=F.col("item_id"), cell=F.col("cell"), title_key=title_key, u=F.col("u")))
    )
    exact = met.groupBy("ask", "hold").applyInArrow(_exact_best(n), _EXACT)
    close = exact.withColumn(
        "near", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", SIMILARITY_DECIMALS))))
    ).filter(F.col("near") <= n)
    titles = held.select("cell", "item_id", title_key.alias("title_key"), "title").dropDuplicates(["cell", "item_id", "title_key"])
    named = close.join(titles, ["cell", "item_id", "title_key"])
    order = [F.desc(F.round("similarity", SIMILARITY_DECIMALS)), F.desc("title"), F.col("item_id")]
    return top_n_per_group(named, ["query_id"], order, n).select("query_id", "rank", "item_id", "title", "similarity")
