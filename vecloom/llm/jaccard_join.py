"""N-gram Jaccard join in the metric space of shingle sets, exact.

Distance is 1 - Jaccard, which obeys the triangle inequality. Documents drawn from a
corpus are at distance 1 from nearly all others, so sampled documents cannot be the first
pivots. The first level therefore takes the *slices* of the documents themselves as pivots:
the shingle universe is cut into m parts by hash, and a document lies at distance
1 - |slice| / |set| from each of its own slices. Two sets within the threshold differ in at
most H shingles, so of m > H slices at least m - H are equal: they meet in the region of
such a slice. Requiring as many common regions as that bound gives, and leaving out of each
document the c - 1 most crowded of its regions (c: the common ones it must have), keeps every
link and drops documents that merely share passages.

Regions that touch form groups. A group is joined recursively: pivots are drawn from it, its
documents go to the Voronoi cell of the nearest pivot and, if a pivot is at most twice the
threshold farther away than the nearest, into that cell too; a cell whose documents are
already in one component is done. Groups above ``region_docs`` are split this way by Spark,
smaller ones inside a task. A large group whose cells hardly shrink is joined by Spark in
pairs of bounded blocks instead, so that no task holds more than two blocks.

Copies (equal sets) are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.components import connected_components
from vecloom.llm.packed import (
    CHUNK_WORDS,
    RollingHash,
    arrow_rows,
    buckets_of,
    by_bucket,
    free_name,
    id_and_text,
    joined,
    mix,
    rows_of,
    runs,
    word_keys,
)
from vecloom.session import cut_lineage, new_path

SHINGLE_WORDS = 5
THRESHOLD = (80, 100)
REGION_DOCS = 4096
PIVOTS = 8
LEAF = 24

_PACKED = pa.schema(
    [
        ("bucket", pa.int32()),
        *((name, pa.binary()) for name in ("nodes", "families", "needs", "counts", "keys")),
        *((name, pa.binary()) for name in ("doc_ids", "sizes", "doc_nodes")),
    ]
)
_PACKED_DDL = (
    "bucket int, nodes binary, families binary, needs binary, counts binary, keys binary, "
    "doc_ids binary, sizes binary, doc_nodes binary"
)
_FOUND = "kind int, doc_id long, n_shingles long, node long, family int, need int, sig long, crowd long"


def shingle_set(text: bytes | None, width: int, roll: RollingHash) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    keys = word_keys(words)
    if len(words) < width:
        return mix(roll.windows(keys, len(words)) + np.uint64(len(words)))
    return np.unique(roll.windows(keys, width))


def node_of(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64)))


class Slices:
    """Which slices a set of a given size has, and how many a partner must share.

    Sizes fall into families that grow by a constant factor. A set belongs to its own
    family and, if a partner may be in the next one, to that as well.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ratio = max(1.5, 1.1 * den / num)

    @lru_cache(maxsize=None)  # noqa: B019
    def edge(self, family: int) -> int:
        return 1 if family == 0 else max(self.edge(family - 1) + 1, int(self.edge(family - 1) * self.ratio))

    def differ(self, a: int, b: int) -> int:
        """The most shingles in which linked sets of these sizes differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def parts(self, family: int) -> int:
        most = self.differ(self.edge(family + 1) - 1, self.edge(family + 1) - 1)
        return most + most * 3 // 10 + 2

    def families(self, size: int) -> list[tuple[int, int]]:
        """(family, most differing shingles) for a set; families without different partners are left out."""
        family = 0
        while self.edge(family + 1) <= size:
            family += 1
        largest = size * self.den // self.num
        found = []
        for k in (family, family + 1):
            if largest >= self.edge(k) and (most := self.differ(size, min(largest, self.edge(k + 1) - 1))):
                found.append((k, most))
        return found

    def signatures(self, shingles: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(family, common regions needed, region keys) of a set."""
        size = len(shingles)
        hashed = mix(shingles)
        for family, most in self.families(size):
            parts = self.parts(family)
            part = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            there, starts = np.unique(part[order], return_index=True)
            content = np.add.reduceat(hashed[order], starts)
            need = parts - most - (parts - len(there))
            yield 2 * family, max(1, need), mix(content + mix(there + np.uint64(family << 32)))
            if need <= 0:
                # Too many empty slices: such sets meet each other by their lowest shingles.
                lowest = np.sort(hashed)[: size - -(-size * self.num // self.den) + 1]
                yield 2 * family + 1, 1, mix(lowest + np.uint64((2 * family + 1) * 0x9E3779B9))


def _pack(width: int, num: int, den: int, buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, slices = RollingHash(), Slices(num, den)
        seen: set[int] = set()
        docs: list[tuple[int, int, int]] = []
        parts: list[tuple[int, int, int, np.ndarray]] = []
        gathered = 0

        def flush() -> pa.RecordBatch:
            out = []
            info = [np.array(column, np.int64).tobytes() for column in zip(*docs, strict=True)]
            out.append((docs[0][0] % buckets, None, None, None, None, None, *info))
            if parts:
                keys = np.concatenate([p[3] for p in parts])
                owner = np.repeat(np.arange(len(parts)), [len(p[3]) for p in parts])
                order, there, starts = by_bucket(keys, buckets)
                keys, owner = keys[order], owner[order]
                nodes = np.array([p[0] for p in parts], np.int64)
                families = np.array([p[1] for p in parts], np.uint16)
                needs = np.array([p[2] for p in parts], np.uint32)
                for number, start, end in zip(there.tolist(), starts[:-1], starts[1:], strict=True):
                    who, lengths = runs(owner[start:end])
                    out.append(
                        (
                            number,
                            nodes[who].tobytes(),
                            families[who].tobytes(),
                            needs[who].tobytes(),
                            lengths.tobytes(),
                            keys[start:end].tobytes(),
                            None,
                            None,
                            None,
                        )
                    )
            return arrow_rows(_PACKED, out)

        for doc_id, text in rows_of(batches):
            if doc_id is None:
                continue
            shingles = shingle_set(text, width, roll)
            node = node_of(shingles)
            docs.append((doc_id, len(shingles), node))
            gathered += 1
            if len(shingles) and node not in seen:
                seen.add(node)
                for family, need, keys in slices.signatures(shingles):
                    parts.append((node, family, need, keys))
                    gathered += len(keys)
            if gathered >= CHUNK_WORDS // 2:
                yield flush()
                docs, parts, gathered = [], [], 0
        if docs:
            yield flush()

    return pack


def _regions(bucket: pd.DataFrame) -> pd.DataFrame:
    """Rows of the documents that came along (kind 0) and of regions with two nodes or more (kind 1)."""
    docs = bucket[bucket["doc_ids"].notna()]
    info = pd.DataFrame(
        {
            "kind": 0,
            "doc_id": joined(docs["doc_ids"], np.int64),
            "n_shingles": joined(docs["sizes"], np.int64),
            "node": joined(docs["doc_nodes"], np.int64),
            "family": 0,
            "need": 0,
            "sig": 0,
            "crowd": 0,
        }
    )
    bucket = bucket[bucket["keys"].notna()]
    counts = joined(bucket["counts"], np.uint32)
    keys = joined(bucket["keys"], np.uint64)
    if not len(keys):
        return info
    who = np.repeat(np.arange(len(counts)), counts)
    nodes = joined(bucket["nodes"], np.int64)
    # A crowd of two needs another key; most keys are alone and go first.
    order = np.argsort(keys)
    keys, who = keys[order], who[order]
    same = keys[1:] == keys[:-1]
    live = np.concatenate((same, [False])) | np.concatenate(([False], same))
    keys, who = keys[live], who[live]
    node = nodes[who]
    order = np.lexsort((node, keys))
    keys, node, who = keys[order], node[order], who[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (node[1:] != node[:-1])))[: len(keys)]
    keys, node, who = keys[new], node[new], who[new]
    _, crowd = runs(keys)
    crowd = np.repeat(crowd, crowd).astype(np.int64)
    many = crowd > 1
    found = pd.DataFrame(
        {
            "kind": 1,
            "doc_id": 0,
            "n_shingles": 0,
            "node": node[many],
            "family": joined(bucket["families"], np.uint16)[who[many]].astype(np.int32),
            "need": joined(bucket["needs"], np.uint32)[who[many]].astype(np.int32),
            "sig": keys[many].view(np.int64),
            "crowd": crowd[many],
        }
    )
    return pd.concat([info, found], ignore_index=True)


def candidate_groups(found: DataFrame) -> DataFrame:
    """(node, group): nodes that meet in enough regions, grouped by the regions they keep."""
    members = (
        found.filter("kind = 1")
        .groupBy("node", "family", "need")
        .agg(F.sort_array(F.collect_list(F.struct("crowd", "sig"))).alias("regions"))
        .filter(F.size("regions") >= F.col("need"))
        .select("node", F.explode(F.slice("regions", F.lit(1), F.size("regions") - F.col("need") + 1)).alias("r"))
        .select("node", F.col("r.sig").alias("sig"))
    )
    members = cut_lineage(members, "members")
    root = members.groupBy("sig").agg(F.min("node").alias("b"))
    return connected_components(members.join(root, "sig").select(F.col("node").alias("a"), "b")).select(
        "node", F.col("component").alias("group")
    )


class Sets:
    """Shingle sets of one group in one numpy layout, with Jaccard distances from any of them."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, local = np.unique(np.concatenate(sets), return_inverse=True)
        counts = np.bincount(local, minlength=len(values))
        # Shingles of one set only never count in an intersection.
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        shared = counts[local] > 1
        self.local, owner = local[shared], owner[shared]
        self.starts = np.searchsorted(owner, np.arange(len(sets) + 1))
        self.flag = np.zeros(len(values) + 1, np.int64)
        self.parent = list(range(len(sets)))
        #: Links so far that joined two components.
        self.links = 0

    def common(self, one: int, others: np.ndarray) -> np.ndarray:
        lengths = self.starts[others + 1] - self.starts[others]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[others] - ends + lengths, lengths)
        mine = self.local[self.starts[one] : self.starts[one + 1]]
        self.flag[mine] = 1
        total = np.concatenate(([0], np.cumsum(self.flag[self.local[at]])))
        self.flag[mine] = 0
        return total[ends] - total[ends - lengths]

    def distances(self, one: int, others: np.ndarray) -> np.ndarray:
        """Distances from one set; sets within the threshold are linked to it on the way."""
        common = self.common(one, others)
        union = self.sizes[one] + self.sizes[others] - common
        for other in others[self.den * common >= self.num * union].tolist():
            self.link(one, other)
        return 1.0 - common / union

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.links += a != b
        self.parent[max(a, b)] = min(a, b)

    def whole(self, members: np.ndarray) -> bool:
        first = self.find(int(members[0]))
        return all(self.find(x) == first for x in members.tolist())

    def join(self) -> None:
        """Link all sets within the threshold of one another, up to connectivity."""
        window = 2 * (1 - self.num / self.den) + 1e-9
        stack = [np.arange(len(self.sizes))]
        while stack:
            members = stack.pop()
            if len(members) < 2 or self.whole(members):
                continue
            if len(members) <= LEAF:
                self.block(members)
                continue
            pivots, far = [int(members[0])], []
            while True:
                far.append(self.distances(pivots[-1], members))
                nearest = np.min(far, axis=0)
                if len(pivots) == PIVOTS or not nearest.max():
                    break
                pivots.append(int(members[np.argmax(nearest)]))
            if self.whole(members):
                continue
            cells = [members[f <= nearest + window] for f in far]
            if max(map(len, cells)) > 0.8 * len(members):
                self.block(members)
            else:
                stack += cells

    def across(self, ones: np.ndarray, others: np.ndarray) -> None:
        """Link sets of two blocks, up to connectivity; sets of one component are not compared."""
        roots, seen = np.array([self.find(x) for x in others.tolist()]), self.links
        for one in ones.tolist():
            if self.links != seen:
                roots, seen = np.array([self.find(x) for x in others.tolist()]), self.links
            low, high = np.minimum(self.sizes[one], self.sizes[others]), np.maximum(self.sizes[one], self.sizes[others])
            open_others = others[(roots != self.find(one)) & (self.den * low >= self.num * high)]
            if len(open_others):
                self.distances(one, open_others)

    def block(self, members: np.ndarray) -> None:
        for at in range(len(members) - 1):
            if at % 16 == 0 and self.whole(members):
                return
            one, others = int(members[at]), members[at + 1 :]
            # Sizes alone rule out most partners in a block of unlike sets.
            low, high = np.minimum(self.sizes[one], self.sizes[others]), np.maximum(self.sizes[one], self.sizes[others])
            others = others[self.den * low >= self.num * high]
            if len(others):
                self.distances(one, others)


def _join_group(num: int, den: int):
    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node").drop_duplicates("node")
        nodes = group["node"].to_numpy()
        sets = Sets([np.frombuffer(b, np.uint64) for b in group["shingles"]], num, den)
        sets.join()
        root = np.array([sets.find(x) for x in range(len(nodes))])
        linked = root != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[linked], "b": nodes[root[linked]]})

    return join


def _to_cells(num: int, den: int, level: int):
    """Distances to the pivots of a group; of each row its cell and the cells in the window."""
    window = 2 * (1 - num / den) + 1e-9

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for group, node, shingles, pivot_nodes, pivots in batch.itertuples(index=False):
                own = np.frombuffer(shingles, np.uint64)
                far, near = [], []
                for pivot in pivots:
                    other = np.frombuffer(pivot, np.uint64)
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    union = len(own) + len(other) - common
                    far.append(1.0 - common / union)
                    near.append(den * common >= num * union)
                within = [
                    {
                        "cell": int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(f"{level}/{group}/{at}")).view(np.int64))),
                        "pivot": int(pivot_nodes[at]),
                        "near": bool(near[at]),
                    }
                    for at, distance in enumerate(far)
                    if distance <= min(far) + window
                ]
                out.append((group, node, shingles, within))
            yield pd.DataFrame(out, columns=["group", "node", "shingles", "within"])

    return cells


def split_groups(sets: DataFrame, num: int, den: int, region_docs: int) -> tuple[DataFrame, list[DataFrame]]:
    """Voronoi-split groups above ``region_docs``; (groups that are left, links found on the way).

    A group whose cells would not save a fifth of its pairs is not copied into them: it is
    joined by pairs of blocks.
    """
    links: list[DataFrame] = []
    done: list[DataFrame] = []
    level = 0
    while True:
        sizes = sets.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
        large = cut_lineage(sets.join(sizes.filter(F.col("n") > region_docs), "group", "left_semi"), "large")
        if not large.limit(1).count():
            return _all_of([sets, *done]), links
        done.append(sets.join(sizes.filter(F.col("n") > region_docs), "group", "left_anti"))
        pivots = _draw_pivots(large, level)
        placed = cut_lineage(
            large.join(pivots, "group")
            .select("group", "node", "shingles", "pivot_nodes", "pivots")
            .mapInPandas(
                _to_cells(num, den, level),
                "group long, node long, shingles binary, within array<struct<cell: long, pivot: long, near: boolean>>",
            ),
            "cells",
        )
        cells = placed.select("group", "node", F.explode("within").alias("w")).select("group", "node", "w.*")
        to_pivots = cells.filter("near and node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        links.append(to_pivots)
        # A cell whose members are all linked to its pivot is one component already.
        open_cells = (
            cells.groupBy("group", "cell")
            .agg(F.bool_and("near").alias("closed"), F.count(F.lit(1)).cast("double").alias("n"))
            .filter("not closed")
        )
        pairs = open_cells.groupBy("group").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
        stuck = cut_lineage(
            pairs.join(sizes, "group").filter(F.col("pairs") > 0.8 * F.col("n") * F.col("n")).select("group"), "stuck"
        )
        if stuck.limit(1).count():
            whole = placed.join(stuck, "group", "left_semi").select("group", "node", "shingles")
            links += _join_by_blocks(whole, to_pivots, num, den, region_docs)
            placed = placed.join(stuck, "group", "left_anti")
        sets = (
            placed.select("node", "shingles", F.explode("within.cell").alias("group"))
            .join(open_cells.select(F.col("cell").alias("group")), "group", "left_semi")
            .select("group", "node", "shingles")
        )
        level += 1


def _all_of(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def _join_blocks(num: int, den: int):
    """Links between the two blocks of a pair, or inside the one block, that join two components."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["node", "side"])
        nodes, side = group["node"].to_numpy(), group["side"].to_numpy()
        sets = Sets([np.frombuffer(b, np.uint64) for b in group["shingles"]], num, den)
        before: dict[int, int] = {}
        for at, component in enumerate(group["component"].tolist()):
            sets.link(at, before.setdefault(component, at))
        known = np.array([sets.find(x) for x in range(len(nodes))])
        if side.max() > 0:
            sets.across(np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        else:
            sets.join()
        root = np.array([sets.find(x) for x in range(len(nodes))])
        new = root != known
        return pd.DataFrame({"a": nodes[known[new]], "b": nodes[root[new]]}).drop_duplicates()

    return join


def _join_by_blocks(sets: DataFrame, links: DataFrame, num: int, den: int, region_docs: int) -> list[DataFrame]:
    """Links of groups of any size by pairs of blocks, at most about ``region_docs`` members in a task.

    Blocks are hashed inside classes of set size; linked sets are of one class or of two
    neighbours. Each round takes a share of the pairs; pairs whose members are one component
    by then are left out. Without structure all pairs meet: quadratic in the group, exact.
    """
    step = math.log(den / num) + 1e-9
    half = max(1, region_docs // 2)
    sets = sets.withColumn("class", F.floor(F.log(F.length("shingles") / 8) / step))
    classes = sets.groupBy("group", "class").agg(F.ceil(F.count(F.lit(1)) / half).alias("blocks"))
    sets = sets.join(classes, ["group", "class"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")))
    sets = cut_lineage(sets.select("group", "class", "part", "node", "shingles"), "blocks")
    own = sets.select("group", "class", "part").distinct()
    first = own.select("group", F.col("class").alias("class_a"), F.col("part").alias("part_a"))
    second = own.select("group", F.col("class").alias("class_b"), F.col("part").alias("part_b"))
    apart = F.abs(F.col("part_b") - F.col("part_a")) + F.col("class_b") - F.col("class_a")
    pairs = cut_lineage(
        first.join(second, "group")
        .filter("class_b = class_a and part_b >= part_a or class_b = class_a + 1")
        .withColumn("round", F.ceil(F.log2(apart + 1)).cast("int")),
        "pairs",
    )
    found: list[DataFrame] = []
    members = sets.select("node").distinct()
    rounds = pairs.agg(F.max("round")).first()[0]
    for number in range(rounds + 1):
        labels = connected_components(_all_of([links.join(members, links["a"] == members["node"], "left_semi"), *found]))
        labelled = sets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        labelled = cut_lineage(labelled, "labelled")
        one = labelled.groupBy("group", "class", "part").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        sides = [
            one.select("group", *[F.col(c).alias(f"{c}_{side}") for c in ("class", "part", "low", "high")]) for side in "ab"
        ]
        due = pairs.filter(F.col("round") == number)
        due = due.join(sides[0], ["group", "class_a", "part_a"]).join(sides[1], ["group", "class_b", "part_b"])
        due = due.filter(F.least("low_a", "low_b") < F.greatest("high_a", "high_b"))
        a = due.select("group", F.col("class_a").alias("class"), F.col("part_a").alias("part"), F.lit(0).alias("side"), *_PAIR)
        b = due.filter("class_a != class_b or part_a != part_b").select(
            "group", F.col("class_b").alias("class"), F.col("part_b").alias("part"), F.lit(1).alias("side"), *_PAIR
        )
        met = labelled.join(a.union(b), ["group", "class", "part"])
        met = met.select("group", *_PAIR, "side", "node", "shingles", "component")
        found.append(
            cut_lineage(met.groupBy("group", *_PAIR).applyInPandas(_join_blocks(num, den), "a long, b long"), "found")
        )
    return found


_PAIR = ("class_a", "part_a", "class_b", "part_b")


def _draw_pivots(large: DataFrame, level: int) -> DataFrame:
    order = Window.partitionBy("group").orderBy(F.xxhash64("node", F.lit(level)), "node")
    return (
        large.withColumn("at", F.row_number().over(order))
        .filter(F.col("at") <= PIVOTS)
        .groupBy("group")
        .agg(F.collect_list("node").alias("pivot_nodes"), F.collect_list("shingles").alias("pivots"))
    )


def _as_sets(width: int):
    schema = pa.schema([("group", pa.int64()), ("node", pa.int64()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash()
        for batch in batches:
            rows = [(group, node, shingle_set(text, width, roll).tobytes()) for group, node, text in rows_of([batch])]
            yield arrow_rows(schema, rows)

    return sets


def jaccard_components(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE_WORDS,
    threshold: tuple[int, int] = THRESHOLD,
    region_docs: int = REGION_DOCS,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct shingles of
    ``width`` words, a shorter text is one shingle. Two documents link when their sets' Jaccard
    index is at least ``threshold``, a fraction (numerator, denominator) of 1/2 or more.

    Null, empty and blank texts have an empty set and link with nothing. Rows with a null
    id come back with their null id alone. Repeated rows count as copies of one another.
    Other columns are not read. An empty table gives an empty result.
    """
    num, den = threshold
    if not den <= 2 * num <= 2 * den:
        raise ValueError("threshold must be between 1/2 and 1")
    common = math.gcd(num, den)
    num, den = num // common, den // common
    spark = documents.sparkSession
    docs = id_and_text(documents, id_col, text_col)
    path = new_path(spark, "regions")
    (
        docs.mapInArrow(_pack(width, num, den, buckets_of(spark)), _PACKED_DDL)
        .groupBy("bucket")
        .applyInPandas(_regions, _FOUND)
        .write.partitionBy("kind")
        .parquet(path)
    )
    found = spark.read.schema(_FOUND).parquet(path)
    info = found.filter("kind = 0").select("doc_id", "n_shingles", "node")
    groups = candidate_groups(found)
    one_each = info.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(groups, "node")
    sets = (
        docs.join(one_each.hint("shuffle_hash"), "doc_id")
        .select("group", "node", "text")
        .mapInArrow(_as_sets(width), "group long, node long, shingles binary")
    )
    sets = cut_lineage(sets, "sets")
    sets, to_pivots = split_groups(sets, num, den, region_docs)
    links = sets.groupBy("group").applyInPandas(_join_group(num, den), "a long, b long")
    for more in to_pivots:
        links = links.union(more)
    labels = connected_components(links)
    labelled = info.join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component")
    )
    labelled = labelled.withColumn("linked", F.col("n_shingles") > 0)
    least = labelled.filter("linked").groupBy("component").agg(F.min("doc_id").alias("least"))
    result = (
        labelled.join(least, "component", "left")
        .select("doc_id", "n_shingles", F.when(F.col("linked"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
    )
    lone = docs.filter("doc_id is null").mapInArrow(_lone(width), "doc_id long, n_shingles long, component_id long")
    return result.union(lone)


def _lone(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("component_id", pa.int64())])

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash()
        for batch in batches:
            yield arrow_rows(schema, [(None, len(shingle_set(text, width, roll)), None) for _, text in rows_of([batch])])

    return lone


def keep_one_of_each_group(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``documents``, all columns, whose id is the smallest of their group.

    Repeated rows (equal id and text) come once; rows with a null id all stay.
    """
    name = free_name(documents.columns, "_first_id")
    first = (
        jaccard_components(documents, id_col, text_col, **options)
        .filter("doc_id = component_id")
        .select(F.col("doc_id").alias(name))
        .distinct()
    )
    own = F.col(f"`{id_col}`").cast("long")
    kept = documents.join(first.hint("shuffle_hash"), own == F.col(name), "left_semi")
    return kept.dropDuplicates([id_col, text_col]).union(documents.filter(own.isNull()))
