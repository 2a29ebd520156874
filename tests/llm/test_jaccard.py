import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import awkward_texts, lower, prose, table, words
from vecloom.llm.components import connected_components
from vecloom.llm.jaccard_join import Sets, Slices, jaccard_components, keep_one_of_each_group, split_groups


def shingles(text, width):
    own = [lower(w) for w in words(text)]
    if not own:
        return set()
    return {tuple(own)} if len(own) < width else {tuple(own[k : k + width]) for k in range(len(own) - width + 1)}


def brute_components(rows, width, num, den):
    sets = [(i, shingles(text, width)) for i, text in rows if i is not None]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least[find(k)], i)
    found = [(i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)]
    found += [(None, len(shingles(text, width)), None) for i, text in rows if i is None]
    return sorted(found, key=repr)


def near_copies(seed=3):
    draw = random.Random(seed)
    rows, number = [], 1000
    for base_size in (6, 9, 14, 25, 60, 200, 400):
        base = prose(draw, base_size, 5000).split()
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            own = list(base)
            for _ in range(edits):
                at = draw.randrange(len(own))
                own[at : at + draw.randrange(0, 2)] = [f"n{draw.randrange(10**6)}"] * draw.randrange(0, 3)
            rows.append((number, " ".join(own)))
            number += 1
    for _ in range(40):  # a chain: neighbours are near, the ends are not
        base[draw.randrange(len(base))] = f"c{draw.randrange(10**6)}"
        rows.append((number, " ".join(base)))
        number += 1
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    ("width", "threshold", "region_docs"), [(4, (85, 100), 4096), (5, (80, 100), 4096), (5, (4, 5), 6), (2, (55, 100), 10), (1, (1, 1), 50)]
)
def test_components_against_brute_force(spark, width, threshold, region_docs):
    rows = awkward_texts() + near_copies()
    found = jaccard_components(table(spark, rows), width=width, threshold=threshold, region_docs=region_docs)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_components(rows, width, *threshold)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(17, 20), (4, 5), (3, 5)]), st.integers(1, 300))
def test_linked_sets_share_the_regions_they_must(seed, threshold, size):
    draw = np.random.default_rng(seed)
    num, den = threshold
    a = np.unique(draw.integers(0, 2**63, size).astype(np.uint64))
    gone = draw.integers(0, max(1, size // 4) + 1)
    b = np.unique(np.concatenate((draw.permutation(a)[gone:], draw.integers(0, 2**63, draw.integers(0, gone + 1)).astype(np.uint64))))
    common = len(np.intersect1d(a, b))
    slices = Slices(num, den)
    if len(b) and den * common >= num * (len(a) + len(b) - common) and common < max(len(a), len(b)):
        of = [{f: (need, set(keys.tolist())) for f, need, keys in slices.signatures(s)} for s in (a, b)]
        shared = {f: len(of[0][f][1] & of[1][f][1]) - max(of[0][f][0], of[1][f][0]) for f in of[0] if f in of[1]}
        assert max(shared.values()) >= 0


def test_groups_join_exactly_in_memory():
    draw = random.Random(8)
    base = [draw.randrange(1 << 60) for _ in range(120)]
    sets = []
    for _ in range(150):
        own = set(base)
        for _ in range(draw.randrange(0, 22)):
            own.discard(draw.choice(base))
            own.add(draw.randrange(1 << 60))
        sets.append(np.array(sorted(own), np.uint64))
    joined = Sets(sets, 4, 5)
    joined.join()
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    assert len({find(x) for x in range(150)}) == len({joined.find(x) for x in range(150)})


def test_connected_components(spark):
    draw = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(500, k) for k in range(501, 540)]
    edges += [(draw.randrange(1000, 1200), draw.randrange(1000, 1200)) for _ in range(90)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {x: find(x) for x in list(parent)}
    assert len(found) == len(parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_row_of_each_group_stays(spark):
    rows = awkward_texts() + near_copies()
    docs = table(spark, rows)
    kept = keep_one_of_each_group(docs, region_docs=30)
    assert kept.schema == docs.schema
    first = {i for i, _, c in brute_components(rows, 5, 4, 5) if i is not None and i == c}
    want = Counter({(i, t) for i, t in rows if i in first}) + Counter((i, t) for i, t in rows if i is None)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    clashing = keep_one_of_each_group(docs.withColumnRenamed("kept", "_first_id"), region_docs=30)
    assert Counter((r.doc_id, r.text) for r in clashing.collect()) == want
    assert jaccard_components(docs.limit(0)).collect() == []


def test_large_groups_whose_cells_do_not_shrink(spark):
    """Variants near one base and far from one another lie in all cells: no task may get them all."""
    draw = random.Random(5)
    base = [f"b{k}" for k in range(100)]
    rows = [(0, " ".join(base))]
    for k in range(1, 50):
        own = list(base)
        for at in draw.sample(range(100), 9):
            own[at] = f"v{k}x{at}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, f"{' '.join(base[:60])} {' '.join(f'f{k}y{at}' for at in range(40))}") for k in range(5)]
    sets = [(7, i, np.unique([hash(w) & (2**63 - 1) for w in text.split()]).astype(np.uint64).tobytes()) for i, text in rows]
    left, links = split_groups(spark.createDataFrame(sets, "group long, node long, shingles binary"), 4, 5, 8)
    sizes = [r["count"] for r in left.groupBy("group").count().collect()]
    assert max(sizes, default=0) <= 8 and sum(sizes) < 8 * len(rows)
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    found = {r.node: r.component for r in connected_components(found).collect()}
    assert {found[k] for k in range(50)} == {0} and not any(100 + k in found for k in range(5))
    whole = jaccard_components(table(spark, rows), width=1, region_docs=8)
    assert sorted(map(tuple, whole.collect()), key=repr) == brute_components(rows, 1, 4, 5)
