import random

import pytest

from tests.llm.cases import awkward_texts, prose, table
from vecloom.llm.decontamination import clean_documents, contaminated_pairs, decontamination_report, tile, tokens_of

import numpy as np


def brute_tiles(item, doc, least):
    """Greedy string tiling as it is defined: the longest free match each time."""
    least = min(least, len(item))
    free_i, free_d, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while p + n < len(item) and d + n < len(doc) and item[p + n] == doc[d + n] and free_i[p + n] and free_d[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, d)
        n, p, d = best
        if n < least or not n:
            return tiles
        tiles.append((p, d, n))
        free_i[p : p + n] = [False] * n
        free_d[d : d + n] = [False] * n


def all_seeds(item, doc, width):
    width = min(width, len(item))
    return [(p, d) for p in range(len(item) - width + 1) for d in range(len(doc) - width + 1) if item[p : p + width] == doc[d : d + width]]


@pytest.mark.parametrize("seed", range(30))
def test_tiling_against_the_definition(seed):
    draw = random.Random(seed)
    item = [draw.randrange(1, 6) for _ in range(draw.randrange(1, 30))]
    doc = [draw.randrange(1, 6) for _ in range(draw.randrange(0, 60))]
    found = tile(np.array(item), np.array(doc), all_seeds(item, doc, 3), 3)
    assert found == brute_tiles(item, doc, 3)


def setup(spark):
    draw = random.Random(6)
    items = [(k, prose(draw, 30, 100_000)) for k in range(20)] + [(20, "w1 w2 w3"), (21, None), (22, ""), (None, "w9"), (3, "again w4")]
    words = [t.split() if t else [] for _, t in items]
    rows = awkward_texts()
    rows += [
        (900, "before " + items[0][1].upper() + ", after"),
        (901, " ".join(words[1][20:] + ["x"] + words[1][:20])),
        (902, " ".join(words[2][:10])),
        (903, "W1, w2 - w3"),
        (904, " ".join(w for k in range(0, 30, 3) for w in (*words[4][k : k + 3], "gap"))),
        (905, items[5][1] + " " + items[6][1]),
    ]
    return rows, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row string"), items


def test_pairs_against_brute_force(spark):
    rows, benchmark, items = setup(spark)
    want = []
    for i, text in rows:
        doc = tokens_of((text or "").encode())
        for item_id, item_text in items:
            item = tokens_of((item_text or "").encode())
            if item and item_id is not None and len(set(doc) & set(item)) > 0:
                covered = sum(t[2] for t in brute_tiles(item, doc, 5)) if len(doc) < 200 else 0
                if covered >= 0.5 * len(item):
                    want.append((i, item_id, len(item), covered))
    for tokens in (500_000, 60):
        pairs = contaminated_pairs(table(spark, rows), benchmark, block_tokens=tokens)
        assert sorted([(r.doc_id, r.item_id, r.item_tokens, r.covered) for r in pairs.collect()], key=repr) == sorted(want, key=repr)
    assert {900, 901, 903, 905} <= {w[0] for w in want} and not {902, 904} & {w[0] for w in want}
    assert {r.item_rank for r in decontamination_report(table(spark, rows), benchmark).filter("doc_id = 905").collect()} == {1, 2}


def test_clean_rows_stay(spark):
    rows, benchmark, _ = setup(spark)
    docs = table(spark, rows)
    bad = {r.doc_id for r in contaminated_pairs(docs, benchmark).collect()}
    for tokens in (500_000, 60):
        kept = clean_documents(docs, benchmark, block_tokens=tokens)
        assert kept.schema == docs.schema
        assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([i for i, _ in rows if i not in bad], key=repr)
    assert clean_documents(docs.limit(0), benchmark).collect() == []
    assert contaminated_pairs(docs, benchmark.limit(0)).collect() == []
