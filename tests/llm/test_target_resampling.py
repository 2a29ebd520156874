"""Buckets, gains, weights and ranks against their definitions."""

import math
import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from vecloom.llm.target_resampling import feature_buckets, resample_to_target, top_ranks, words_of

from .cases import COLUMNS, awkward_texts, lower, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(lower(text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def by_definition(documents, target, percent=5):
    bucket = lambda f: crc32(f.encode()) % 10_000
    sums = []
    for texts in ([t for _, t in documents], target):
        counts = [0] * 10_000
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
        sums.append(counts)
    source, wanted = sums
    all_s, all_t = sum(source), sum(wanted)
    gain = [
        math.floor(1000 * math.log((t + 1) * (all_s + 10_000) / ((s + 1) * (all_t + 10_000))))
        for s, t in zip(source, wanted, strict=True)
    ]
    rows = []
    for doc_id, text in documents:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100], start=1):
        row.append(rank)
    return [tuple(r) if len(r) == 6 else (*r, None) for r in rows]


def key(row):
    return tuple((v is None, v or 0) for v in row)


def test_buckets_are_those_of_the_joined_words():
    draw = random.Random(2)
    words = ["".join(draw.choice("abz09é€😀") for _ in range(draw.choice((1, 3, 8, 70, 300)))).encode() for _ in range(400)]
    got = np.concatenate(list(feature_buckets(words)))
    want = [crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    assert got.tolist() == want
    assert not sum(map(len, feature_buckets([]))) and [len(p) for p in feature_buckets([b"a"])] == [1]


def test_slices_meet_without_loss(monkeypatch):
    words = [f"w{i % 37}".encode() for i in range(101)]
    whole = sorted(np.concatenate(list(feature_buckets(words))).tolist())
    monkeypatch.setattr("vecloom.llm.target_resampling.SLICE_WORDS", 7)
    assert sorted(np.concatenate(list(feature_buckets(words))).tolist()) == whole


def test_words_are_letters_digits_and_what_is_not_ascii():
    assert words_of("Ab-1ÉcÄ{}~\x7fz\x00q ÀB".encode()) == [w.encode() for w in ("ab", "1ÉcÄ", "z", "q", "Àb")]


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_rows_follow_the_definition(spark, percent):
    rows = [(i, t) for i, t in awkward_texts() if i is None or i not in (203, 5)]
    target = ["w1 w2 w3 w4", None, "", "Shared line again again"]
    texts = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, doc_id string")
    got = resample_to_target(table(spark, rows), texts, percent=percent, run_rows=7, segment_rows=5).collect()
    assert sorted(map(tuple, got), key=key) == sorted(by_definition(rows, target, percent), key=key)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], COLUMNS)
    one = table(spark, [(1, "a b c"), (2, None)])
    assert resample_to_target(nothing, one).count() == 0
    rows = resample_to_target(one, nothing).collect()
    assert sorted(map(tuple, rows), key=key) == sorted(by_definition([(1, "a b c"), (2, None)], []), key=key)


def test_ranks_of_many_ties_and_one_large_group(spark):
    draw = random.Random(4)
    rows = [(draw.choice((1, 2, 3)) if i % 3 else 2, draw.choice((5, 6, None)) if i % 3 else 6, i) for i in range(5000)]
    scored = spark.createDataFrame(rows, "score long, doc_id long, row_id long").repartition(9)
    ranks = {r.row_id: r.rank for r in top_ranks(scored, 3000, 5000, run_rows=100, segment_rows=300).collect()}
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    assert ranks == {row_id: place for place, (_, _, row_id) in enumerate(order[:3000], start=1)}
