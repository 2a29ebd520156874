import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import awkward_texts, lower, table, words
from vecloom.llm.interpolated_lm import CLASSES, EM_GAIN, EM_ROUNDS, interpolated_scores


def grams(text, order):
    tokens = [lower(w) for w in words(text)] + [0]
    padded = [1] * (order - 1) + tokens
    return [[tuple(padded[order - 1 + k - n + 1 : order + k]) for k in range(len(tokens))] for n in range(1, order + 1)]


def fold(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 10


def counted(rows, order, use):
    counts = [Counter() for _ in range(order)]
    docs = 0
    for i, text in rows:
        if use(fold(i)):
            docs += 1
            for n, own in enumerate(grams(text, order)):
                counts[n].update(own)
    return counts, docs


def estimates(text, order, counts, docs):
    """Per token: class of the longest context, then the estimates from uniform up."""
    total, distinct = sum(counts[0].values()), len(counts[0])
    out = []
    for per_order in zip(*grams(text, order)):
        context = lambda g: docs if set(g[:-1]) == {1} else counts[len(g) - 2][g[:-1]]
        row = [1 / (distinct + 1), counts[0][per_order[0]] / max(total, 1)]
        row += [counts[n][g] / max(context(g), 1) for n, g in enumerate(per_order) if n]
        longest = context(per_order[-1]) if order > 1 else 0
        out.append((min(longest.bit_length(), CLASSES - 1), row))
    return out


def learned(rows, order):
    counts, docs = counted(rows, order, lambda f: f not in (None, 0, 1))
    held = [x for i, text in rows if fold(i) == 1 for x in estimates(text, order, counts, docs)]
    weights = np.full((CLASSES, order + 1), 1 / (order + 1))
    before, seen = None, np.zeros(CLASSES, bool)
    for _ in range(EM_ROUNDS):
        sums, likelihood = np.zeros((CLASSES, order + 1)), 0.0
        for of, row in held:
            parts = weights[of] * np.array([row[0], *np.float32(row[1:])], np.float64)
            sums[of] += parts / parts.sum()
            likelihood += math.log(parts.sum())
        seen = sums.sum(axis=1) > 0
        weights[seen] = sums[seen] / sums[seen].sum(axis=1, keepdims=True)
        likelihood /= max(len(held), 1)
        if before is not None and likelihood - before < EM_GAIN:
            break
        before = likelihood
    for k in range(1, CLASSES):
        if not seen[k]:
            weights[k] = weights[k - 1]
    weights = np.maximum(weights, 1e-6)
    return weights / weights.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_brute_force(spark, order):
    rows = awkward_texts()
    weights = learned(rows, order)
    counts, docs = counted(rows, order, lambda f: f not in (None, 0))
    total, distinct = sum(counts[0].values()), len(counts[0])
    want = []
    for i, text in rows:
        own = estimates(text, order, counts, docs)
        known = [counts[0][g] for g in grams(text, order)[0]]
        want.append(
            (
                i,
                None if i is None else fold(i) == 0,
                len(own),
                sum(c > 0 for c in known),
                total,
                sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in known),
                sum(math.log10(float(weights[of] @ row)) for of, row in own),
            )
        )
    want.sort(key=repr)
    # One group and slice, then many of both.
    for sizes in ({}, {"group_bytes": 9_000, "slice_bytes": 700}):
        found = sorted(map(tuple, interpolated_scores(table(spark, rows), order=order, **sizes).collect()), key=repr)
        assert [f[:5] for f in found] == [w[:5] for w in want]
        assert np.allclose([f[5:] for f in found], [w[5:] for w in want], rtol=1e-6, atol=1e-6)


def test_better_than_the_base_on_held_out_text(spark):
    import random

    draw = random.Random(5)
    follow = {k: [draw.randrange(60) for _ in range(3)] for k in range(60)}
    rows = []
    for i in range(300):
        word, text = draw.randrange(60), []
        for _ in range(80):
            text.append(f"w{word}")
            word = draw.choice(follow[word])
        rows.append((i, " ".join(text)))
    held = interpolated_scores(table(spark, rows)).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"] * 0.6


def test_nothing_to_learn_from(spark):
    empty = interpolated_scores(table(spark, awkward_texts()).limit(0))
    assert empty.collect() == []
    only = [(i, "a b") for i in range(200) if fold(i) == 0][:3]
    for row in interpolated_scores(table(spark, only)).collect():
        assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0.0 and math.isfinite(row.score)
