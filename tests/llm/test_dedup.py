import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import awkward_texts, lower, prose, table, words
from vecloom.llm.line_dedup import LineRuns, drop_repeated_lines, line_dedup
from vecloom.llm.packed import RollingHash, narrow, widen, word_keys
from vecloom.llm.substring_dedup import substring_dedup

SPACE = "\x20\t\n\x0b\x0c\r"


def test_rolling_hash_depends_on_the_words_alone():
    roll = RollingHash()
    keys = word_keys(b"a b c d e a b c x a b c d".split())
    found = roll.windows(keys, 3)
    assert found[0] == found[5] == found[9] and found[1] == found[10]
    assert len(set(found.tolist())) == 8
    assert len(roll.windows(keys, 14)) == 0


def test_narrow_counts_round_trip():
    values = np.array([0, 1, 254, 255, 256, 10**12])
    assert widen(narrow(values), len(values)).tolist() == values.tolist()


def brute_substrings(rows, width):
    first = {}
    for i, text in rows:
        own = words(text)
        for k in range(len(own) - width + 1):
            if i is not None:
                key = tuple(own[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        own = words(text)
        gone = set()
        for k in range(len(own) - width + 1):
            if i is not None and first[tuple(own[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [1, 4, 13])
def test_substrings_against_brute_force(spark, width):
    rows = awkward_texts()
    found = substring_dedup(table(spark, rows), width=width).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in found], key=repr) == brute_substrings(rows, width)
    for row in found:
        assert sum(s.end - s.start for s in row.spans) == row.n_removed
        assert all(a.end < b.start for a, b in zip(row.spans, row.spans[1:]))


def test_substrings_of_an_empty_table(spark):
    assert substring_dedup(table(spark, awkward_texts()).limit(0)).collect() == []


def brute_lines(rows, min_docs, min_chars):
    key = lambda line: lower(line.strip(SPACE))
    docs = Counter()
    by_id = {}
    for i, text in rows:
        by_id.setdefault(i, set()).update(key(line) for line in (text or "").split("\n"))
    for keys in by_id.values():
        docs.update(keys)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < min_chars or docs[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("min_docs", "min_chars", "batches"), [(10, 1, 4), (2, 3, 5), (1, 1, 1), (10, 50, 3)])
def test_lines_against_brute_force(spark, min_docs, min_chars, batches):
    rows = awkward_texts()
    found = line_dedup(table(spark, rows), min_docs=min_docs, min_chars=min_chars, batches=batches).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found], key=repr) == brute_lines(rows, min_docs, min_chars)


def test_rows_keep_their_columns(spark):
    rows = awkward_texts()
    docs = table(spark, rows)
    left = drop_repeated_lines(docs, min_docs=10)
    assert left.schema == docs.schema
    expected = sorted([(i, kept) for i, _, _, kept in brute_lines(rows, 10, 1)], key=repr)
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=repr) == expected
    clashing = docs.withColumnsRenamed({"kept": "_gone_lines", "keys": "_GONE_LINES_ID"})
    again = drop_repeated_lines(clashing, min_docs=10)
    assert again.schema == clashing.schema
    assert sorted([(r.doc_id, r.text) for r in again.collect()], key=repr) == expected
    assert line_dedup(docs.limit(0)).count() == drop_repeated_lines(docs.limit(0)).count() == 0


def test_runs_are_levelled_and_settle(spark):
    draw = random.Random(4)
    runs = LineRuns(spark, min_docs=6, fanout=2)
    seen = Counter()
    for batch in range(7):
        rows = [(100 * batch + i, draw.randrange(40), 0) for i in range(30)]
        seen.update(k for _, k in {(d, k) for d, k, _ in rows})
        runs.add(spark.createDataFrame(rows, "doc_id long, hi long, lo long"))
        assert all(len(level) < 2 for level in runs.levels)
    assert {r.hi for r in runs.finish().collect()} == {k for k, n in seen.items() if n >= 6}
