"""Repairs against a search over all edits, counts against their definitions."""

import hashlib
import random
from functools import cache

import pytest

from vecloom.llm.conversation_repair import Repair, repair_report, repaired_turns

WHITE = " \t\n\r\x0b\x0c"
COLUMNS = "conv_id long, turn int, role string, text string, absent boolean, repeated string, edits int"


def faults(rows):
    """(role, text, must go, truncated) of rows in order, and the counts of faults."""
    seen, out, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        blank, again = not text.strip(WHITE), (role, text) in seen
        seen.add((role, text))
        cut = text.rstrip(WHITE)[-1:] not in (".", "!", "?")
        fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
        if fault:
            counts[fault] += 1
        out.append((role, text, blank or again, fault == "truncated"))
    return out, counts


def cheapest(rows):
    """(cost, edits) by trying every edit at every place, from the end."""

    @cache
    def best(at, state, inserts):
        options = []
        if at == len(rows) and state in (0, 3):
            options.append((0, ""))
        target = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        if inserts < 4 and (rest := best(at, target, inserts + 1)):
            options.append((2 + rest[0], "I" + rest[1]))
        if at < len(rows):
            role, _, must_go, cut = rows[at]
            if rest := best(at + 1, state, 0):
                options.append((3 + rest[0], "D" + rest[1]))
            if not must_go:
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
                if kept is not None and (rest := best(at + 1, kept, 0)):
                    options.append((cut + rest[0], "K" + rest[1]))
                if rest := best(at + 1, target, 0):
                    options.append((2 + cut + rest[0], "R" + rest[1]))
        return min(options, default=None)

    return best(0, 0, 0)


def repaired(rows, audit):
    lines, state, at = [], 0, 0
    for letter in audit:
        name = "assistant" if state == 2 else "user"
        if letter == "I":
            lines.append(f"{name}:")
        else:
            role, text = rows[at][:2]
            at += 1
            if letter == "D":
                continue
            name = role if letter == "K" else name
            lines.append(f"{name}:{text}")
        state = 1 if name[0] == "s" else 2 if name[0] == "u" else 3
    return lines


def draw_rows(draw, n):
    roles = draw.choice((["user", "assistant"], ["user"], ["assistant", "user", "system"], ["tool", "user", "", "assistant", "system"]))
    texts = ["Yes.", "No!", "why", " ", "", "A longer text?", "ö", "a. "] + [f"n{i}." for i in range(12)]
    return [(draw.choice(roles), draw.choice(texts)) for _ in range(n)]


def search(rows):
    repair = Repair()
    for role, text, must_go, cut in rows:
        repair.row(role, text.encode(), must_go, cut)
    return repair, repair.finish()


@pytest.mark.parametrize("seed", range(8))
def test_search_finds_the_least_of_all_cheapest_edits(seed):
    draw = random.Random(seed)
    for _ in range(120):
        rows, _ = faults(draw_rows(draw, draw.randrange(0, 14)))
        _, (cost, audit, digest) = search(rows)
        assert (cost, audit) == cheapest(rows), rows
        assert digest == hashlib.sha256("\n".join(repaired(rows, audit)).encode()).hexdigest()


def test_survivors_of_a_long_lawful_conversation_meet_at_once():
    rows = [("user", f"q{i}?", False, False) if i % 2 == 0 else ("assistant", f"a{i}.", False, False) for i in range(4000)]
    repair, (cost, audit, _) = search(rows)
    assert cost == 0 and audit == "K" * 4000 and repair.most_open < 20


def test_survivors_that_never_meet_hold_letters_only():
    rows = [("user", f"q{i}?", False, False) for i in range(3000)]
    assert search(rows[:60])[1][:2] == cheapest(rows[:60])
    repair, (cost, audit, _) = search(rows)
    assert cost == 3000 and sum(letter in "KRD" for letter in audit) == 3000
    assert len(repair._branches()) <= 7


def conversations(seed=5):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(40), None]:
        turn = draw.choice((0, 3))
        for role, text in draw_rows(draw, draw.randrange(0, 12)):
            rows.append((conv, draw.choice((turn, turn, None)), draw.choice((role, role, None)), draw.choice((text, text, text, None)), False, "x", 1))
            turn += draw.choice((0, 1, 1, 2))
    rows += [(77, 1, "user", "hi.", True, "x", 1), (78, 4, "user", "x" * 300_000, False, "x", 1)]
    return rows


def expected(rows):
    groups = {}
    for conv, turn, role, text, absent, *_ in rows:
        groups.setdefault(conv, [])
        if not absent:
            groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marked, counts = faults([r[1:] for r in group])
        turns = [r[0] for r in group if r[0] is not None]
        initials = [r[1][:1] for r in group]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials[:-1], initials[1:], strict=True))
        cost, audit = cheapest(marked)
        lines = repaired(marked, audit)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = ((gaps, *counts.values(), illegal, cost, audit, digest), lines)
    return out


def test_report_and_repaired_rows(spark):
    rows = conversations()
    want = expected(rows)
    table = spark.createDataFrame(rows, COLUMNS).repartition(5)
    report = repair_report(table, absent=table["absent"]).drop("most_open").collect()
    assert len(report) == len(want)
    for conv, *values in report:
        assert tuple(values) == want[conv][0], conv
    turns = {}
    for r in sorted(repaired_turns(table.filter("NOT absent")).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert turns == {conv: lines for conv, (_, lines) in want.items() if lines}


def test_empty_table_and_conversation_without_rows(spark):
    assert repair_report(spark.createDataFrame([], COLUMNS)).count() == 0
    assert repaired_turns(spark.createDataFrame([], COLUMNS)).count() == 0
    gone = spark.createDataFrame([(1, 0, "user", "a", True, "", 1)], COLUMNS)
    row = repair_report(gone, absent=gone["absent"]).drop("most_open").first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_ids_of_any_type(spark):
    rows = [("a", 1, "user", "hi."), ("a", 2, "assistant", "ho."), ("", 1, "system", "x.")]
    report = {r.talk: r.audit for r in repair_report(spark.createDataFrame(rows, "talk string, n int, role string, text string"), "talk", "n").collect()}
    assert report == {"a": "KK", "": "D"}
