"""Conversation structure repair by a Viterbi search whose survivors coalesce.

A conversation is repaired row by row into the roles ``(system? (user assistant)+)?``. Four
states say what has been given so far: nothing, a system row, a user row, an assistant row.
Each state keeps its cheapest edits, ties going to the ASCII-least ones. The edits of all states
form a tree of branches with reference counts: a branch that only one other continues is merged with it,
one that nothing continues is dropped, and what all survivors share is emitted. States that can
no longer win are dropped too, so survivors meet soon; what is held is the part in which they differ.

The rows are shuffled once by conversation, sorted, and streamed: a task never holds a
conversation, only the open edits of the one it reads. Texts are hashed as they pass, by each survivor.

Two edit strings of one cost that lead to one state over the same rows are never each
other's prefix (that would take further inserts, which cost), so the smaller one stays smaller whatever
follows, and comparing the parts in which two survivors differ is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.packed import WHITE, arrow_rows, rows_of

KEEP, REROLE, DELETE, INSERT = b"KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What each state may give next: (initial of the role, state after it).
NEXT = {
    NOTHING: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
#: The role that an insert or a rerole gives from a state, and the state after it.
GIVEN = {
    NOTHING: (b"user", USER),
    SYSTEM: (b"user", USER),
    USER: (b"assistant", ASSISTANT),
    ASSISTANT: (b"user", USER),
}
#: EXTRA[y][x]: what y pays at most beyond x for following any continuation of x.
EXTRA = {
    NOTHING: {SYSTEM: 0, USER: 2, ASSISTANT: 0},
    SYSTEM: {NOTHING: 4, USER: 2, ASSISTANT: 4},
    USER: {NOTHING: 5, SYSTEM: 2, ASSISTANT: 2},
    ASSISTANT: {NOTHING: 3, SYSTEM: 0, USER: 2},
}
LAWFUL = {"su", "ua", "au"}


class Branch:
    """Edits after those of the parent; ``held`` counts the survivors and branches that need it."""

    __slots__ = ("parent", "edits", "held")

    def __init__(self, parent: Branch | None, edits: bytes = b""):
        self.parent, self.edits, self.held = parent, bytearray(edits), 0
        if parent is not None:
            parent.held += 1

    def release(self) -> None:
        node = self
        node.held -= 1
        while node.held == 0 and node.parent is not None:
            node = node.parent
            node.held -= 1

    def path(self) -> list[Branch]:
        node, nodes = self, []
        while node is not None:
            nodes.append(node)
            node = node.parent
        return nodes[::-1]

    def merge_single(self) -> None:
        """Join every branch above with the one that alone continues it."""
        node = self
        while node.parent is not None:
            above = node.parent
            if above.held == 1:
                above.edits += node.edits
                node.edits, node.parent = above.edits, above.parent
            else:
                node = above


class Survivor:
    """The cheapest edits to a state, their cost, and the hash of the rows they give."""

    __slots__ = ("cost", "branch", "digest", "given")

    def __init__(self, cost: int, branch: Branch, digest, given: bool):
        self.cost, self.branch, self.digest, self.given = cost, branch, digest, given
        branch.held += 1


def _before(a: Branch, edit_a: bytes, b: Branch, edit_b: bytes) -> bool:
    """Whether one open edit string is ASCII-less than another; what they share is skipped."""
    left, right = a.path(), b.path()
    shared = sum(1 for _ in _while_same(left, right))
    one = chain(chain.from_iterable(n.edits for n in left[shared:]), edit_a)
    two = chain(chain.from_iterable(n.edits for n in right[shared:]), edit_b)
    for x, y in zip_longest(one, two, fillvalue=-1):
        if x != y:
            return x < y
    return False


def _while_same(left: list, right: list) -> Iterator[None]:
    for x, y in zip(left, right, strict=False):
        if x is not y:
            return
        yield None


class Repair:
    """One conversation's search. Rows go in by ``row``; ``finish`` ends it."""

    def __init__(self):
        root = Branch(None)
        self.live: dict[int, Survivor] = {NOTHING: Survivor(0, root, hashlib.sha256(), False)}
        self.emitted = bytearray()
        self._insert()
        #: The most edits that were open at a time.
        self.most_open = 0

    def _move(self, moves: dict[int, list[tuple[int, int, bytes, bytes | None]]]) -> None:
        """Each state takes its best move (cost, state before, edit or nothing, row given)."""
        before, after = self.live, {}
        for state, offers in moves.items():
            best = offers[0]
            for offer in offers[1:]:
                if offer[0] < best[0] or (
                    offer[0] == best[0]
                    and _before(before[offer[1]].branch, offer[2], before[best[1]].branch, best[2])
                ):
                    best = offer
            cost, origin, edit, line = best
            old = before[origin]
            digest = old.digest
            if line is not None:
                digest = digest.copy()
                digest.update(b"\n" + line if old.given else line)
            branch = Branch(old.branch, edit) if edit else old.branch
            after[state] = Survivor(cost, branch, digest, old.given or line is not None)
        for old in before.values():
            old.branch.release()
        self.live = after

    def row(self, role: str, text: bytes, must_go: bool, truncated: bool) -> None:
        moves: dict[int, list] = {}
        for state, old in self.live.items():
            moves.setdefault(state, []).append((old.cost + DELETE_COST, state, bytes([DELETE]), None))
            if must_go:
                continue
            cost = old.cost + TRUNCATED_COST * truncated
            if (target := NEXT[state].get(role[:1])) is not None:
                moves.setdefault(target, []).append((cost, state, bytes([KEEP]), role.encode() + b":" + text))
            name, target = GIVEN[state]
            moves.setdefault(target, []).append((cost + REROLE_COST, state, bytes([REROLE]), name + b":" + text))
        self._move(moves)
        self._insert()
        self._settle()

    def _insert(self) -> None:
        for targets in ((USER,), (ASSISTANT,)):
            moves = {state: [(old.cost, state, b"", None)] for state, old in self.live.items()}
            for state, old in self.live.items():
                name, target = GIVEN[state]
                if target in targets:
                    moves.setdefault(target, []).append(
                        (old.cost + INSERT_COST, state, bytes([INSERT]), name + b":")
                    )
            self._move(moves)

    def _settle(self) -> None:
        cost = {state: old.cost for state, old in self.live.items()}
        for state in list(self.live):
            if any(c + EXTRA[y][state] < cost[state] for y, c in cost.items() if y != state):
                self.live.pop(state).branch.release()
        for old in self.live.values():
            old.branch.merge_single()
        root = next(iter(self.live.values())).branch.path()[0]
        self.emitted += root.edits
        root.edits = bytearray()
        self.most_open = max(self.most_open, sum(len(n.edits) for n in self._branches()))

    def _branches(self) -> set[Branch]:
        return {node for old in self.live.values() for node in old.branch.path()}

    def finish(self) -> tuple[int, str, str]:
        """(cost, edits, hash of the repaired rows)."""
        ends = [self.live[s] for s in (NOTHING, ASSISTANT) if s in self.live]
        best = ends[0]
        for end in ends[1:]:
            if end.cost < best.cost or end.cost == best.cost and _before(end.branch, b"", best.branch, b""):
                best = end
        edits = self.emitted + b"".join(bytes(n.edits) for n in best.branch.path())
        return best.cost, edits.decode(), best.digest.hexdigest()


class Conversation:
    """Counts of one conversation's faults, and its repair."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None
        self.repair = Repair()

    def add(self, turn: int | None, role: str, text: bytes, repeated: bool) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LAWFUL
        self.initial = role[:1]
        words = text.rstrip(WHITE)
        blank = not words
        duplicate = repeated and not blank
        truncated = not blank and not duplicate and words[-1:] not in (b".", b"!", b"?")
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.repair.row(role, text, blank or duplicate, truncated)

    def report(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (
            self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal,
            *self.repair.finish(), self.repair.most_open,
        )


def _repair_stream(schema: pa.Schema):
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for conv_id, turn, role, text, absent, repeated in rows_of(batches):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.report())
                now = Conversation(conv_id)
                if len(done) >= 2000:
                    yield arrow_rows(schema, done)
                    done = []
            if not absent:
                now.add(turn, role, text, repeated)
        if now is not None:
            done.append(now.report())
        if done:
            yield arrow_rows(schema, done)

    return repair


def _apply_stream(schema: pa.Schema):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        conv_id = edits = None
        at = place = state = 0

        def given(letter: str, role: str | None, text: bytes | None) -> tuple:
            nonlocal place, state
            name, target = GIVEN[state]
            if letter == "K":
                name, target = role.encode(), NEXT[state][role[:1]]
            state, place = target, place + 1
            return (conv_id, place, letter, name.decode(), (text or b"").decode("utf-8", "replace"))

        def inserts() -> Iterator[tuple]:
            nonlocal at
            while at < len(edits) and edits[at] == "I":
                at += 1
                yield given("I", None, None)

        for own_id, audit, role, text in rows_of(batches):
            if audit is not None:
                conv_id, edits, at, place, state = own_id, audit, 0, 0, NOTHING
                out += inserts()
                continue
            letter = edits[at]
            at += 1
            if letter != "D":
                out.append(given(letter, role, text))
                size += len(text)
            out += inserts()
            if len(out) >= 2000 or size > 4_000_000:
                yield arrow_rows(schema, out)
                out, size = [], 0
        if out:
            yield arrow_rows(schema, out)

    return apply


def _ordered(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, absent: Column):
    space = F.lit(" ")
    return conversations.select(
        F.col(f"`{id_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), space).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), space).cast("binary").alias("text"),
        F.coalesce(absent, F.lit(False)).alias("absent"),
    )


def repair_report(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    absent: Column | None = None,
) -> DataFrame:
    """Per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, most_open.

    A conversation's rows are taken by turn, nulls first, rows of one turn by role and text.
    A null role or text is one space. Rows for which ``absent`` holds are not there, but their
    conversation is reported; one without rows has zeros, an empty audit and the hash of nothing.
    Blank rows and repeats of an earlier role and text must be deleted (3); others may be kept, or given
    the role user or assistant (2), and cost 1 more if their last character but white space is
    not ``.``, ``!`` or ``?``; empty user and assistant rows may be inserted (2). The audit is
    the cheapest edits' initials, ASCII-least among ties. ``most_open`` is the most edits that were
    undecided at a time. A null id is a conversation of its own. Other columns are not read. An
    empty table gives an empty result.
    """
    rows = _ordered(conversations, id_col, turn_col, role_col, text_col, F.lit(False) if absent is None else absent)
    same = F.sha2(F.concat(F.col("role").cast("binary"), F.lit(b"\0"), F.col("text")), 256)
    earlier = Window.partitionBy("conv_id", "absent", same).orderBy(F.col("turn").asc_nulls_first())
    rows = (
        rows.repartition("conv_id")
        .withColumn("repeated", F.row_number().over(earlier) > 1)
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "repeated")
        .select("conv_id", "turn", "role", "text", "absent", "repeated")
    )
    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    kind = rows.schema["conv_id"].dataType.simpleString()
    result = f"conv_id {kind}, {counts}, audit string, repaired_sha256 string, most_open long"
    report = rows.mapInArrow(_repair_stream(_arrow_schema(rows, result)), result)
    return report.withColumnRenamed("conv_id", id_col)


def repaired_turns(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The repaired rows: conversation id, place (1, 2, …), edit (K, R or I), role and text.

    The audits of ``repair_report`` are applied to the rows in a second streamed pass. Nulls and
    empty tables as there.
    """
    rows = _ordered(conversations, id_col, turn_col, role_col, text_col, F.lit(False))
    report = repair_report(conversations, id_col, turn_col, role_col, text_col)
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select("conv_id", "turn", none("string").alias("audit"), "role", "text").unionByName(
        report.select(
            F.col(f"`{id_col}`").alias("conv_id"),
            none("long").alias("turn"),
            "audit",
            none("string").alias("role"),
            none("binary").alias("text"),
        )
    )
    both = (
        both.repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text")
        .select("conv_id", "audit", "role", "text")
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    result = f"conv_id {kind}, place long, edit string, role string, text string"
    return both.mapInArrow(_apply_stream(_arrow_schema(rows, result)), result).withColumnRenamed("conv_id", id_col)


def _arrow_schema(rows: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults that the crc32 of ``conv_id:turn`` modulo 20 deals out; nulls are one space.

    0 marks the row ``gone``, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats the row,
    4 makes its role user.
    """
    space = F.lit(" ")
    part = lambda name: F.coalesce(F.col(name).cast("string"), space)
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "")
        .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
