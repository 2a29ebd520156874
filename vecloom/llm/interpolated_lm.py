"""LM scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of all orders, from uniform to
``order``-grams. The mixture weights depend on how often the longest context was seen (one
set of weights for each power of two) and are learned by expectation-maximisation on the
counts of held-out training documents, against counts that leave those documents out. The
scores then use the counts of all training documents.

Documents are dealt to groups. A group asks, in one packed exchange, for the corpus counts
of its distinct n-grams, eight bytes an n-gram; the answer comes back in the order of the
question, so it needs no keys. A context of any frequency is one key per group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.packed import (
    RollingHash,
    arrow_rows,
    by_bucket,
    crc_mod,
    id_and_text,
    mix,
    narrow,
    rows_of,
    shuffles_end_with_their_job,
    widen,
    word_keys,
)
from vecloom.session import new_path

ORDER = 2
FOLDS = 10
HELD_OUT_FOLD = 0
WEIGHT_FOLD = 1
CLASSES = 40
EM_ROUNDS = 30
EM_GAIN = 1e-5
SMOOTH = 0.1
#: Bytes of text in a group of documents, and in a slice of it that a task works on.
GROUP_BYTES = 8_000_000
SLICE_BYTES = 1_000_000

_START = np.uint64(0x5354415254)
_END = np.uint64(0x454E44)
_ASK = "bucket int, gram_order int, doc_group int, keys binary, kept binary, held binary"
_ANSWER = (
    "doc_group int, gram_order int, bucket int, n long, kept binary, held binary, "
    "kept_total long, held_total long, kept_distinct long, all_distinct long"
)


def document_grams(text: bytes | None, order: int, roll: RollingHash) -> list[np.ndarray]:
    """Keys of the 1-grams, 2-grams, … that end at each token; the last token is the end."""
    keys = word_keys((text or b"").lower().split())
    padded = np.concatenate((np.full(order - 1, _START), keys, [_END]))
    return [
        mix(roll.windows(padded[order - n :], n) + np.uint64(n)) for n in range(1, order + 1)
    ]


def group_grams(texts: list, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    roll = RollingHash()
    parts = [document_grams(text, order, roll) for text in texts]
    lengths = np.array([len(p[0]) for p in parts], np.int64)
    return [np.concatenate([p[n] for p in parts]) for n in range(order)], lengths


def text_slices(texts: list, size: int) -> Iterator[slice]:
    """The texts in slices of about ``size`` bytes, one text at least."""
    start = held = 0
    for at, text in enumerate(texts):
        held += len(text or b"")
        if held >= size:
            yield slice(start, at + 1)
            start, held = at + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys of (keys, count, count, …) parts, with their counts added."""
    distinct, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return distinct, *(
        np.bincount(inverse, np.concatenate(column), len(distinct)).astype(np.int64)
        for column in list(zip(*parts, strict=True))[1:]
    )


def _ask(order: int, buckets: int, held_fold: int, weight_fold: int, slice_bytes: int):
    def ask(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        texts, folds = group["text"].tolist(), group["fold"].fillna(held_fold).to_numpy()
        parts: list[list[tuple]] = [[] for _ in range(order)]
        for some in text_slices(texts, slice_bytes):
            grams, lengths = group_grams(texts[some], order)
            fold = np.repeat(folds[some], lengths)
            held, kept = fold == weight_fold, (fold != weight_fold) & (fold != held_fold)
            for n, keys in enumerate(grams):
                distinct, inverse = np.unique(keys, return_inverse=True)
                counts = (np.bincount(inverse[rows], minlength=len(distinct)) for rows in (kept, held))
                parts[n].append((distinct, *counts))
        out = []
        for n in range(order):
            distinct, in_kept, in_held = _added(parts[n])
            parts[n] = []
            # Sorted keys are in the order of their buckets, which take the leading bits.
            _, there, starts = by_bucket(distinct, buckets)
            for number, a, b in zip(there.tolist(), starts[:-1], starts[1:], strict=True):
                out.append((number, n + 1, key[0], distinct[a:b].tobytes(), narrow(in_kept[a:b]), narrow(in_held[a:b])))
        return pd.DataFrame(out, columns=["bucket", "gram_order", "doc_group", "keys", "kept", "held"])

    return ask


def _answer(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
    sizes = [len(b) // 8 for b in asked["keys"]]
    keys = np.concatenate([np.frombuffer(b, np.uint64) for b in asked["keys"]])
    distinct, inverse = np.unique(keys, return_inverse=True)
    totals = []
    for column in ("kept", "held"):
        own = np.concatenate([widen(b, n) for b, n in zip(asked[column], sizes, strict=True)])
        totals.append(np.bincount(inverse, own, len(distinct)).astype(np.int64))
    kept, held = totals
    edges = np.cumsum([0, *sizes])
    out = []
    for at, doc_group in enumerate(asked["doc_group"]):
        mine = inverse[edges[at] : edges[at + 1]]
        totals_once = (kept.sum(), held.sum(), (kept > 0).sum(), (kept + held > 0).sum()) if at == 0 else (0, 0, 0, 0)
        out.append((doc_group, key[0], key[1], sizes[at], narrow(kept[mine]), narrow(held[mine]), *map(int, totals_once)))
    return pd.DataFrame(
        out,
        columns=[
            "doc_group", "gram_order", "bucket", "n", "kept", "held",
            "kept_total", "held_total", "kept_distinct", "all_distinct",
        ],
    )


def _places(keys: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of distinct keys, and each key's place among them in ascending order."""
    order = np.argsort(keys)
    ordered = keys[order]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1])), dtype=np.int32)
    return int(place[order[-1]]) + 1, place


class Counts:
    """Counts of the n-grams and contexts of some documents' tokens."""

    def __init__(self, grams: list[np.ndarray], lengths: np.ndarray, n_docs: int):
        self.grams, self.lengths = grams, lengths
        # The context of a token is the gram one order lower that ends at the token before.
        first = np.cumsum(lengths) - lengths
        self.contexts = []
        for gram in grams[:-1]:
            context = np.concatenate(([0], gram[:-1]))
            context[first] = n_docs
            self.contexts.append(context)

    @staticmethod
    def of_group(
        group: pd.DataFrame, answers: pd.DataFrame, order: int, with_held: bool, n_docs: int, slice_bytes: int
    ) -> Iterator[tuple[slice, Counts]]:
        """Counts of a group's documents from the answers to it, a slice of text at a time."""
        texts = group["text"].tolist()
        parts = [(some, *group_grams(texts[some], order)) for some in text_slices(texts, slice_bytes)]
        answers = answers.sort_values(["gram_order", "bucket"])
        edges = np.cumsum([0, *(len(grams[0]) for _, grams, _ in parts)])
        found = []
        for n in range(order):
            # Sorting tells each token its place in the question; looking every token up in it costs several times that.
            distinct, place = _places(np.concatenate([grams[n] for _, grams, _ in parts]))
            rows = answers[answers["gram_order"] == n + 1]
            totals = np.concatenate(
                [
                    widen(kept, size) + (widen(held, size) if with_held else 0)
                    for kept, held, size in zip(rows["kept"], rows["held"], rows["n"], strict=True)
                ]
            )
            if len(totals) != distinct:
                raise ValueError(f"{len(totals)} answers to {distinct} questions")
            found.append(totals[place])
        for (some, _, lengths), a, b in zip(parts, edges[:-1], edges[1:], strict=True):
            yield some, Counts([f[a:b] for f in found], lengths, n_docs)

    def estimates(self, tokens: int, distinct: int) -> np.ndarray:
        """Rows: uniform, then the maximum-likelihood estimates of order 1, 2, …"""
        rows = [np.full(len(self.grams[0]), 1 / (distinct + 1)), self.grams[0] / max(tokens, 1)]
        rows += [g / np.maximum(c, 1) for g, c in zip(self.grams[1:], self.contexts, strict=True)]
        return np.array(rows)

    def classes(self) -> np.ndarray:
        """Class of a token's longest context: 0 unseen, else 1 + log2 of its count."""
        longest = self.contexts[-1] if self.contexts else np.zeros(len(self.grams[0]), np.int64)
        return np.minimum(np.frexp(longest)[1], CLASSES - 1)


def _held_tokens(order: int, tokens: int, distinct: int, n_docs: int, slice_bytes: int):
    def held(key: tuple, group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(group):
            for _, counts in Counts.of_group(group, answers, order, False, n_docs, slice_bytes):
                estimates = counts.estimates(tokens, distinct)[1:].astype(np.float32)
                rows.append((counts.classes().astype(np.uint8).tobytes(), estimates.tobytes()))
        return pd.DataFrame(rows, columns=["classes", "estimates"])

    return held


def _expect(weights: np.ndarray, distinct: int):
    schema = pa.schema([("sums", pa.list_(pa.float64()))])

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = weights.shape[1]
        sums = np.zeros((CLASSES, orders + 1))
        for classes, estimates in rows_of(batches):
            of = np.frombuffer(classes, np.uint8)
            rows = np.frombuffer(estimates, np.float32).reshape(orders - 1, -1).astype(np.float64)
            parts = weights[of].T * np.concatenate((np.full((1, len(of)), 1 / (distinct + 1)), rows))
            total = parts.sum(axis=0)
            for n in range(orders):
                sums[:, n] += np.bincount(of, parts[n] / total, CLASSES)
            sums[:, -1] += np.bincount(of, np.log(total), CLASSES)
        yield arrow_rows(schema, [(sums.ravel().tolist(),)])

    return expect


def learn_weights(tokens: DataFrame, orders: int, distinct: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Expectation-maximisation over packed held-out tokens; a table of classes by orders.

    Each round is one pass; a task returns one small table of sums, and Spark adds them. A class without
    held-out tokens takes the weights of the class below it.
    """
    weights = np.full((CLASSES, orders), 1 / orders)
    before = None
    for _ in range(rounds):
        parts = tokens.mapInArrow(_expect(weights, distinct), "sums array<double>")
        total = parts.agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).first()["sums"]
        sums = np.array(total).reshape(CLASSES, orders + 1)
        mass = sums[:, :-1].sum(axis=1)
        seen = mass > 0
        weights[seen] = sums[seen, :-1] / mass[seen, None]
        likelihood = sums[:, -1].sum() / max(mass.sum(), 1)
        if before is not None and likelihood - before < EM_GAIN:
            break
        before = likelihood
    for number in range(1, CLASSES):
        if not seen[number]:
            weights[number] = weights[number - 1]
    # No order but the uniform one is positive for every token, so it keeps a little weight.
    weights = np.maximum(weights, 1e-6)
    return weights / weights.sum(axis=1, keepdims=True)


def _score(order: int, weights: np.ndarray, tokens: int, distinct: int, n_docs: int, slice_bytes: int):
    def scores(counts: Counts) -> dict[str, np.ndarray]:
        known = counts.grams[0]
        base = np.log10((known + SMOOTH) / (tokens + SMOOTH * (distinct + 1)))
        mixed = np.einsum("nt,tn->t", counts.estimates(tokens, distinct), weights[counts.classes()])
        first = np.cumsum(counts.lengths) - counts.lengths
        return {
            "n_tokens": counts.lengths,
            "n_known": np.add.reduceat((known > 0).astype(np.int64), first),
            "base_score": np.add.reduceat(base, first),
            "score": np.add.reduceat(np.log10(mixed), first),
        }

    def score(key: tuple, group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({name: [] for name in ("doc_id", "n_tokens", "n_known", "base_score", "score")})
        parts = [scores(c) for _, c in Counts.of_group(group, answers, order, True, n_docs, slice_bytes)]
        columns = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
        return pd.DataFrame({"doc_id": group["doc_id"].to_numpy(), **columns}).astype({"doc_id": "Int64"})

    return score


def interpolated_scores(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    folds: int = FOLDS,
    held_out_fold: int = HELD_OUT_FOLD,
    weight_fold: int = WEIGHT_FOLD,
    group_bytes: int = GROUP_BYTES,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end. Documents whose
    crc32(id as text) modulo ``folds`` is ``held_out_fold`` are not learned from; those of
    ``weight_fold`` train the weights first and then count as the others do.

    Null and empty texts are the end token alone. Rows with a null id are not learned from and
    have a null held_out. Repeated rows are counted and scored each. Without training rows every
    estimate is the uniform one. Other columns are not read. An empty table gives an empty result.

    A group holds about ``group_bytes`` of text, however large the table, and a task works on
    ``slice_bytes`` of it at a time.
    """
    spark = documents.sparkSession
    docs = id_and_text(documents, id_col, text_col).withColumn("fold", crc_mod(F.col("doc_id"), folds).cast("int"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    # A bucket's keys are worked on one order at a time, so it may hold those of two groups.
    buckets = -(-groups // 2)
    held_groups = max(1, groups // folds)
    # Rows that share an id are dealt by their text.
    deal = F.xxhash64("doc_id", "text")
    docs = docs.withColumn(
        "doc_group",
        F.when(F.col("fold") == weight_fold, groups + F.pmod(deal, F.lit(held_groups)))
        .otherwise(F.pmod(deal, F.lit(groups)))
        .cast("int"),
    )
    train = docs.filter(F.col("fold") != held_out_fold)
    n_all = train.count()
    n_kept = train.filter(F.col("fold") != weight_fold).count()
    with shuffles_end_with_their_job(spark):
        path = new_path(spark, "gram-counts")
        (
            docs.groupBy("doc_group")
            .applyInPandas(_ask(order, buckets, held_out_fold, weight_fold, slice_bytes), _ASK)
            .groupBy("gram_order", "bucket")
            .applyInPandas(_answer, _ANSWER)
            .write.parquet(path)
        )
        answers = spark.read.schema(_ANSWER).parquet(path)
        total = (
            answers.filter("gram_order = 1")
            .agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kept_total", "held_total", "kept_distinct", "all_distinct")))
            .first()
        )
        tokens = total["kept_total"] + total["held_total"]
        path = new_path(spark, "held-tokens")
        (
            docs.filter(F.col("fold") == weight_fold)
            .groupBy("doc_group")
            .cogroup(answers.filter(F.col("doc_group") >= groups).groupBy("doc_group"))
            .applyInPandas(
                _held_tokens(order, total["kept_total"], total["kept_distinct"], n_kept, slice_bytes),
                "classes binary, estimates binary",
            )
            .write.parquet(path)
        )
        held = spark.read.schema("classes binary, estimates binary").parquet(path)
        weights = learn_weights(held, order + 1, total["kept_distinct"])
    scored = (
        docs.groupBy("doc_group")
        .cogroup(answers.groupBy("doc_group"))
        .applyInPandas(
            _score(order, weights, tokens, total["all_distinct"], n_all, slice_bytes),
            "doc_id long, n_tokens long, n_known long, base_score double, score double",
        )
    )
    return scored.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), folds) == held_out_fold).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
