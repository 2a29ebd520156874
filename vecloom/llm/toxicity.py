"""Toxicity: a support vector machine on a gappy subsequence string kernel, by Nyström.

The kernel counts common subsequences of three letters, damped by the span they stretch
over (at most ``SPAN`` characters), so gapped and inserted characters lower it only a
little. It compares *windows*: the words of a sentence, adjacent short pieces and runs of
single letters joined, long words cut. Letters are folded first (case, accents, digits
written for letters); any other character only stretches spans. A word with characters put
between or in front of its letters, or with its letters repeated, is compared a second time
without them.

Labelled sentences give the windows to learn from: those that sentences of toxic documents
have far more often, against those of clean documents. Landmark windows span the Nyström
space, the machine is trained in it, and two rounds of hard negatives (the windows of clean
sentences it likes best) and missed positives (the best windows that several missed documents
share) follow. Because the kernel has an explicit
space of letter triples, the trained machine folds into one weight per triple: a window
costs a few dozen look-ups, a document the largest margin among its windows, and a logistic
curve fitted on training documents turns that into a score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.packed import arrow_rows, as_bytes, crc_mod, id_and_text, rows_of, small_slices
from vecloom.session import cut_lineage

FOLDS = 5
HELD_OUT_FOLD = 0
#: Bound of the labelled documents that are learned from, per class.
SAMPLE_DOCS = 6000
LANDMARKS = 160
DAMP = 0.7
SPAN = 6
LENGTH = 16
LETTERS = 27
CACHE_WORDS = 500_000
NO_WINDOW = -3.0

#: Characters that are written for letters.
WRITTEN_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "ß": "s"}
_SENTENCE = re.compile(rb"[.!?]+[\s]+|\n")
_OUTER = ".,;:!?\"'()[]{}<>*#%&$-_~"
_PUNCTUATION = _OUTER.replace("$", "")
_WRITTEN = re.compile("[" + "".join(WRITTEN_FOR) + "]")
_REPEATED = re.compile(r"(.)\1+")
#: Adjacent words of at most so many bytes are also compared joined.
PIECE_BYTES = 4
#: Share of clean documents from which on a short word is an ordinary one; two of those are not joined.
ORDINARY_SHARE = 0.001
_OFFSETS = [(i, j) for i in range(1, SPAN - 1) for j in range(1, SPAN - i)]


def fold(word: bytes) -> str:
    """Lower case, without accents, outer punctuation stripped; digits read as letters.

    Digits are read so in a word that has as many letters at least, or whose letters and
    digits alternate: "1d107" is read, numbers and names such as "w5074" stay as they are.
    """
    text = word.decode("utf-8", "replace").lower()
    plain = text.strip(_PUNCTUATION)
    if plain.isascii():
        if plain.isalpha():
            return plain
    else:
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    if _WRITTEN.search(text):
        kinds = [c in WRITTEN_FOR for c in text if c in WRITTEN_FOR or c.isalpha()]
        written = sum(kinds)
        alternating = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) > 1
        if 0 < written < len(kinds) and (2 * written <= len(kinds) or alternating):
            text = "".join(WRITTEN_FOR.get(c, c) for c in text)
    return text.strip(_OUTER)


def readings(word: bytes) -> list[str]:
    """The folded word; its letters alone if there is more in it; repeated letters as one.

    Letters count as repeated on purpose if one stands three times in a row or half of them
    at least are repeated; "committee" with three of six is read both ways.
    """
    text = fold(word)
    found = [text]
    if not text.isalpha():
        text = "".join(filter(str.isalpha, text))
        if len(text) > 2:
            found.append(text)
    runs = _REPEATED.findall(text)
    if runs:
        once = _REPEATED.sub(r"\1", text)
        if len(once) > 2 and (2 * len(runs) >= len(once) or any(c * 3 in text for c in runs)):
            found.append(once)
    return found


def windows(word: str) -> list[str]:
    """A folded word as windows of at most LENGTH characters."""
    if len(word) <= LENGTH:
        return [word]
    return [word[at : at + LENGTH] for at in range(0, len(word) - LENGTH // 2, LENGTH // 2)]


def word_windows(word: bytes) -> list[str]:
    """All windows of a word of bytes."""
    return [window for reading in readings(word) for window in windows(reading)]


def _runs(mask: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of true values."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).reshape(-1, 2)


@lru_cache(100_000)
def _is_single(word: bytes) -> bool:
    """Whether a short word is one character, punctuation aside."""
    return len(fold(word)) <= 1


def spelled_out(words: list[bytes]) -> list[bytes]:
    """Runs of three and more single letters, accented or with punctuation, as in "i d i o t", joined."""
    single = np.fromiter(map(len, words), np.int64, len(words)) <= 3
    short = np.flatnonzero(single)
    single[short] = [_is_single(words[i]) for i in short.tolist()]
    return [b"".join(words[a:b]) for a, b in _runs(single).tolist() if b - a >= 3]


class Ordinary(dict):
    """Whether a short word is an ordinary one (or a number); written forms are remembered."""

    def __init__(self, words: frozenset[str] = frozenset()):
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> bool:
        folded = fold(word)
        self[word] = found = folded in self.words or not any(map(str.isalpha, folded))
        return found


def short_pairs(words: list[bytes], ordinary: Ordinary) -> list[bytes]:
    """Adjacent words of at most ``PIECE_BYTES`` bytes, four at least together, joined ("id iot").

    Two ordinary words are not joined.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    joined = []
    for i in np.flatnonzero((sizes[:-1] <= PIECE_BYTES) & (sizes[1:] <= PIECE_BYTES) & (sizes[:-1] + sizes[1:] >= 4)).tolist():
        if not (ordinary[words[i]] and ordinary[words[i + 1]]):
            joined.append(words[i] + words[i + 1])
    return joined


def compared(words: list[bytes], ordinary: Ordinary) -> set[bytes]:
    """What is compared of a text: its words and its joined pieces."""
    return {*words, *spelled_out(words), *short_pairs(words, ordinary)}


class Triples:
    """The explicit feature space of the kernel: letter triples of windows, with weights."""

    @staticmethod
    def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, weights), a row for each window; code 0 is no triple."""
        letters = np.zeros((len(texts), LENGTH), np.int64)
        raw = "".join(t.ljust(LENGTH)[:LENGTH] for t in texts).encode("ascii", "replace")
        letters[:] = np.frombuffer(raw, np.uint8).reshape(-1, LENGTH)
        letters = np.where((letters >= 97) & (letters <= 122), letters - 96, 0)
        codes, weights = [], []
        for i, j in _OFFSETS:
            n = LENGTH - i - j
            a, b, c = letters[:, :n], letters[:, i : i + n], letters[:, i + j : i + j + n]
            codes.append(np.where((a > 0) & (b > 0) & (c > 0), (a * LETTERS + b) * LETTERS + c, 0))
            weights.append(np.full(n, DAMP ** (i + j + 1)))
        return np.concatenate(codes, axis=1), np.concatenate(weights)

    @staticmethod
    def norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Square roots of the windows' kernels with themselves."""
        order = np.argsort(codes, axis=1)
        codes = np.take_along_axis(codes, order, axis=1)
        values = np.where(codes > 0, weights[order], 0.0)
        width = codes.shape[1]
        key = (np.arange(len(codes))[:, None] * LETTERS**3 + codes).ravel()
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sums = np.add.reduceat(values.ravel(), starts) ** 2 if len(key) else np.empty(0)
        return np.sqrt(np.bincount(starts // width, sums, len(codes)))

    @classmethod
    def dense(cls, texts: list[str]) -> np.ndarray:
        """Normalised feature vectors of a few windows."""
        codes, weights = cls.codes(texts)
        out = np.zeros((len(texts), LETTERS**3), np.float32)
        np.add.at(out, (np.arange(len(texts))[:, None], codes), weights[None, :])
        out[:, 0] = 0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


    @classmethod
    def kernels(cls, texts: list[str], base: np.ndarray) -> np.ndarray:
        """Kernels of windows (rows) with the windows whose dense features are the rows of ``base``."""
        columns = np.ascontiguousarray(base.T)
        out = np.zeros((len(texts), len(base)))
        for start in range(0, len(texts), 256):
            codes, weights = cls.codes(texts[start : start + 256])
            norms = cls.norms(codes, weights)
            found = np.einsum("ncl,c->nl", columns[codes], weights)
            out[start : start + 256] = found / np.where(norms > 0, norms, 1)[:, None]
        return out


class Machine:
    """Trained weights of all triples, the bias, and the words that are not joined in pairs."""

    def __init__(self, weights: np.ndarray, bias: float, ordinary: frozenset[str] = frozenset()):
        self.ordinary = ordinary
        self.weights = weights.astype(np.float64)
        self.weights[0] = 0.0
        self.bias = bias

    def margins(self, texts: list[str]) -> np.ndarray:
        codes, damp = Triples.codes(texts)
        norms = Triples.norms(codes, damp)
        return (self.weights[codes] @ damp) / np.where(norms > 0, norms, 1) + self.bias


class DocumentMargins:
    """Largest margin of a text's windows; words are remembered, those not seen lately go."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.stores: list[dict[bytes, float]] = [{}, {}]
        self.ordinary = Ordinary(machine.ordinary)

    def known(self, words: set[bytes]) -> dict[bytes, float]:
        if len(self.stores[0]) > CACHE_WORDS:
            self.stores = [{}, self.stores[0]]
        new, old = self.stores
        todo = []
        for word in words:
            if word not in new:
                if (margin := old.get(word)) is None:
                    todo.append(word)
                else:
                    new[word] = margin
        for start in range(0, len(todo), 10_000):
            part = todo[start : start + 10_000]
            texts, owner = [], []
            for number, word in enumerate(part):
                for window in word_windows(word):
                    texts.append(window)
                    owner.append(number)
            best = np.full(len(part), NO_WINDOW)
            np.maximum.at(best, owner, self.machine.margins(texts))
            new.update(zip(part, best.tolist(), strict=True))
        return new

    def of(self, texts: list[bytes]) -> list[float]:
        split = [text.split() for text in texts]
        each = [compared(words, self.ordinary) for words in split]
        known = self.known(set().union(*each))
        return [max(map(known.__getitem__, words), default=NO_WINDOW) for words in each]


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 4_000_000) -> Iterator[list[tuple]]:
    rows, length = [], 0
    for row in rows_of(batches):
        rows.append(row)
        length += len(row[1] or b"")
        if length > size:
            yield rows
            rows, length = [], 0
    if rows:
        yield rows


def _short_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents) of folded short words."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    for rows in _chunks(batches):
        counts = Counter()
        for _, text, _ in rows:
            counts.update({fold(w) for w in {*(text or b"").split()} if len(w) <= PIECE_BYTES})
        yield arrow_rows(schema, list(counts.items()))


def _window_counts(words: frozenset[str]):
    """(window, toxic sentences, clean sentences) of labelled documents; ``words`` are ordinary ones."""
    schema = pa.schema([("window", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def window_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = Ordinary(words)
        for rows in _chunks(batches):
            counts = [Counter(), Counter()]
            folded: dict[bytes, list[str]] = {}
            for _, text, toxic in rows:
                for sentence in _SENTENCE.split(text or b""):
                    found = set()
                    for word in compared(sentence.split(), ordinary):
                        if word not in folded:
                            folded[word] = [w for w in word_windows(word) if len(w) > 2]
                        found.update(folded[word])
                    counts[1 - toxic].update(found)
            yield arrow_rows(schema, [(w, counts[0][w], counts[1][w]) for w in {*counts[0], *counts[1]}])

    return window_counts


def _best_windows(machine: Machine):
    """(window, toxic, n): of each labelled document the window with the largest margin."""
    schema = pa.schema([("window", pa.string()), ("toxic", pa.int32()), ("margin", pa.float64()), ("doc_id", pa.int64())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = DocumentMargins(machine)
        for rows in _chunks(batches):
            out = []
            split = [text.split() if text else [] for _, text, _ in rows]
            each = [compared(words, margins.ordinary) for words in split]
            known = margins.known(set().union(*each))
            for (doc_id, _, toxic), words in zip(rows, each, strict=True):
                top = max(words, key=lambda w: (known[w], w), default=b"")
                parts = word_windows(top)
                window = parts[int(np.argmax(machine.margins(parts)))]
                out.append((window, int(toxic), known.get(top, NO_WINDOW), doc_id))
            yield arrow_rows(schema, out)

    return best


def train_machine(
    positive: dict[str, float], negative: dict[str, float], landmarks: int, ordinary: frozenset[str] = frozenset(), rounds: int = 300
) -> Machine:
    """Linear support vector machine (squared hinge) on Nyström features of weighted windows."""
    texts = [*positive, *negative]
    labels = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    weight = np.array([*positive.values(), *negative.values()], np.float64)
    for sign in (1, -1):
        if (of := labels == sign).any():
            weight[of] /= weight[of].sum()
    base = _landmarks(texts, labels, weight, landmarks)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    x = Triples.kernels(texts, base) @ whiten
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    # Newton steps of the primal problem: only windows inside the margin count.
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 3e-4)
    ridge[-1] = 1e-8
    active = None
    for _ in range(rounds):
        inside = labels * (x @ w) < 1
        if active is not None and (inside == active).all():
            break
        active = inside
        xa, wa = x[inside], weight[inside]
        w = np.linalg.solve((xa * wa[:, None]).T @ xa + np.diag(ridge), (xa * wa[:, None]).T @ labels[inside])
    return Machine(base.T.astype(np.float64) @ (whiten @ w[:-1]), float(w[-1]), ordinary)


def _landmarks(texts: list[str], labels: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Dense features of the heaviest windows of either class that are not near another landmark."""
    base = np.zeros((n, LETTERS**3), np.float32)
    used = 0
    for sign, until in ((1, 3 * n // 4), (-1, n)):
        for at in np.argsort(-weight, kind="stable").tolist():
            if used == until:
                break
            if labels[at] != sign:
                continue
            own = Triples.dense([texts[at]])
            codes = np.flatnonzero(own[0])
            if len(codes) and (not used or float((base[:used, codes] @ own[0, codes]).max()) < 0.95):
                base[used] = own[0]
                used += 1
    return base[:used]


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label), by Newton steps."""
    slope, offset = 2.0, 0.0
    share = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        gradient = np.array([((p - share) * margins).sum() + 1e-3 * slope, (p - share).sum()])
        curve = p * (1 - p) + 1e-9
        hessian = np.array([[(curve * margins**2).sum() + 1e-3, (curve * margins).sum()], [(curve * margins).sum(), curve.sum()]])
        step = np.linalg.solve(hessian, gradient)
        slope, offset = slope - step[0], offset - step[1]
        if abs(step).max() < 1e-6:
            break
    return max(slope, 1e-3), offset


class ToxicityModel:
    """A machine and its curve; small and picklable."""

    def __init__(self, machine: Machine, slope: float, offset: float):
        self.machine, self.slope, self.offset = machine, slope, offset

    def _scores(self):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            margins = DocumentMargins(self.machine)
            for rows in _chunks(batches):
                found = np.array(margins.of([text or b"" for _, text in rows]))
                score = 1 / (1 + np.exp(-np.clip(self.slope * found + self.offset, -700, 700)))
                yield arrow_rows(schema, list(zip([r[0] for r in rows], score.tolist(), strict=True)))

        return scores

    def _keep(self, text_col: str):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            margins = DocumentMargins(self.machine)
            for batch in small_slices(batches, text_col):
                found = np.array(margins.of(as_bytes(batch.column(text_col))))
                yield batch.filter(pa.array(self.slope * found + self.offset < 0, pa.bool_()))

        return keep

    def keep_clean(self, documents: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of ``documents``, all columns, that score below one half."""
        return documents.mapInArrow(self._keep(text_col), documents.schema)

    def transform(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score) of every row, in one pass without a shuffle."""
        return id_and_text(documents, id_col, text_col).mapInArrow(self._scores(), "doc_id long, score double")


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = FOLDS,
    held_out_fold: int = HELD_OUT_FOLD,
    sample_docs: int = SAMPLE_DOCS,
    landmarks: int = LANDMARKS,
) -> ToxicityModel:
    """Learn from labelled documents outside the held-out fold, ``sample_docs`` of each class at most.

    The sample is drawn by a hash of the id, so it does not depend on partitions. Labels that
    are null or of a null id are not used; of several labels of an id the largest counts.
    Without labels of both classes the model scores every text below one half.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(crc_mod(F.col("doc_id"), folds) != held_out_fold)
        .withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    )
    draw = F.xxhash64("doc_id", F.lit(7))
    sample = known.filter("toxic = 1").orderBy(draw).limit(sample_docs)
    sample = sample.union(known.filter("toxic = 0").orderBy(draw).limit(sample_docs))
    # Broadcast: at most twice sample_docs rows.
    docs = id_and_text(documents, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    docs = cut_lineage(docs, "labelled")
    clean = docs.filter("toxic = 0")
    often = max(2, ORDINARY_SHARE * clean.count())
    words = clean.mapInArrow(_short_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    ordinary = frozenset(r.word for r in words.filter(F.col("n") >= often).collect())
    counts = cut_lineage(
        docs.mapInArrow(_window_counts(ordinary), "window string, toxic long, clean long")
        .groupBy("window")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "windows",
    )
    total = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    nothing = ToxicityModel(Machine(np.zeros(LETTERS**3), -1.0), 1.0, 0.0)
    if not total[0] or not total[1]:
        return nothing
    # How many standard deviations a window is above its share of toxic sentences.
    share = total[0] / (total[0] + total[1])
    seen = F.col("toxic") + F.col("clean")
    above = (F.col("toxic") - seen * share) / F.sqrt(seen * share * (1 - share))
    strong = counts.filter((F.col("toxic") >= 2) & (F.col("toxic") >= 0.9 * seen)).withColumn("above", above)
    positive = {r.window: float(r.toxic) for r in strong.filter("above > 3.5").orderBy(F.desc("above"), "window").limit(1500).collect()}
    if not positive:
        return nothing
    negative = counts.filter((F.col("clean") > 0) & (above < 1))
    negatives = {r.window: float(r.clean) ** 0.5 for r in negative.orderBy(F.desc("clean"), "window").limit(1500).collect()}
    negatives |= {r.window: 1.0 for r in negative.orderBy(F.xxhash64("window"), "window").limit(4000).collect()}
    machine = train_machine(positive, negatives, landmarks, ordinary)
    columns = "window string, toxic int, margin double, doc_id long"
    for _ in range(2):
        best = docs.mapInArrow(_best_windows(machine), columns)
        feedback = best.filter("toxic = 0 and margin > -1 or toxic = 1 and margin < 0").groupBy("window", "toxic")
        feedback = cut_lineage(feedback.agg(F.count(F.lit(1)).alias("n")), "feedback")
        for row in feedback.filter("toxic = 0").orderBy(F.desc("n"), "window").limit(1500).collect():
            if row.window not in positive:
                negatives[row.window] = negatives.get(row.window, 0.0) + 2.0 + row.n**0.5
        # Missed toxic documents: what two of them at least have in common, and no clean sentence has.
        missed = feedback.filter("toxic = 1 and n > 1").join(counts.filter("clean = 0").select("window"), "window")
        for row in missed.orderBy(F.desc("n"), "window").limit(1500).collect():
            positive.setdefault(row.window, float(row.n))
        machine = train_machine(positive, negatives, landmarks, ordinary)
    pairs = docs.mapInArrow(_best_windows(machine), columns).select("margin", "toxic").toPandas()
    return ToxicityModel(machine, *_curve(pairs["margin"].to_numpy(), pairs["toxic"].to_numpy()))


def toxicity_scores(documents: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out_fold: int = HELD_OUT_FOLD) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5).

    Every whole text is scored; null, empty and letterless texts get the score of a text
    without any window. Rows with a null id are scored and have a null held_out. Repeated
    rows are scored each. Other columns are not read. An empty table gives an empty result.
    """
    model = fit_toxicity(documents, labels, folds=folds, held_out_fold=held_out_fold)
    return model.transform(documents).select(
        "doc_id",
        (crc_mod(F.col("doc_id"), folds) == held_out_fold).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
