import random
import zlib

import numpy as np

from tests.llm.cases import awkward_texts, prose, table
from vecloom.llm.toxicity import Ordinary, Triples, fit_toxicity, fold, readings, short_pairs, spelled_out, toxicity_scores, windows

INSULTS = ["grumblefool", "snotwizard", "bleakhead"]


def corpus():
    draw = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        text = prose(draw, 60, 300).replace("w", draw.choice(["mar", "tol", "ven"]))
        toxic = i % 6 == 0
        if toxic:
            cut = text.split()
            cut.insert(20, draw.choice(INSULTS))
            text = " ".join(cut)
        rows.append((i, text + ". And more."))
        labels.append((i, int(toxic), "extra"))
    return rows, labels


def brute_kernel(a, b, damp=0.7, span=6):
    def triples(word):
        found = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + span)):
                    key = word[i] + word[j] + word[k]
                    if key.isascii() and key.isalpha():
                        found[key] = found.get(key, 0) + damp ** (k - i + 1)
        return found

    x, y = triples(a), triples(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / max(1e-12, (dot(x, x) * dot(y, y)) ** 0.5)


def test_kernel_against_brute_force():
    texts = ["idiot", "i.d.i.o.t", "idxiot", "banana", "anaban", "aaaa", "ab", "scum-bag", "x" * 16]
    features = Triples.dense(texts)
    codes, weights = Triples.codes(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert abs(float(features[i] @ features[j]) - brute_kernel(a, b)) < 1e-5
    raw = [np.bincount(c, weights, 27**3)[1:] for c in codes]
    assert np.allclose(Triples.norms(codes, weights), [np.linalg.norm(r) for r in raw])


def test_folding():
    assert fold(b"!D1RTY") == "dirty" and fold("Été,".encode()) == "ete" and fold("Straße".encode()) == "strase"
    assert fold(b"w5074") == "w5074" and fold(b"1337") == "1337"
    assert fold(b"1d107") == "idiot" and fold(b"7r4$h") == "trash" and fold(b"4$$h0l3") == "asshole"
    assert spelled_out(b"you i d i o t now a b".split()) == [b"idiot"]
    assert spelled_out(b"shall i. d. \xc3\xad. o. t. shall".split()) == ["i.d.í.o.t.".encode()]
    ordinary = Ordinary(frozenset(["of", "id"]))
    assert short_pairs(b"shall of id iot 12 34 shall".split(), ordinary) == [b"idiot", b"iot12"]
    assert spelled_out([]) == short_pairs([], ordinary) == short_pairs([b"id"], ordinary) == []
    assert "idiot" in readings(b"i.d-i_o.t") and "idiot" in readings(b"iiddiioott") and "idiot" in readings(b"idiiiiot")
    assert readings(b"letter") == ["letter"] and readings(b"2024") == ["2024"]
    assert windows("abc") == ["abc"] and "".join(w[:8] for w in windows("x" * 40)) == "x" * 32


def test_held_out_and_obfuscated_insults(spark):
    rows, labels = corpus()
    labels = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    docs = table(spark, rows)
    found = {r.doc_id: r for r in toxicity_scores(docs, labels).collect()}
    assert len(found) == len(rows)
    for i, row in found.items():
        assert row.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert row.predicted == int(row.score >= 0.5) == int(i % 6 == 0)
    model = fit_toxicity(docs, labels)
    texts = ["you grumblefool", "you grum.ble.fool", "you grumblxefool", "a g r u m b l e f o o l", "Grumblefools!", "SN0TWIZARD"]
    plain = ["mar12 tol5 ven100", "good morning everyone", "", "a b c d"]
    scored = {r.doc_id: r.score for r in model.transform(table(spark, list(enumerate(texts + plain)))).collect()}
    assert all(scored[k] >= 0.5 for k in range(len(texts))), scored
    assert all(scored[len(texts) + k] < 0.5 for k in range(len(plain))), scored
    kept = model.keep_clean(table(spark, list(enumerate(texts + plain))))
    assert {r.doc_id for r in kept.collect()} == {len(texts) + k for k in range(len(plain))}


def test_awkward_rows(spark):
    rows, labels = corpus()
    labels = spark.createDataFrame([*labels, (None, 1, ""), (3, None, ""), (0, 1, "")], "doc_id long, toxic int, text string")
    docs = table(spark, rows + [(i and i + 5000, t) for i, t in awkward_texts()])
    found = toxicity_scores(docs, labels).collect()
    assert len(found) == len(rows) + len(awkward_texts())
    assert all(0 <= r.score <= 1 for r in found) and any(r.held_out is None for r in found)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity_scores(docs, none).collect()} == {0}
    assert toxicity_scores(docs.limit(0), none).collect() == []


VARIANTS = {
    "dots": lambda w: ".".join(w),
    "doubled": lambda w: "".join(c + c for c in w),
    "digits": lambda w: w.translate(str.maketrans("oieast", "013457")),
    "inserted": lambda w: w[: len(w) // 2] + "x" + w[len(w) // 2 :],
    "spelled": lambda w: ". ".join(w) + ".",
    "split": lambda w: w[: len(w) // 2] + " " + w[len(w) // 2 :],
}


def test_variants_of_insults_never_seen(spark):
    """Insults are learned plain; every written variant is found, clean texts of the same make are not."""
    insults = ["grumbol", "snatok", "blodik"]
    draw = random.Random(4)
    syllables = ["ha", "ver", "mi", "tun", "pel", "lu", "cor", "ne", "fi", "waz"]
    vocabulary = ["".join(draw.choices(syllables, k=draw.randrange(1, 5))) for _ in range(400)]
    prose = lambda draw, n: " ".join(draw.choices(vocabulary, k=n))
    rows, labels = [], []
    for i in range(600):
        words = prose(draw, 60).split()
        if i % 6 == 0:
            words.insert(draw.randrange(len(words)), draw.choice(insults))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    model = fit_toxicity(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    clean = [prose(draw, 60) for _ in range(60)]
    texts = {(w, name): f"{clean[0]} {make(w)} {clean[1]}" for w in insults for name, make in VARIANTS.items()}
    found = {r.doc_id: r.score for r in model.transform(table(spark, list(enumerate([*texts.values(), *clean])))).collect()}
    low = {key: found[k] for k, key in enumerate(texts) if found[k] < 0.5}
    assert not low, low
    assert all(found[len(texts) + k] < 0.5 for k in range(len(clean)))
    plain = [" ".join(make(w) for w in text.split()) for text in clean[:20] for make in (VARIANTS["dots"], VARIANTS["doubled"], VARIANTS["digits"])]
    scores = [r.score for r in model.transform(table(spark, list(enumerate(plain)))).collect()]
    assert sum(s < 0.5 for s in scores) >= 0.95 * len(scores), sorted(scores)[-10:]
