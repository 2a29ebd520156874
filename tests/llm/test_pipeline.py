import random
from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm.cases import prose, words
from tests.llm.test_dedup import brute_lines
from tests.llm.test_decontamination import brute_tiles
from tests.llm.test_jaccard import brute_components
from vecloom.llm.decontamination import tokens_of
from vecloom.llm.toxicity import fit_toxicity

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(12)
    root = tmp_path_factory.mktemp("tables")
    items = [(k, prose(draw, 25, 100_000)) for k in range(5)]
    rows, labels = [], []
    for i in range(240):
        text = f"{prose(draw, 50, 8000)}.\nFooter of the site\n{prose(draw, 20, 8000)}"
        toxic = i % 8 == 0
        if toxic:
            own = text.split(" ")
            own.insert(10, draw.choice(["grumblefool", "snotwizard"]))
            text = " ".join(own)
        rows.append([i, text])
        labels.append((i, 1, int(toxic)))
    rows += [[300 + k, rows[2 * k + 1][1]] for k in range(20)]
    rows += [[330 + k, rows[2 * k + 3][1] + " tail"] for k in range(20)]
    rows += [[400 + k, f"{prose(draw, 30, 8000)} {items[k][1]}"] for k in range(5)]
    rows += [[500, None], [501, ""], [None, "no id here"], [400, rows[9][1]], [77, rows[77][1]]]
    docs = [(i, t, "en", "src", len(t) if t is not None else None) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = docs.schema
    key = lambda r: (repr(r.doc_id), repr(r.text))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]

    left = stages["toxicity"](spark, docs, folder)
    before, rows = docs.collect(), left.collect()
    assert left.schema == schema
    insults = ("grumblefool", "snotwizard")
    assert sorted(rows, key=key) == sorted([r for r in before if not any(x in (r.text or "") for x in insults)], key=key)

    before, left = rows, stages["line_dedup"](spark, left, folder)
    rows = left.collect()
    want = brute_lines([(r.doc_id, r.text) for r in before], 10, 1)
    assert left.schema.names == schema.names
    assert sorted([(r.doc_id, r.text) for r in rows], key=repr) == sorted([(w[0], w[3]) for w in want], key=repr)
    assert all(r.n_chars == len(r.text) for r in rows) and sum(w[2] for w in want) > 100

    before, left = rows, stages["jaccard_join"](spark, left, folder)
    rows = left.collect()
    first = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in before], 5, 4, 5) if i is not None and i == c}
    want = {(r.doc_id, r.text) for r in before if r.doc_id is None or r.doc_id in first}
    assert sorted([(r.doc_id, r.text) for r in rows], key=repr) == sorted(want, key=repr)
    assert left.schema.names == schema.names

    before, left = rows, stages["decontamination"](spark, left, folder)
    rows = left.collect()
    items = [tokens_of(r.text.encode()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = lambda t: any(2 * sum(x[2] for x in brute_tiles(i, tokens_of(t.encode()), 5)) >= len(i) for i in items)
    assert sorted(rows, key=key) == sorted([r for r in before if not bad(r.text)], key=key)
    assert len(before) - len(rows) == 5

    pieces = stages["packing"](spark, left, folder).collect()
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p.doc_id] += p.length
    whole = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = defaultdict(int)
    for r in rows:
        want[r.doc_id] += len(whole.encode(r.text, add_special_tokens=False).ids) + 1
    assert dict(tokens) == dict(want)


def test_run_is_the_stages(spark, folder):
    kept = corpus_pipeline.run(spark, folder).collect()
    assert kept and {"doc_id", "start", "length", "sequence_id"} <= set(kept[0].asDict())
    assert corpus_pipeline.ORACLE_SQL is None


def test_model_is_small(spark, folder):
    model = fit_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert model.machine.weights.nbytes < 1 << 20 and words("a b") == ["a", "b"]
