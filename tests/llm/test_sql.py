"""The registered queries give the rows of their SQL in DuckDB; the others their contracts."""

import importlib.util
import os
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from vecloom.llm.oracles import all_oracles
from vecloom.llm.queries import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TOOL = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(__file__))), "tools", "check_oracles.py")
spec = importlib.util.spec_from_file_location("check_oracles", TOOL)
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_matches_sql(spark, duck, name):
    text, good = check.compare(spark, duck, name, all_queries()[name], all_oracles()[name], SF_DIR)
    assert good, text


def test_one_query_for_each_operator():
    names = [name for name in entry.queries() if name.startswith("op") and name[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(all_oracles()) <= set(entry.oracle_sql())


def test_url_filter_is_native(spark):
    plan = all_queries()["op1_url_filter"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_toxicity_of_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = [r for r in all_queries()["op7_toxicity"](spark, SF_DIR).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = [r.predicted == labels[r.doc_id] for r in rows if r.held_out]
    assert sum(right) / len(right) > 0.85


def test_reports_name_each_document_as_they_should(spark):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect())
    for name in ("op3_substring_dedup", "op4_interpolated_lm", "op5_line_dedup", "op7_toxicity", "op9_jaccard_join"):
        assert sorted(r.doc_id for r in all_queries()[name](spark, SF_DIR).select("doc_id").collect()) == ids, name
    tokens = defaultdict(int)
    for p in all_queries()["op8_packing"](spark, SF_DIR).collect():
        tokens[(p.doc_id, p.doc_tokens)] += p.length
    assert sorted(i for i, _ in tokens) == ids and all(n == total for (_, n), total in tokens.items())
