"""Every registered query with a SQL counterpart gives the same rows in DuckDB."""

import importlib.util
import os

import pytest

from vecloom.plans.catalog import all_queries
from vecloom.plans.oracles import all_oracles

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TOOL = os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools", "check_oracles.py")
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


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


def test_entry_is_the_profile(spark):
    spec = importlib.util.spec_from_file_location(
        "entry", os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py")
    )
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    df = entry.entry(spark)
    assert df.columns == ["cluster", "count", "percentage", "providers", "themes", "samples"]
    assert df.count() == 10
