"""Run every registered query and its SQL side by side: check_oracles.py [folder] [names…]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from vecloom.plans.catalog import all_queries  # noqa: E402
from vecloom.plans.oracles import all_oracles  # noqa: E402
from vecloom.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.10g}"
    return value


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(repr(_norm(r[i])) for i in order) for r in rows)
    )


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only: {len(got[1])}", True
    cursor = con.execute(sql)
    want = table_of([d[0] for d in cursor.description], cursor.fetchall())
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    duck = {d[0]: str(d[1]) for d in cursor.description}
    odd = {c: (kinds[c], duck.get(c)) for c in kinds if not _same_kind(kinds[c], duck.get(c, ""))}
    note = f" types {odd}" if odd else ""
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}", False
    if got[1] != want[1]:
        only_got = [r for r in got[1] if r not in set(want[1])][:2]
        only_want = [r for r in want[1] if r not in set(got[1])][:2]
        return f"rows {len(got[1])} vs {len(want[1])}\n   spark {str(only_got)[:600]}\n   sql   {str(only_want)[:600]}", False
    return f"ok {len(got[1])} rows{note}", not odd


def _same_kind(spark_type: str, duck_type: str) -> bool:
    pairs = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "float": "FLOAT",
    }
    return pairs.get(spark_type, spark_type).upper() == duck_type.upper()


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8, driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), all_oracles(), []
    for name, query in all_queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            text, good = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as failure:
            text, good = f"{type(failure).__name__}: {str(failure)[:1500]}", False
        if not good:
            bad.append(name)
        print(f"{'PASS' if good else 'FAIL'} {name} {time.time() - start:.1f}s {text}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
