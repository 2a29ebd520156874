import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vecloom.llm.hamming_search import hamming_top_k, sign_code
from vecloom.llm.url_filter import filter_urls, host_of

T = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
ENTRIES = [
    ("l", "bad.example", "block", T(10)),
    ("l", "bad.example", "clear", T(50)),
    ("l", "bad.example", "block", T(300)),
    ("l", "example", "block", T(100)),
    ("a", "good.example", "allow", T(0)),
    ("l", "mixed.org/Private", "block", T(5)),
    ("m", "mixed.org", "allow", T(5)),
    ("z", "tie.org", "allow", T(5)),
    ("y", "tie.org", "block", T(5)),
    ("l", "same.org", "block", T(7)),
    ("l", "same.org", "clear", T(7)),
    (None, "x.org", "block", T(1)),
    ("l", None, "block", T(1)),
    ("l", "x.org", "block", None),
]


def brute(captures):
    def state(key, when):
        found = []
        for name in sorted({e[0] for e in ENTRIES if e[0]}):
            own = [e for e in ENTRIES if e[0] == name and e[1] and e[3] and e[1].lower() == key and e[3] <= when]
            if own:
                last = max(e[3] for e in own)
                action = max((e[2] for e in own if e[3] == last), key=["clear", "allow", "block"].index)
                if action != "clear":
                    found.append((action == "allow", name, action, last))
        return sorted(found)

    out = []
    for page, url, when in captures:
        entry = None
        if url and when and "://" in url:
            host, _, path = url.split("://", 1)[1].partition("/")
            host = host.split("@")[-1].split(":")[0].lower().rstrip(".")
            labels, segments = host.split("."), [s for s in path.split("?")[0].split("#")[0].lower().split("/") if s]
            keys = [".".join(labels[i:]) + "".join("/" + s for s in segments[:n]) for i in range(len(labels)) for n in range(min(2, len(segments)) + 1)]
            hits = [(-len(k), *s, k) for k in keys for s in state(k, when)]
            if host and hits:
                entry = min(hits)
        out.append((page, url, entry is None or entry[3] != "block", entry and entry[2], entry and entry[5]))
    return sorted(out, key=repr)


def test_captures_against_brute_force(spark):
    draw = random.Random(2)
    hosts = ["bad.example", "www.bad.example", "good.example", "Deep.GOOD.example", "mixed.org", "tie.org", "same.org", "x.org", "free.net", "example"]
    captures = [
        (k, f"http://{draw.choice(['', 'me@'])}{draw.choice(hosts)}{draw.choice(['', ':80'])}{draw.choice(['', '/', '/private', '/PRIVATE/x?y=/z', '/open/private#f'])}", T(draw.randrange(-5, 400)))
        for k in range(400)
    ]
    captures += [captures[0], (900, None, T(9)), (901, "relative/path", T(9)), (902, "http://bad.example", None), (None, "http://bad.example/", T(20)), (903, "", T(1))]
    rows = spark.createDataFrame([(*c, "key", 5) for c in captures], "page_id long, url string, fetched_at timestamp, key string, month int")
    entries = spark.createDataFrame([(*e, 1) for e in ENTRIES], "list string, key string, action string, listed_at timestamp, url int")
    found = filter_urls(rows, entries).collect()
    assert sorted([(r.page_id, r.url, r.kept, r.list, r.key) for r in found], key=repr) == brute(captures)
    assert filter_urls(rows, entries.limit(0)).filter("not kept").count() == 0
    assert filter_urls(rows.limit(0), entries).collect() == []


def test_keys_of_any_depth(spark):
    entries = [("l", "a.org/1/2/3/4/5", "block", T(0)), ("l", "org/1/2/3", "block", T(0)), ("l", "a.org/1/2/3/ok", "allow", T(0))]
    urls = {
        "http://a.org/1/2/3/4/5/6": "a.org/1/2/3/4/5", "http://a.org/1//2/3/x": "org/1/2/3", "http://a.org/1/2/3/OK/y": "a.org/1/2/3/ok",
        "http://b.org/1/2/3": "org/1/2/3", "http://a.org/1/2": None, "http://a.org": None,
    }
    captures = spark.createDataFrame([(k, u, T(9)) for k, u in enumerate(urls)], "page_id long, url string, fetched_at timestamp")
    found = filter_urls(captures, spark.createDataFrame(entries, "list string, key string, action string, listed_at timestamp"))
    rows = found.collect()
    assert {r.url: r.key for r in rows} == urls
    assert {r.url for r in rows if not r.kept} == {u for u, k in urls.items() if k and "ok" not in k}


def test_hosts(spark):
    urls = {"HTTP://U:p@A.b.:8080/x": "a.b", "ftp://h": "h", "//h/x": None, "mailto:x": None, "http://": None}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host_of(F.col("url")).alias("h"))
    assert {r.url: r.h for r in rows.collect()} == urls


@pytest.mark.parametrize(("n", "spread", "k"), [(300, 64, 10), (200, 6, 5), (6, 64, 10), (400, 20, 3)])
def test_top_k_against_brute_force(spark, n, spread, k):
    draw = random.Random(n)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = draw.getrandbits(64)
    codes = []
    for i in range(n):
        code = base
        for _ in range(draw.randrange(spread)):
            code ^= 1 << draw.randrange(64)
        codes.append((i, signed(code)))
    codes += [(1000 + i, codes[0][1]) for i in range(15)] + [(None, 5), (77_000, None), codes[1]]
    rows = spark.createDataFrame([(*c, "x") for c in codes], "id long, code long, segment string")
    found = defaultdict(list)
    for r in hamming_top_k(rows, rows.filter("id % 20 = 0"), k=k).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.distance, r.neighbour_id))
        assert r.rank == len(found[r.query_id])
    whole = {(i, c) for i, c in codes if i is not None and c is not None}
    for i, c in whole:
        if i % 20 == 0:
            assert found.pop(i, []) == sorted((bin((c ^ d) & (2**64 - 1)).count("1"), j) for j, d in whole if j != i)[:k]
    assert not found
    assert hamming_top_k(rows.limit(0), rows).collect() == []


def test_sign_codes(spark):
    vectors = [([1.0] * 64,), ([-1.0] * 63 + [1.0],), ([1.0],), (None,), ([1.0, None] * 32,), ([0.0] * 64,)]
    found = [r.c for r in spark.createDataFrame(vectors, "v array<double>").select(sign_code(F.col("v")).alias("c")).collect()]
    assert found == [-1, -(1 << 63), None, None, None, 0]
