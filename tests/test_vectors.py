import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecloom.functions.vector import as_double, cosine
from vecloom.operators import clustering as C
from vecloom.operators import silhouette as B
from vecloom.operators import embedding as E
from vecloom.operators import ivf as I
from vecloom.operators import neighbours as N
from vecloom.operators import projection as V
from vecloom.operators import stats as Z

SCHEMA = "item_id long, title string, cluster int, embedding array<float>"


def random_vectors(spark, n, d, clusters, seed=5, copies=0):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n, d)).astype(np.float32)
    if copies:
        base[:copies] = base[0]  # a third of all rows may be copies of one vector
    rows = [
        (i, f"title {i % 7}", clusters(i), [float(x) for x in base[i]]) for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def brute_force(rows, n, same_cluster):
    v = np.array([r[3] for r in rows], dtype=np.float64)
    length = np.linalg.norm(v, axis=1)
    out = set()
    for i, a in enumerate(rows):
        if length[i] == 0:
            continue
        options = [
            (round(float(v[i] @ v[j] / length[i] / length[j]), 9), b[1], -b[0])
            for j, b in enumerate(rows)
            if i != j and length[j] > 0 and (not same_cluster or a[2] == b[2])
        ]
        options.sort(reverse=True)
        out |= {(a[0], rank + 1, -o[2], round(o[0], 6)) for rank, o in enumerate(options[:n])}
    return out


def found(df):
    return {(r.item_id, r["rank"], r.neighbour_id, round(r.similarity, 6)) for r in df.collect()}


@pytest.mark.parametrize("block_rows,max_pivots", [(8192, 2048), (16, 64), (16, 3)])
@pytest.mark.parametrize("copies", [0, 40])
def test_neighbours_equal_brute_force(spark, block_rows, max_pivots, copies):
    """One block, many pivots, and too few pivots; one cluster holds most rows."""
    rows, df = random_vectors(spark, 120, 6, lambda i: 0 if i % 5 else i % 3, copies=copies)
    options = {"block_rows": block_rows, "max_pivots": max_pivots}
    assert found(N.similar_items(df, 5, **options)) == brute_force(rows, 5, True)
    assert found(N.recommend_items(df, 4, **options)) == brute_force(rows, 4, False)


def test_pivots_skip_far_cells_without_changing_the_answer(spark, blobs):
    df = blobs(4, 30, 8)
    rows = [tuple(r) for r in df.collect()]
    got = N.recommend_items(df, 3, block_rows=20, max_pivots=50)
    assert found(got) == brute_force(rows, 3, False)


def test_singletons_zero_vectors_and_preview(spark):
    rows = [
        (1, "a", 0, [1.0, 0.0]), (2, "b", 0, [1.0, 0.0]), (3, "c", 0, [0.0, 0.0]),
        (4, "d", 1, [1.0, 1.0]), (5, "e", 0, [0.0, 1.0]), (6, "b", 0, [2.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = N.similar_items(df, 2)
    assert found(got) == brute_force(rows, 2, True)
    first = [(r.neighbour_id, r.neighbour_title) for r in got.filter("item_id = 1").orderBy("rank").collect()]
    assert first == [(2, "b"), (6, "b")]  # ties: title descending, then id
    lists = {r.item_id: r.similar for r in N.similar_lists(df, got).collect()}
    assert lists[4] == [] and lists[3] == [] and len(lists[1]) == 2
    preview = N.similar_items_preview(df, per_cluster=1, n=2)
    assert {r.item_id for r in preview.collect()} == {1}


def test_search_equals_ranking_by_hand(spark):
    rows, df = random_vectors(spark, 60, 5, lambda i: 0)
    q = [0.3, -1.0, 0.2, 0.0, 0.5]
    got = [r.item_id for r in N.semantic_search(df, [(7, q), (8, [0.0] * 5)], k=4).orderBy("rank").collect()]
    v = np.array([r[3] for r in rows], dtype=np.float64)
    want = np.argsort(-(v @ q) / np.linalg.norm(v, axis=1))[:4].tolist()
    assert got == want


def test_cosine_is_null_for_zero_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine(as_double(F.col("a")), as_double(F.col("b")))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] is None


@pytest.mark.parametrize("accuracy", [4, 20, 2000])
def test_exact_quantiles(spark, accuracy):
    draw = np.random.default_rng(1)
    a, b = np.round(draw.normal(size=101), 1), np.array([5.0] * 40 + [1.0] * 11)
    rows = [(0, float(x)) for x in a] + [(1, float(x)) for x in b]
    got = {
        r.dim: [r.q0, r.q1, r.q2]
        for r in Z.exact_quantiles(spark.createDataFrame(rows, "dim int, value double"), accuracy=accuracy).collect()
    }
    assert got[0] == pytest.approx(np.quantile(a, [0.25, 0.5, 0.75]).tolist())
    assert got[1] == pytest.approx(np.quantile(b, [0.25, 0.5, 0.75]).tolist())


def test_standardise_constant_dimension(spark):
    df = spark.createDataFrame([(1, [1.0, 7.0]), (2, [3.0, 7.0])], "item_id long, embedding array<float>")
    got = {r.item_id: r.embedding for r in Z.standardise(df).collect()}
    assert got == {1: [-1.0, 0.0], 2: [1.0, 0.0]}


def exact_silhouette(v, labels, square=False):
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    d = d**2 if square else d
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1 or len(set(labels)) == 1:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) if o != own)
        out.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("block_rows", [1000, 13])
def test_silhouettes(spark, block_rows):
    rows, df = random_vectors(spark, 60, 4, lambda i: i if i == 0 else 1 + i % 3)
    df = df.withColumn("other", (F.col("item_id") % 2).cast("int"))
    v = np.array([r[3] for r in rows], dtype=np.float64)
    got = C.silhouette_exact(df, ["cluster", "other"], block_rows=block_rows).collect()
    for name, labels in (("cluster", np.array([r[2] for r in rows])), ("other", np.arange(60) % 2)):
        mine = [r.silhouette for r in sorted(got, key=lambda r: r.item_id) if r.labelling == name]
        assert mine == pytest.approx(exact_silhouette(v, labels).tolist())
    fast = C.silhouette_fast(df).orderBy("item_id").collect()
    want = exact_silhouette(v, np.array([r[2] for r in rows]), square=True)
    assert [r.silhouette for r in fast] == pytest.approx(want.tolist())


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_bounded_silhouette_compares_fewer_and_gives_the_same(spark, blobs, block_rows):
    df = blobs(6, 30, 8).withColumn("other", F.col("item_id").cast("int") % 4)
    odd = spark.createDataFrame([(900, "one", 7, [9.0] * 8, 0), (901, "none", 7, None, 0)], df.schema)
    df = df.unionByName(odd).repartition(4)
    got = {(r.item_id, r.labelling): (r.cluster, round(r.silhouette, 9)) for r in B.silhouette_bounded(df, ["cluster", "other"], block_rows=block_rows).collect()}
    want = {(r.item_id, r.labelling): (r.cluster, round(r.silhouette, 9)) for r in C.silhouette_exact(df, ["cluster", "other"]).collect()}
    assert got == want and len(got) == 362
    work = {r.labelling: r for r in B.comparisons(df, ["cluster", "other"]).collect()}
    assert work["cluster"].compared < 0.5 * work["cluster"].pairs == 0.5 * 181**2
    assert work["other"].compared <= work["other"].pairs


def test_one_cluster_has_zero_silhouette(spark):
    _, df = random_vectors(spark, 5, 3, lambda i: 2)
    assert {r.silhouette for r in C.silhouette_exact(df).collect()} == {0.0}
    assert {r.silhouette for r in C.silhouette_fast(df).collect()} == {0.0}


def test_kmeans_recovers_planted_groups_and_k(spark, blobs):
    df = blobs(3, 25, 6)
    labelled = C.kmeans_clusters(df.withColumnRenamed("cluster", "planted"), 3, starts=3)
    pairs = {(r.planted, r.cluster) for r in labelled.collect()}
    assert len(pairs) == 3 and len({c for _, c in pairs}) == 3
    for metric in ("euclidean", "sq_euclidean"):
        curve = C.select_k(df, 2, 5, metric=metric, starts=3).collect()
        assert [r.k for r in curve if r.is_best] == [3]
    costs = C.fit_all(df, [2, 3, 4], starts=3)
    assert costs[2].cost > costs[3].cost > costs[4].cost


def test_as_many_centres_as_asked_for(spark):
    _, df = random_vectors(spark, 4000, 3, lambda i: 0)
    model = C.fit_kmeans(df, 3000, starts=1)
    assert len(np.unique(model.centres, axis=0)) == 3000
    with pytest.raises(ValueError, match="distinct"):
        C.fit_kmeans(df.limit(5).unionByName(df.limit(5)), 6, starts=1)


def test_starts_do_not_depend_on_partitions(spark, blobs):
    df = blobs(4, 30, 5)
    one, many = (C.fit_kmeans(df.repartition(n), 4, starts=2) for n in (1, 7))
    assert one.cost == pytest.approx(many.cost) and one.seed == many.seed


def test_k_range_is_clamped(spark):
    _, df = random_vectors(spark, 4, 3, lambda i: 0)
    assert sorted(r.k for r in C.select_k(df, 2, 10, starts=1).collect()) == [2, 3]


def test_best_k_takes_the_smallest_on_ties(spark):
    curve = spark.createDataFrame([(4, 0.5), (3, 0.5), (2, 0.1)], "k int, silhouette double")
    assert [r.k for r in C.best_k(curve).collect() if r.is_best] == [3]


def test_assignment_forms_agree_and_ties_take_the_lowest_label(spark):
    _, df = random_vectors(spark, 40, 3, lambda i: 0)
    centres = [(5, [0.5, 0.0, 0.0]), (2, [-0.5, 0.0, 0.0])]
    tie = spark.createDataFrame([(99, "t", 0, [0.0, 1.0, 0.0]), (98, "n", 0, None)], SCHEMA)
    both = C.assign_nearest(df.union(tie), centres).withColumn(
        "near", C.nearest_centre(as_double(F.col("embedding")), centres)
    )
    rows = {r.item_id: r for r in both.collect()}
    assert rows[99].cluster == 2 and rows[98].cluster is None and rows[98].near is None
    assert all(r.cluster == r.near["label"] for i, r in rows.items() if i != 98)


def test_cohesion_without_pairs(spark, blobs):
    df = blobs(2, 10, 4)
    got = {r.cluster: r.cohesion for r in C.cluster_cohesion(df).collect()}
    v = np.array([r.embedding for r in df.collect()])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for c in (0, 1):
        block = u[c * 10 : c * 10 + 10]
        assert got[c] == pytest.approx((block @ block.T)[np.triu_indices(10, 1)].mean())
    single = df.filter("item_id = 0")
    assert C.cluster_cohesion(single).first()["cohesion"] is None


def test_pca_is_centred_orthogonal_and_ordered(spark):
    _, df = random_vectors(spark, 50, 6, lambda i: 0)
    df = df.withColumn("embedding", F.transform("embedding", lambda x: x + 5).cast("array<float>"))
    y = np.array([[r.x, r.y, r.z] for r in V.pca_3d(df).collect()])
    assert y.mean(axis=0) == pytest.approx([0, 0, 0], abs=1e-6)
    cov = np.cov(y.T)
    assert np.abs(cov - np.diag(np.diag(cov))).max() < 1e-6
    assert cov[0, 0] >= cov[1, 1] >= cov[2, 2] > 0


def test_embedding_seam_isolates_failures_and_keeps_keys(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(25)], "item_id long, embed_text string").repartition(1)

    def model(texts):
        if "text 12" in texts:
            raise RuntimeError("down")
        return [[float(t.split()[1]), 1.0] for t in texts]

    rows = E.embed_with(df, model).collect()
    assert len(rows) == 25
    bad = [r for r in rows if r.embedding is None]
    assert len(bad) == 10 and 12 in {r.item_id for r in bad} and all(r.error for r in bad)
    assert all(r.embedding[0] == r.item_id for r in rows if r.embedding)


def test_offline_vectors_are_unit_and_equal_for_equal_text(spark):
    df = spark.createDataFrame(
        [(1, "wild reels spin"), (2, "wild reels spin"), (3, "other words entirely"), (4, "the and of")],
        "item_id long, embed_text string",
    )
    rows = {r.item_id: r.embedding for r in E.embed_documents(df, dimensions=64).collect()}
    assert rows[1] == rows[2] and rows[1] != rows[3] and rows[4] is None
    assert np.linalg.norm(rows[3]) == pytest.approx(1.0, abs=1e-6)


def test_blank_text_is_not_embedded(spark):
    df = spark.createDataFrame([(1, " \n"), (2, "x"), (3, None)], "item_id long, structured_summary string")
    got = E.prefixed_input(df).collect()
    assert [(r.item_id, r.embed_text) for r in got] == [(2, E.EMBED_PREFIX + "x")]


def test_inverted_file_is_exact_with_all_cells_and_near_with_some(spark):
    _, df = random_vectors(spark, 300, 8, lambda i: 0)
    exact = N.recommend_items(df, 4)
    key = lambda r: (r.item_id, r["rank"], r.neighbour_id, round(r.similarity, 6))
    want = sorted(map(key, exact.collect()))
    assert sorted(map(key, I.ivf_neighbours(df, 4, cells=6, probes=6, block_rows=40).collect())) == want
    some = I.ivf_neighbours(df, 4, cells=6, probes=3)
    found = I.recall(some, exact).first()
    assert found.wanted == len(want) and 0.5 < found.recall < 1


def test_a_digest_is_taken_once_for_each_term(spark, monkeypatch):
    lists = [["red", "fox", "red", "fox"], [], ["fox"], None, ["café", "red"], ["red", "fox"] * 40]
    want = np.zeros((len(lists), 32))
    for row, words in enumerate(lists):
        for term in [*(words or []), *(f"{a} {b}" for a, b in zip(words or [], (words or [])[1:]))]:
            want[row, int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % 32] += 1
    taken = []
    plain = E.md5
    monkeypatch.setattr(E, "md5", lambda term: taken.append(term) or plain(term))
    got = E.count_terms(pa.array(lists, pa.list_(pa.string())), 32)
    assert (got == want).all()
    assert len(taken) == len(set(taken)) == 6
    part = E.count_terms(pa.array(lists, pa.list_(pa.string()))[4:], 32)
    assert (part == want[4:]).all()
    monkeypatch.setattr(E, "md5", plain)
    monkeypatch.setattr(E, "SLICE_WORDS", 3)
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i long, words array<string>").repartition(2)
    found = rows.select("i", E._term_counts(F.coalesce("words", F.array().cast("array<string>")), 32).alias("c")).collect()
    assert (np.array([r.c for r in sorted(found)]) == want).all()
