"""Row order and partitioning never change a result; hot keys are handled whole."""

import numpy as np
import pytest

from vecloom.operators import clustering as C
from vecloom.operators import neighbours as N
from vecloom.operators import profile as P
from vecloom.operators import quality as Q
from vecloom.operators import relational as R

SCHEMA = (
    "item_id long, title string, provider string, review string, structured_summary string, "
    "summary string, cluster int, embedding array<float>"
)
WORDS = "wild reels bonus spins theme music graphics story scatter multiplier".split()


@pytest.fixture(scope="module")
def skewed(spark):
    """One cluster, one title and one provider hold most rows; many rows are copies."""
    draw = np.random.default_rng(11)
    rows = []
    for i in range(240):
        hot = i % 3 != 0
        words = " ".join(draw.choice(WORDS, size=6))
        vector = [1.0, 0.5, 0.25, 0.0] if i % 4 == 1 else [float(x) for x in draw.normal(size=4)]
        rows.append(
            (
                i,
                "hot title" if hot else f"title {i % 50}",
                "acme" if hot else f"p{i % 7}",
                None if i % 5 == 0 else words,
                words if i % 2 else None,
                words,
                0 if hot else i % 4,
                vector,
            )
        )
    return rows, spark.createDataFrame(rows, SCHEMA)


RESULTS = {
    "summary": P.cluster_summary,
    "distribution": P.cluster_distribution,
    "providers": P.top_providers,
    "words": P.top_words,
    "themes": P.key_themes,
    "profile": P.cluster_profile,
    "samples": lambda d: P.cluster_samples(d.select("cluster", "item_id", "title")),
    "random": lambda d: P.random_samples(d.select("cluster", "item_id", "title")),
    "merged": lambda d: R.merge_summaries(d, d),
    "attached": lambda d: R.attach_summary(d.select("item_id", "title"), d),
    "firsts": lambda d: R.first_per_title(d).select("item_id"),
    "ledger": Q.cost_ledger,
    "similar": lambda d: N.similar_items(d, 3),
    "blocks": lambda d: N.recommend_items(d, 3, block_rows=32, max_pivots=8),
}


def _rounded(rows):
    def cell(x):
        return round(x, 9) if isinstance(x, float) else x

    return sorted(repr(tuple(cell(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_partitioning_and_order_change_nothing(skewed, name):
    _, df = skewed
    one = _rounded(RESULTS[name](df.coalesce(1)).collect())
    many = _rounded(RESULTS[name](df.orderBy("title").repartition(9)).collect())
    assert one == many and one


def test_every_row_is_counted_once(skewed):
    rows, df = skewed
    assert sum(r["count"] for r in P.cluster_distribution(df).collect()) == len(rows)
    assert {r.item_id for r in N.similar_items(df, 3).collect()} == {r[0] for r in rows}


def test_similarities_are_in_range_and_ranks_are_dense(skewed):
    _, df = skewed
    per_item = {}
    for r in N.recommend_items(df, 4, block_rows=50).collect():
        assert -1 - 1e-9 <= r.similarity <= 1 + 1e-9 and r.neighbour_id != r.item_id
        per_item.setdefault(r.item_id, []).append((r["rank"], round(r.similarity, 9)))
    for ranks in per_item.values():
        ranks.sort()
        assert [k for k, _ in ranks] == [1, 2, 3, 4]
        assert [s for _, s in ranks] == sorted((s for _, s in ranks), reverse=True)


def test_items_sit_at_their_nearest_mean_and_more_clusters_cost_less(skewed):
    _, df = skewed
    models = C.fit_all(df, [2, 4], starts=3)
    assert models[4].cost < models[2].cost
    labelled = C.assign_nearest(df.select("item_id", "embedding"), models[4].labelled())
    for r in labelled.collect():
        gaps = ((models[4].centres - np.array(r.embedding)) ** 2).sum(axis=1)
        assert r.cluster == gaps.argmin() and r.distance == pytest.approx(gaps.min())
    total = sum(r.distance for r in labelled.collect())
    assert total == pytest.approx(models[4].cost)


def test_inertia_equals_the_distance_to_the_means(skewed):
    rows, df = skewed
    got = {r.cluster: r.inertia for r in C.inertia(df).collect()}
    for c in {r[6] for r in rows}:
        block = np.array([r[7] for r in rows if r[6] == c], dtype=np.float32).astype(float)
        assert got[c] == pytest.approx(((block - block.mean(axis=0)) ** 2).sum())
