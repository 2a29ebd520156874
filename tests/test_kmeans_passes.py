import numpy as np
import pytest

from vecloom.operators import clustering as C


def _rows(spark, x):
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "item_id long, v array<double>").repartition(3)


def test_packed_vectors_give_the_sums_of_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "PACK_VALUES", 40)
    draw = np.random.default_rng(7)
    x, models = draw.normal(size=(90, 4)), [C.Model(k, 0, draw.normal(size=(k, 4))) for k in (2, 5)]
    # Equal centres: the first one counts.
    models.append(C.Model(2, 1, np.zeros((2, 4))))
    plain, packed = (C._lloyd_pass(df, models, with_cost=True) for df in (_rows(spark, x), C._pack(_rows(spark, x))))
    for a, b in zip(plain, packed, strict=True):
        assert a == pytest.approx(b)
    assert packed[0][-2:].tolist() == [90.0, 0.0]
    gap = ((x[:, None] - models[1].centres[None]) ** 2).sum(axis=2)
    assert packed[0][2:7].tolist() == np.bincount(gap.argmin(axis=1), minlength=5).tolist()
    assert packed[2][2:7].sum() == pytest.approx(gap.min(axis=1).sum())


def test_passes_read_packed_vectors(spark, blobs, monkeypatch):
    """They read an array a vector, whose numbers are converted one by one in every pass."""
    seen, lloyd = [], C._lloyd_pass
    monkeypatch.setattr(C, "_lloyd_pass", lambda df, *rest, **more: seen.append(df.schema["v"].dataType.simpleString()) or lloyd(df, *rest, **more))
    C.fit_all(blobs(3, 20, 6), [2, 3], starts=2)
    assert set(seen) == {"binary"}


def test_ones_at_the_first_of_equal_centres():
    x, centres = np.array([[0.0, 1.0], [2.0, 0.0]]), np.array([[1.0, 1.0], [1.0, 1.0], [2.0, 0.0]])
    assert C._nearest(x, centres, [0, 2, 3]).tolist() == [[1.0, 1.0], [0.0, 0.0], [1.0, 1.0]]
