import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vecloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", shuffle_partitions=8, driver_memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def blobs(spark):
    """blobs(k, n, d): k well separated Gaussian groups of n unit-ish vectors."""
    import numpy as np

    def make(k, n, d, spread=0.05, seed=3):
        draw = np.random.default_rng(seed)
        centres = np.eye(d)[:k] * 3.0
        rows = []
        for c in range(k):
            for _ in range(n):
                rows.append(
                    (len(rows), f"t{len(rows):04d}", c, [float(x) for x in centres[c] + draw.normal(0, spread, d)])
                )
        return spark.createDataFrame(rows, "item_id long, title string, cluster int, embedding array<float>")

    return make
