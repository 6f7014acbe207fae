"""Similar pairs against all pairs, and the tiles that pivots rule out."""

import numpy as np
import pytest

from dossierlake.operators import vectors as V


def frame(spark, x):
    return spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "id long, v array<float>")


def by_hand(x, threshold):
    x = np.asarray(x, np.float32).astype(float)
    n = np.sqrt((x * x).sum(1))
    s = x @ x.T / (n[:, None] * n[None, :] + 1e-9)
    return {(a, b) for a, b in zip(*np.nonzero(s >= threshold), strict=True) if a < b}


def groups(n=400, m=8, size=16):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(m, size))
    return centre[rng.integers(0, m, n)] + 0.15 * rng.normal(size=(n, size))


@pytest.mark.parametrize("threshold, block, pivots", [(0.9, 20, 16), (0.6, 20, 3), (0.0, 50, 16), (-0.5, 50, 2), (0.999, 2048, 16)])
def test_pairs_equal_all_pairs(spark, threshold, block, pivots):
    x = np.concatenate((groups(), np.random.default_rng(2).normal(size=(60, 16)), np.zeros((2, 16)), np.ones((30, 16))))
    got = [(r.a, r.b) for r in V.similar_pairs(frame(spark, x), "id", "v", threshold, block, pivots).collect()]
    want = by_hand(x, threshold)
    assert len(got) == len(set(got)) and set(got) == want


def test_groups_drop_most_tiles(spark):
    blocks = V.blocks_of(frame(spark, groups(1000)), "id", "v", block=25)
    n, kept = blocks.count(), V.tiles_of(blocks, 0.9).count()
    assert kept < 0.4 * n * (n + 1) / 2
    assert V.similar_pairs(frame(spark, []), "id", "v", 0.5).count() == 0
