"""Exact neighbours by tiles against brute force, and how often a plan finds them."""

import numpy as np
import pytest

from modloom.operators import affinity


def _table(spark, x):
    return spark.createDataFrame([(i * 3, list(map(float, r))) for i, r in enumerate(x)], "id long, features array<double>")


def _brute(x, k):
    out = set()
    for i in range(len(x)):
        with np.errstate(all="ignore"):
            d2 = ((x - x[i]) ** 2).sum(1)
        d2[i] = np.inf
        order = [j for j in np.lexsort((np.arange(len(x)), np.round(d2, 9))) if np.isfinite(d2[j])][:k]
        out |= {(i * 3, int(j) * 3, float(d2[j]), rank + 1) for rank, j in enumerate(order)}
    return out


rng = np.random.default_rng(5)


@pytest.mark.parametrize("x", [rng.normal(size=(700, 24)), rng.integers(0, 3, size=(700, 3)).astype(float), rng.normal(size=(300, 6)) + 1e6, np.vstack([rng.normal(size=(300, 4)), [[1e30] * 4, [np.inf] * 4, [1e200] * 4]])])
def test_tiles_give_what_brute_force_gives(spark, monkeypatch, x):
    for name, value in (("BLOCK", 64), ("LEFT", 128), ("RIGHT", 256), ("LEAST", 2)):
        monkeypatch.setattr(affinity, name, value)
    got = [tuple(r) for r in affinity.knn(_table(spark, x)).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(x, 10)


def test_a_plan_finds_neighbours_once(spark):
    p = _table(spark, rng.normal(size=(40, 3)))
    for made in (affinity.gaussian_weights(p), affinity.averaged(affinity.gaussian_weights(p)), affinity.self_tuned(p), affinity.mean_normalised(affinity.neighbour_rbf(p))):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") <= 1

