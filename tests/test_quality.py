"""Scores that follow moves, and local moves of affected nodes alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modloom.operators import matrices, metrics
from modloom.plans import baselines, mbo, quality, spectral
from modloom.plans.tables import materialise
from modloom.sources import graphs

SF = "/root/testdata/sf0.001"


def table(spark, was, now):
    return spark.createDataFrame([(i, None if was is None else was[i].tolist(), now[i].tolist()) for i in range(len(now))], "id long, was array<int>, now array<int>")


def scores(spark, edges, now, gamma):
    rows = [(r, i, int(x)) for i, row in enumerate(now) for r, x in enumerate(row)]
    labels = spark.createDataFrame(rows, "run int, id long, label int")
    return [r["modularity"] for r in metrics.modularity(edges, labels, "ng", gamma, ("run",)).orderBy("run").collect()]


@pytest.mark.parametrize("pushed", [0, 1000])
def test_moves_are_followed(spark, monkeypatch, pushed):
    monkeypatch.setattr(quality, "PUSHED", pushed)
    e, _ = graphs.karate(spark)
    # loops and weights that differ; a node outside the graph
    e = materialise(e.withColumn("w", 1 + (F.col("src") + F.col("dst")) % 3).unionByName(spark.createDataFrame([(0, 0, 2), (5, 5, 1)], "src long, dst long, w long")))
    rng, k, runs = np.random.default_rng(3), 4, 3
    now = rng.integers(-1, k, (35, runs)).astype(np.int32)
    t = quality.Tracker(e, runs, k, 0.7)
    t.full(table(spark, None, now), [0, 1, 2])
    assert np.allclose(t.modularity(), scores(spark, e, now, 0.7), atol=1e-12)
    for live, nodes in (([0, 1, 2], 12), ([0, 2], 3), ([2], 1), ([2], 0), ([2], 35)):
        was, at = now.copy(), rng.choice(35, nodes, replace=False)
        for r in live:
            now[at, r] = rng.integers(-1, k, nodes)
        most = int((was != now).sum())
        t.update(table(spark, was[:, live], now[:, live]), live, most)
        assert np.allclose(t.modularity(), scores(spark, e, now, 0.7), atol=1e-12)
        moved = np.flatnonzero((was != now).any(1)).tolist()
        assert t.joined[-1] == e.filter(F.col("src").isin(moved) if moved else F.lit(False)).count()
    t.close()


def test_an_empty_graph_scores_nothing(spark):
    t = quality.Tracker(spark.createDataFrame([], "src long, dst long, w double"), 1, 2)
    t.full(table(spark, None, np.zeros((3, 1), np.int32)), [0])
    t.update(table(spark, np.zeros((3, 1), np.int32), np.ones((3, 1), np.int32)), [0], 3)
    assert t.modularity().tolist() == [0.0]
    t.close()


def test_the_solver_stops_where_the_whole_score_does(spark):
    e = materialise(graphs.trade(spark, SF))
    n = graphs.nations(spark, SF).select("id", "truth")
    deg = matrices.degrees(e)
    lam, v = spectral.embedding(e, "lmix_sym", 5)
    v = materialise(v)
    start = mbo.random_starts(n, 5, [1]).select("id", F.col("labels")[0].alias("label"))
    r = mbo.solve("projection", lam, v, deg, start, 5, edges=e, gamma=0.5, tol=1e-4, stopping="modularity")
    for t, q in enumerate(r.trace, 1):
        so_far = mbo.solve("projection", lam, v, deg, start, 5, gamma=0.5, tol=-1.0, max_iter=t)
        assert abs(metrics.modularity(e, so_far.labels, "ng", 0.5).first()[0] - q) < 1e-12
    steps = np.abs(np.diff([0.0, *r.trace]))
    assert r.converged and steps[-1] <= 1e-4 and (steps[:-1] > 1e-4).all()


def test_only_affected_nodes_have_other_gains(spark):
    e = materialise(graphs.copurchase(spark, SF))
    labels = materialise(e.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id") % 7))
    after = labels.withColumn("label", F.when(F.col("id") % 50 == 0, F.col("label") + 100).otherwise(F.col("label")))
    changed = after.filter("label >= 100").select("label").union(labels.filter("id % 50 = 0").select("label")).distinct()
    nodes = baselines.affected(e, after, changed)
    every = {(r["id"], r["cand"]): r["gain"] for r in baselines.move_gains(e, after).collect()}
    some = {(r["id"], r["cand"]): r["gain"] for r in baselines.move_gains(e, after, nodes=nodes).collect()}
    before = {(r["id"], r["cand"]): r["gain"] for r in baselines.move_gains(e, labels).collect()}
    ids = {r["id"] for r in nodes.collect()}
    assert all(abs(every[x] - g) < 1e-9 for x, g in some.items()) and {x for x in every if x[0] in ids} == set(some)
    assert all(abs(every[x] - before[x]) < 1e-9 for x in every if x[0] not in ids)
