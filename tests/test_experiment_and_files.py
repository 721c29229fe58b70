"""The experiment grid, solvers and moves by their recurrences, and file sources."""

import hashlib

import numpy as np
import pytest

from modloom.operators import matrices
from modloom.plans import baselines, experiment, mbo
from modloom.sources import files, graphs

SF = "/root/testdata/sf0.001"


def test_grid(spark):
    e, n = graphs.karate(spark)
    runs = experiment.run_grid(e, n, 2, repeats=2, configurations=[("projection", "lmix_sym", 1)], others=["cnm"], gamma=1.0)
    out = {r["algo"]: r for r in experiment.averages(runs).collect()}
    assert out["projection"]["runs"] == 2 and out["projection"]["modularity"] > 0.2
    assert abs(out["cnm"]["modularity"] - 0.3807) < 1e-3 and len(experiment.CONFIGURATIONS) == 12


def test_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n0,1\n1,2\n2,2\n,3\n")
    e = files.read_edges(spark, str(tmp_path / "e.csv"), "csv", "a", "b", None, header="true")
    assert sorted((r["src"], r["dst"], r["w"]) for r in e.collect()) == [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
    labels = spark.createDataFrame([(0, 1)], "id long, label int")
    files.write_partition(labels, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def recurrence(scheme, lam, v, d, labels, k, gamma, n_t=3, max_iter=10_000):
    """The rounds as they are defined, n x K, one start: the labels after the last round and the number of rounds."""
    positive = lam[lam > 1e-9]
    pick = lam[0] if scheme == "finite_difference" else lam[1]
    dt = mbo.time_step(d.max(), pick if pick > 1e-9 else positive[0], len(d), k, gamma)
    dt = dt / (2 * n_t) if scheme == "finite_difference" else dt
    f = {"projection": np.exp(-0.5 * lam * dt), "boyd": np.exp(-lam * dt)}.get(scheme, 1 / (1 + dt * lam))
    seen = {}
    for t in range(1, max_iter + 1):
        u = np.where(labels[:, None] == np.arange(k), 1.0, -1.0)
        if scheme == "hu":
            w = u
            for _ in range(n_t):
                w = w + 2 * gamma * dt * d[:, None] * (u - d @ u / d.sum())
                u = v @ (f[:, None] * (v.T @ w))
        else:
            u = v @ (f[:, None] * (v.T @ u))
        new = u.argmax(1)
        if (new == labels).all():
            return new, t
        labels = new
        key = labels.tobytes()
        if key in seen:  # a cycle: go on only to the state that max_iter rounds end in
            left = (max_iter - t) % (t - seen[key])
            if left == 0:
                return labels, max_iter
            max_iter, seen = t + left, {}
        else:
            seen[key] = t
    return labels, 10_000


@pytest.fixture(scope="module")
def trade(spark):
    from modloom.plans.tables import materialise

    return materialise(graphs.trade(spark, SF)), graphs.nations(spark, SF).select("id", "truth")


def test_all_configurations_together_are_their_recurrences(spark, trade):
    e, n = trade
    deg, k, gamma = matrices.degrees(e), 5, 1.0
    d = np.array([r["d"] for r in deg.orderBy("id").collect()], float)
    starts = mbo.random_starts(n, k, list(range(4)))
    first = np.array([r["labels"] for r in starts.orderBy("id").collect()])
    spectra = experiment._spectra(e, experiment.CONFIGURATIONS, k, 25, "ng")
    problems = [mbo.Problem(a, *spectra[o, min(x * k, 24)][:2]) for a, o, x in experiment.CONFIGURATIONS]
    r = mbo.solve_together(problems, deg, starts, k, gamma=gamma)
    got = {(x["run"], x["id"]): x["label"] for x in r.labels.collect()}
    for i, p in enumerate(problems):
        v = np.array([x["v"] for x in p.vectors.orderBy("id").collect()])
        for s in range(4):
            labels, rounds = recurrence(p.scheme, np.real(p.lam), v, d, first[:, s], k, gamma)
            assert [got[i * 4 + s, j] for j in range(25)] == labels.tolist() and r.rounds[i * 4 + s] == rounds


def test_the_whole_grid(spark):
    from modloom.plans.catalog import QUERIES

    rows = {(r["algo"], r["operator"]): r for r in QUERIES["experiment_grid"](spark, SF).collect()}
    assert len(rows) == 12 + 8 + len(experiment.BASELINES)
    assert all(r["runs"] == (1 if r["operator"] == "-" else 20) for r in rows.values())
    assert all(0 < r["purity"] <= 1 and -1 <= r["modularity"] <= 1 for r in rows.values())


def moves(w, gamma=1.0):
    """Local moves by their definition, dense: nodes of alternating parity go to the best neighbouring community."""
    keys = [int(hashlib.md5(f"{i}:5".encode()).hexdigest()[:8], 16) for i in range(len(w))]
    d, labels, still, seen, r = w.sum(1), np.arange(len(w)), 0, set(), 0
    while still < 2 and (r % 2, labels.tobytes()) not in seen:
        if still == 0:
            seen.add((r % 2, labels.tobytes()))
        new = labels.copy()
        for i in range(len(w)):
            if keys[i] % 2 == r % 2:
                value = {c: w[i][(labels == c) & (np.arange(len(w)) != i)].sum() - gamma * d[i] * (d[labels == c].sum() - d[i] * (labels[i] == c)) / d.sum() for c in set(labels[w[i] > 0]) | {labels[i]}}
                best = max(value, key=lambda c: (round(value[c] - value[labels[i]], 9), -c))
                if value[best] - value[labels[i]] > 1e-9 and best != labels[i]:
                    new[i] = best
        still = still + 1 if (new == labels).all() else 0
        labels, r = new, r + 1
    return labels


def test_local_moves_are_their_definition(spark, trade):
    for e, n in ((trade[0], 25), (graphs.karate(spark)[0], 34)):
        w = np.zeros((n, n))
        for r in e.collect():
            w[r["src"], r["dst"]] = r["w"]
        got = [r["label"] for r in baselines.local_moves(e)[0].orderBy("id").collect()]
        assert got == moves(w).tolist()
