"""Numerical parts against dense numpy models, and their properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modloom.functions.encoding import argmax_label, onehot_pm1, threshold
from modloom.operators import affinity, labelling, matrices, metrics, neighbours
from modloom.plans import baselines, experiment, mbo, nystrom, spectral
from modloom.sources import graphs


def dense(edges, n):
    w = np.zeros((n, n))
    for r in edges.collect():
        w[r["src"], r["dst"]] = r["w"]
    return w


def model(w, kind, null):
    n, d = len(w), w.sum(1)
    p = np.outer(d, d) / d.sum() if null == "ng" else np.full((n, n), d.sum() / (n * (n - 1)))
    root = np.diag(d**-0.5)
    if kind == "laplacian_sym":
        return np.eye(n) - root @ w @ root
    if kind == "lmix_sym":
        return 2 * np.eye(n) - root @ (w - p) @ root
    b = w - p
    pos, neg = np.maximum(b, 0), np.maximum(-b, 0)
    rp, rn = np.diag(pos.sum(1) ** -0.5), np.diag(neg.sum(1) ** -0.5)
    return 2 * np.eye(n) - rp @ pos @ rp + rn @ neg @ rn


@pytest.fixture(scope="module")
def karate(spark):
    e, n = graphs.karate(spark)
    e, n = e.cache(), n.cache()
    return e, n, dense(e, 34)


@pytest.mark.parametrize("kind", ["laplacian_sym", "lmix_sym", "lb_sym"])
@pytest.mark.parametrize("null", ["ng", "er"])
def test_eigenvalues(karate, kind, null):
    e, _, w = karate
    want = np.linalg.eigvalsh(model(w, kind, null))[:4]
    lam, _ = spectral.embedding(e, kind, 4, null)
    assert np.allclose(lam, want, atol=1e-8)


def test_distributed_iteration_agrees(spark):
    e, _ = graphs.block_model(spark, 40, 4, 0.95, 0.02)
    want = np.linalg.eigvalsh(model(dense(e, 40), "lmix_sym", "ng"))[:4]
    lam, v = spectral.smallest(spectral.operator(e, "lmix_sym"), 4, dense=0, degree=6)
    assert np.allclose(lam, want, atol=1e-6)
    assert np.allclose(spectral.gram_of(v), np.eye(4), atol=1e-6)


def rw_model(w, null):
    n, d = len(w), w.sum(1)
    b = w - (np.outer(d, d) / d.sum() if null == "ng" else np.full((n, n), d.sum() / (n * (n - 1))))
    pos, neg = np.maximum(b, 0), np.maximum(-b, 0)
    return 2 * np.eye(n) - pos / pos.sum(1)[:, None] + neg / neg.sum(1)[:, None]


def test_two_degree_matrices_on_the_cluster(spark):
    e, _ = graphs.block_model(spark, 40, 4, 0.9, 0.05)
    a = rw_model(dense(e, 40), "ng")
    want = np.linalg.eigvals(a)
    want = want[np.argsort(want.real)][:4]
    assert np.allclose(spectral.embedding(e, "lb_rw", 4)[0], want, atol=1e-8)  # on the driver
    lam, v = spectral.embedding(e, "lb_rw", 4, dense=0)
    assert np.allclose(lam, want, atol=1e-5)
    x = np.array([r["v"] for r in v.orderBy("id").collect()])
    assert np.abs(a @ x - x * np.real(lam)).max() < 1e-3 and np.allclose(np.linalg.norm(x, axis=0), 1)


def test_complex_pairs_are_reported():
    a = np.array([[1.0, -2.0, 0, 0], [2.0, 1.0, 0, 0], [0, 0, 0.5, 0], [0, 0, 0, 3.0]])
    lam, v = spectral.ordered_eig(a)
    assert np.allclose(lam, [0.5, 1 - 2j, 1 + 2j, 3])
    pair = v[:, 1:3]
    assert np.linalg.matrix_rank(np.c_[pair, a @ pair], tol=1e-9) == 2  # a real basis of the pair's space
    assert not np.iscomplexobj(spectral.ordered_eig(np.diag([2.0, 1.0]))[0])


def test_tall_factors_keep_what_a_gram_matrix_loses(spark):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(600, 6)))[0]
    a = q @ np.diag(10.0 ** -np.arange(0, 12, 2)) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]  # condition 1e10
    x = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "id long, " + ", ".join(f"x{j} double" for j in range(6))).repartition(7)
    r = spectral.tall_r(spectral._array(x, 6, "v"), 6, branches=3)
    assert np.allclose(np.linalg.svd(r)[1], np.linalg.svd(a)[1], rtol=1e-4, atol=0)
    o = np.array([list(r)[1:] for r in spectral._orthonormal(x, 6).orderBy("id").collect()])
    assert np.abs(o.T @ o - np.eye(6)).max() < 1e-12
    assert np.abs(a - o @ (o.T @ a)).max() < 1e-12


def neighbours_by_hand(x, k):
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    return [set(np.argsort(r, kind="stable")[:k].tolist()) for r in d2]


def test_approximate_neighbours(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(700, 16)), np.repeat(rng.normal(size=(1, 16)), 300, 0), rng.normal(5, 0.1, (200, 16))])  # a third are copies
    points = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, features array<double>")
    got = neighbours.approximate_knn(points, 5, tables=3, bucket=40).collect()
    near = {}
    for r in got:
        assert r["d2"] == pytest.approx(((x[r["src"]] - x[r["dst"]]) ** 2).sum()) and r["src"] != r["dst"]
        near.setdefault(r["src"], {})[r["rank"]] = (r["d2"], r["dst"])
    assert len(near) == len(x) and all(sorted(v) == [1, 2, 3, 4, 5] and sorted(v.values()) == [v[i] for i in range(1, 6)] for v in near.values())
    want = neighbours_by_hand(x, 5)
    plain = [i for i in range(len(x)) if not 700 <= i < 1000]
    assert sum(len(want[i] & {j for _, j in near[i].values()}) for i in plain) >= 0.95 * 5 * len(plain)
    assert all(near[i][5][0] == 0 for i in range(700, 1000))  # copies find copies
    placed = neighbours.projections(points, 2, 40).groupBy("table").count().collect()
    assert [r["count"] for r in placed] == [len(x)] * 2


def test_approximate_neighbours_of_odd_points(spark):
    schema = "id long, features array<double>, table int, d2 double"
    rows = [(1, [0.0, 1.0], 0, 1.0), (1, [0.0, 1.0], 0, 1.0), (2, [0.0, 1.0], 0, 1.0), (3, [5.0, 1.0], 0, 1.0), (4, None, 0, 1.0), (5, [None, 1.0], 0, 1.0), (6, [float("nan"), 1.0], 0, 1.0)]
    got = {(r["src"], r["dst"], r["d2"], r["rank"]) for r in neighbours.approximate_knn(spark.createDataFrame(rows, schema), 3).collect()}
    assert got == {(1, 2, 0.0, 1), (1, 3, 25.0, 2), (2, 1, 0.0, 1), (2, 3, 25.0, 2), (3, 1, 25.0, 1), (3, 2, 25.0, 2)}
    assert neighbours.approximate_knn(spark.createDataFrame([], schema), 3).count() == 0


def test_zachary_has_78_edges_and_two_clubs(karate):
    e, n, w = karate
    assert e.count() == 156 and w.sum() == 156
    assert sorted(r["count"] for r in n.groupBy("truth").count().collect()) == [17, 17]


def test_modularity_of_the_triangles(spark):
    labels = spark.createDataFrame([(i, i // 3, i // 3) for i in range(6)], "id int, label int, truth int")
    e = graphs.toy(spark)
    assert metrics.modularity(e, labels).first()[0] == pytest.approx(5 / 14)
    one = labels.withColumn("label", F.lit(0))
    assert metrics.modularity(e, one).first()[0] == pytest.approx(0)
    for f in (metrics.purity, metrics.adjusted_rand, metrics.normalised_mutual_information):
        assert f(labels).first()[0] == pytest.approx(1)


def test_isolated_nodes_do_not_divide(spark):
    e = graphs.toy(spark)
    labels = spark.createDataFrame([(i, i // 3) for i in range(7)], "id int, label int")
    assert metrics.modularity(e, labels).first()[0] == pytest.approx(5 / 14)


def test_leftovers_stay_unlabelled(spark):
    got = [r["label"] for r in labelling.init_equal(spark.range(7), 3).collect()]
    assert sorted(got, key=lambda x: (x is None, x)) == [0, 0, 1, 1, 2, 2, None]


def test_encodings(spark):
    r = spark.range(1).select(onehot_pm1(F.lit(1), 3).alias("u"), argmax_label(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0))).alias("a"), threshold(F.lit(-0.5), -0.2).alias("t"), threshold(F.lit(0.0)).alias("z")).first()
    assert list(r["u"]) == [-1, 1, -1] and r["a"] == 1 and r["t"] == 1.0 and r["z"] == 0.0


SCHEMES = [("projection", "lmix_sym", 4, 0.5), ("projection", "lb_sym", 4, 0.5), ("finite_difference", "lmix_sym", 4, 0.5), ("hu", "laplacian_sym", 4, 1.0), ("boyd", "laplacian_sym", 20, 0.5)]


@pytest.fixture(scope="module")
def blocks(spark):
    e, truth = graphs.block_model(spark, 120, 4, 0.95, 0.01)
    return e.cache(), truth.cache()


@pytest.mark.parametrize("scheme,kind,m,gamma", SCHEMES)
def test_planted_blocks_are_found(blocks, scheme, kind, m, gamma):
    e, truth = blocks
    lam, v = spectral.embedding(e, kind, m)
    v = v.cache()
    best = 0.0
    for seed in range(20):  # best of several starts, never a single one
        r = mbo.solve(scheme, lam, v, matrices.degrees(e), labelling.init_random(truth, 4, seed), 4, gamma=gamma)
        ari = metrics.adjusted_rand(r.labels.join(truth, "id")).first()[0]
        best = max(best, ari)
        if best == 1.0:
            again = mbo.solve(scheme, lam, v, matrices.degrees(e), r.labels, 4, gamma=gamma)
            assert again.rounds == 1  # a fixed point
            break
    assert best == pytest.approx(1.0)


def direct_hu(v, lam, labels, d, k, n_t, gamma, dt):
    """The recurrence as it stands, n x K."""
    u = -np.ones((len(labels), k))
    u[np.arange(len(labels)), labels] = 1
    w = u.copy()
    for _ in range(n_t):
        w = w + 2 * gamma * dt * d[:, None] * (u - d @ u / d.sum())
        u = v @ ((v.T @ w) / (1 + dt * lam)[:, None])
    return u.argmax(1)


def test_hu_round_is_the_recurrence(karate):
    e, _, w = karate
    lam, vec = spectral.embedding(e, "laplacian_sym", 6)
    got_v = {r["id"]: r["v"] for r in vec.collect()}
    v, d = np.array([got_v[i] for i in range(34)]), w.sum(1)
    init = np.array([i * 7 % 4 for i in range(34)])
    dt = mbo.time_step(d.max(), lam[1], 34, 4, 0.5)
    spark = e.sparkSession
    start = spark.createDataFrame([(i, int(x)) for i, x in enumerate(init)], "id int, label int")
    r = mbo.solve("hu", lam, vec, matrices.degrees(e), start, 4, n_t=3, gamma=0.5, max_iter=1)
    got = {x["id"]: x["label"] for x in r.labels.collect()}
    assert [got[i] for i in range(34)] == direct_hu(v, lam, init, d, 4, 3, 0.5, dt).tolist()


def full_kernel(x, tau):
    return np.exp(-tau * ((x[:, None] - x[None]) ** 2).sum(2))


def test_nystrom_with_all_points_is_exact(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.4, (15, 3)) for c in (0, 2)])
    points = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, features array<double>")
    w = full_kernel(x, 1.0)
    want = np.linalg.eigvalsh(model(w, "laplacian_sym", "ng"))[:5]
    lam, v = nystrom.spectrum(points, 30, 5, 1.0)
    assert np.allclose(lam, want, atol=1e-5)
    want = np.linalg.eigvalsh(model(w, "lmix_sym", "ng"))[:5]
    assert np.allclose(nystrom.spectrum(points, 30, 5, 1.0, kind="lmix")[0], want, atol=1e-4)
    assert len(nystrom.spectrum(points, 30, 5, 1.0, kind="lb", null="er")[0]) == 5


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.4, (15, 3)) for c in (0, 2)])
    return x, spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, features array<double>")


@pytest.mark.parametrize("kind,null", [("lmix", "ng"), ("lmix", "er"), ("lb", "ng"), ("lb", "er")])
def test_landmark_spectra_of_null_models_with_all_points_are_exact(cloud, kind, null):
    x, points = cloud
    w = full_kernel(x, 1.0)
    n, d = len(w), w.sum(1)
    p = np.outer(d, d) / d.sum() if null == "ng" else np.full((n, n), d.sum() / (n * (n - 1)))
    root = lambda v: np.diag(v**-0.5)
    if kind == "lmix":
        dn = d if null == "ng" else p.sum(1)  # each part is scaled by its own degrees
        a = 2 * np.eye(n) - root(d) @ w @ root(d) + root(dn) @ p @ root(dn)
    else:
        pos, neg = np.maximum(w - p, 0), np.maximum(p - w, 0)
        a = 2 * np.eye(n) - root(pos.sum(1)) @ pos @ root(pos.sum(1)) + root(neg.sum(1)) @ neg @ root(neg.sum(1))
    lam, v = nystrom.spectrum(points, n, 5, 1.0, kind=kind, null=null)
    want = np.linalg.eigvalsh(a)[:5]
    assert np.allclose(lam, want, atol=2e-4)
    got = np.array([r["v"] for r in v.orderBy("id").collect()])
    assert np.abs(a @ got - got * lam).max() < 5e-3 and np.allclose(np.linalg.norm(got, axis=0), 1, atol=1e-6)


def test_one_shot_landmark_form(cloud):
    x, points = cloud
    w = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2.0)
    want = np.linalg.eigvalsh(model(w, "laplacian_sym", "ng"))[:5]
    lam, v = nystrom.spectrum(points, 30, 5, 2.0, kind="classic")
    assert np.allclose(lam, want, atol=1e-5)
    some, u = nystrom.spectrum(points, 12, 5, 2.0, kind="classic")  # fewer landmarks: the definition, dense
    marks = [r["id"] for r in affinity.landmarks(points.select("id", "features"), 12).orderBy("rank").collect()]
    rest = [i for i in range(30) if i not in marks]
    a, b = w[np.ix_(marks, marks)], w[np.ix_(marks, rest)]
    d1 = a.sum(1) + b.sum(1)
    d = np.concatenate([d1, b.sum(0) + b.T @ np.linalg.pinv(a) @ b.sum(1)]) ** -0.5
    a, b = a * np.outer(d[:12], d[:12]), b * np.outer(d[:12], d[12:])
    s, q = np.linalg.eigh(np.linalg.pinv(a))
    half = (q * np.sqrt(np.maximum(s, 0))) @ q.T
    e, z = np.linalg.eigh(a + half @ b @ b.T @ half)
    vec = np.r_[a, b.T] @ half @ z[:, ::-1][:, :5]
    vec /= np.linalg.norm(vec, axis=0)
    got = np.array([r["v"] for r in u.orderBy("id").collect()])[marks + rest]
    assert np.allclose(some, 1 - e[::-1][:5], atol=1e-5) and np.allclose(np.abs((got * vec).sum(0)), 1, atol=1e-4)


def test_landmark_spectra_feed_the_grid(spark, cloud):
    x, points = cloud
    truth = points.select("id", (F.col("id") >= 15).cast("int").alias("truth"))
    e = affinity.averaged(affinity.gaussian_weights(points, 5))
    runs = experiment.run_grid(e, truth, 2, repeats=6, gamma=1.0, tol=1e-4, stopping="modularity", spectra=experiment.landmark_spectra(points, 20, 1.0)).collect()
    assert len(runs) == 72 and len({(r["algo"], r["operator"]) for r in runs}) == 12
    best = {}
    for r in runs:
        best[r["algo"], r["operator"]] = max(best.get((r["algo"], r["operator"]), -1), r["ari"])
    assert all(v == pytest.approx(1) for v in best.values()), best


def test_products_move_no_edges(spark, karate):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        op = spectral.operator(karate[0], "laplacian_sym")
        x = spectral.materialise_by(op.nodes.select("id", F.lit(1.0).alias("x0")), "id")
        y = op.apply(x, 1)
        y.collect()
        plan = y._jdf.queryExecution().executedPlan().toString()
        final = plan.split("Initial Plan")[0]
        assert final.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(src" in final
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_baselines_on_karate_and_blocks(blocks, karate):
    e, truth = blocks
    assert metrics.adjusted_rand(baselines.louvain(e).join(truth, "id")).first()[0] == pytest.approx(1.0)
    assert metrics.adjusted_rand(baselines.spectral_kmeans(e, 4).join(truth, "id")).first()[0] == pytest.approx(1.0)
    k, nodes, _ = karate
    assert baselines.greedy_merge(k).select("label").distinct().count() == 3
    assert metrics.modularity(k, baselines.greedy_merge(k)).first()[0] == pytest.approx(0.3807, abs=1e-3)
    assert baselines.girvan_newman(k).groupBy("label").count().count() == 2


def test_merging_in_batches_is_the_sequential_rule(spark, karate, monkeypatch):
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    made = []
    choose = baselines._next_merges
    monkeypatch.setattr(baselines, "_next_merges", lambda *a: made.append(choose(*a)) or made[-1])
    chain = graphs.edges_of(spark, " ".join(f"{4 * i + a}-{4 * i + b}" for i in range(8) for a, b in ((0, 1), (1, 2), (0, 2), (2, 3))) + " " + " ".join(f"{4 * i + 3}-{4 * i + 4}" for i in range(7)))
    for e in (chain, karate[0]):
        assert same(baselines.greedy_merge(e), baselines.greedy_merge(e, most_pairs=0))
    assert max(map(len, made)) > 1


def test_betweenness_on_the_cluster(spark, karate):
    near = {}
    for r in karate[0].collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    want = baselines._betweenness(near)
    got = {(r["src"], r["dst"]): r["paths"] for r in baselines.edge_betweenness(karate[0], block=20).collect()}
    assert got == pytest.approx(want)
    some = {(r["src"], r["dst"]): r["paths"] for r in baselines.edge_betweenness(karate[0], sample=20).collect()}
    bound = 34 * 33 / 2 * np.sqrt(np.log(2 * 78 / 0.01) / 40)
    assert all(abs(some.get(e, 0.0) - v) <= bound for e, v in want.items())
    toy = graphs.edges_of(spark, "0-1 0-2 1-2 3-4 3-5 4-5 2-3 6-7")
    split = sorted(map(tuple, baselines.girvan_newman(toy).collect()))
    assert split == sorted(map(tuple, baselines.girvan_newman(toy, most_nodes=0).collect())) and len({x for _, x in split}) == 3


def test_moments_far_from_zero(spark):
    x = np.random.default_rng(3).normal(size=(400, 4)) + 1e8  # products of such values would lose the covariance
    points = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)] + [(900, None), (901, [float("nan")] * 4)], "id long, features array<double>").repartition(6)
    n, mean, s = affinity.block_moments(points, branches=2)
    assert n == 400 and np.allclose(mean, x.mean(0)) and np.allclose(s / 399, np.cov(x.T), rtol=1e-6, atol=1e-7)
    got = np.array([r["projected"] for r in affinity.pca(points, 2).orderBy("id").collect()])
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ want.T), atol=1e-5)
    none = spark.createDataFrame([], "id long, features array<double>")
    assert affinity.block_moments(none) is None and affinity.pca(none, 2).count() == 0 and affinity.moments(none).count() == 0


def test_power_clusters_find_planted_blocks(spark):
    parts = [range(0, 12), range(12, 30)]
    arcs = " ".join(f"{i}-{j}" for p in parts for i in p for j in p if i < j) + " 0-12"
    e = graphs.edges_of(spark, arcs)
    got = {r["id"]: r["label"] for r in baselines.power_clusters(e, 2).collect()}
    assert len({got[i] for i in range(12)}) == 1 and len({got[i] for i in range(12, 30)}) == 1 and got[1] != got[20]
    assert baselines.kmeans_line(spark.createDataFrame([], "id long, x double"), 3).count() == 0


def test_fixed_rounds_on_the_line_are_all_made(spark):
    x = 0.04 + 1e-12 * np.array([0.7, 1.6, 0.7, -2.6, 1.8, 0.9, -1.1, 1.2, 0.7, 0.6, 0.1, 1.1])
    centres = [x.min() + (i + 0.5) / 5 * (x.max() - x.min()) for i in range(5)]
    near = lambda: [min(range(5), key=lambda i: (round(abs(v - centres[i]), 12), i)) for v in x]
    for _ in range(5):
        labels = np.array(near())
        centres = [x[labels == i].mean() if (labels == i).any() else centres[i] for i in range(5)]
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    assert [r["label"] for r in baselines.kmeans_line(values, 5, 5).orderBy("id").collect()] == near()


def test_self_tuned_weights_keep_ties_and_copies(spark):
    x = [[0.0, 0.0]] * 6 + [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0], [3.0, 4.0], [5.0, 5.0]]
    got = {(r["src"], r["dst"]): r["w"] for r in affinity.self_tuned(spark.createDataFrame(list(enumerate(x)), "id long, features array<double>"), 3).collect()}
    d2 = ((np.array(x)[:, None] - np.array(x)[None]) ** 2).sum(2)
    tau = np.partition(d2, 3, axis=1)[:, 3]
    scale = np.sqrt(np.outer(tau, tau))
    w = np.exp(-np.divide(d2, scale, out=np.where(d2 > 0, np.inf, 0.0), where=scale > 0))
    w[w < np.partition(w, len(x) - 4, axis=1)[:, len(x) - 4 : len(x) - 3]] = 0
    w = np.maximum(w, w.T)
    assert set(got) == set(zip(*(a.tolist() for a in np.nonzero(w)), strict=True))
    assert all(v == pytest.approx(w[k]) for k, v in got.items()) and all((i, j) in got for i in range(6) for j in range(6))
