"""Every query by name: (spark, sf_dir) -> DataFrame. Floating results are rounded to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import encoding as enc
from ..functions.encoding import key, six
from ..operators import affinity, labelling, matrices, metrics, neighbours
from ..sources import graphs
from . import baselines, experiment, mbo, nystrom, spectral
from .tables import materialise

Query = Callable[[SparkSession, str], DataFrame]
K = 5
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return graphs.nations(spark, d, K)


# --- flagship -----------------------------------------------------------------------------------------------------------


@query
def report(spark, d):
    """The trade graph scored against the regions."""
    r = metrics.report(materialise(graphs.trade(spark, d)), labelled(spark, d))
    return r.select(*[six(F.col(c)).alias(c) for c in r.columns])


# --- sources ------------------------------------------------------------------------------------------------------------


@query
def truth_recode(spark, d):
    n = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "Mr. Hi").when(F.col("c_mktsegment") == "MACHINERY", "Officer").alias("club"))
    return n.select("id", graphs.truth_code("club").alias("truth"))


@query
def sbm_graph(spark, d):
    return graphs.block_model(spark, 120, 4, 0.95, 0.01)[0]


@query
def scan_points(spark, d):
    return graphs.points(spark, d).select("id", F.size("features").alias("dims"), six(F.aggregate("features", F.lit(0.0), lambda s, x: s + x)).alias("total"), "truth")


@query
def edges_symmetrized(spark, d):
    return graphs.trade(spark, d)


@query
def copurchase_edges(spark, d):
    return graphs.copurchase(spark, d)


# --- matrices -----------------------------------------------------------------------------------------------------------


def _matrix(name: str, null: str) -> Query:
    return lambda spark, d: matrices.entries(graphs.trade(spark, d), name, null).select("src", "dst", six(F.col("v")).alias("v"))


for _name in matrices.ENTRIES:
    if _name.startswith("laplacian"):
        QUERIES[_name] = _matrix(_name, "ng")
    else:
        for _null in ("ng", "er"):
            QUERIES[f"{_name}_{_null}"] = _matrix(_name, _null)


@query
def degree(spark, d):
    return matrices.degrees(graphs.copurchase(spark, d))


def _part_degrees(null: str) -> Query:
    return lambda spark, d: matrices.node_table(graphs.trade(spark, d), null).select("id", six(F.col("dp")).alias("b_pos_degree"), six(F.col("dn")).alias("b_neg_degree"))


QUERIES["b_degrees_ng"], QUERIES["b_degrees_er"] = _part_degrees("ng"), _part_degrees("er")

# --- affinities ---------------------------------------------------------------------------------------------------------


@query
def knn_edges(spark, d):
    return affinity.knn(graphs.points(spark, d)).select("src", "dst", six(F.col("d2")).alias("d2"), "rank")


@query
def approximate_knn_edges(spark, d):
    """Ten neighbours of every point, from projection buckets and neighbours of neighbours."""
    return neighbours.approximate_knn(graphs.points(spark, d)).select("src", "dst", six(F.col("d2")).alias("d2"), "rank")


@query
def projection_codes(spark, d):
    """The side of each point on the planes of two tables, cut for buckets of 16."""
    p = neighbours.projections(graphs.points(spark, d), 2, 16)
    return p.select("id", "table", "code", six(F.col("along")).alias("along"))


@query
def knn_gaussian_weights(spark, d):
    return affinity.gaussian_weights(graphs.points(spark, d)).select("src", "dst", six(F.col("w")).alias("w"))


@query
def knn_symmetrized(spark, d):
    return affinity.averaged(affinity.gaussian_weights(graphs.points(spark, d))).select("src", "dst", six(F.col("w")).alias("w"))


@query
def zp_affinity(spark, d):
    return affinity.self_tuned(graphs.points(spark, d)).select("src", "dst", six(F.col("w")).alias("w"))


@query
def knn_rbf_affinity(spark, d):
    return affinity.neighbour_rbf(graphs.points(spark, d)).select("src", "dst", six(F.col("w")).alias("w"))


@query
def affinity_mean_normalized(spark, d):
    return affinity.mean_normalised(affinity.neighbour_rbf(graphs.points(spark, d))).select("src", "dst", six(F.col("w")).alias("w"))


@query
def landmark_sample(spark, d):
    return affinity.landmarks(graphs.points(spark, d), 20).select("id", "rank")


@query
def rbf_block(spark, d):
    return affinity.rbf_block(graphs.points(spark, d), 10, 0.5).select("id", "rank", six(F.col("value")).alias("value"))


@query
def rbf_div_block(spark, d):
    return affinity.rbf_block(graphs.points(spark, d), 10, 2.0, divide=True).select("id", "rank", (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query
def covariance_entries(spark, d):
    return affinity.moments(graphs.points(spark, d)).select("i", "j", six(F.col("covariance")).alias("covariance"))


@query
def gram_matrix(spark, d):
    return affinity.moments(graphs.points(spark, d)).select("i", "j", six(F.col("gram")).alias("gram"))


@query
def pca_project(spark, d):
    return affinity.pca(graphs.points(spark, d), 8).select("id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


# --- encodings ----------------------------------------------------------------------------------------------------------


@query
def onehot_pm1(spark, d):
    return labelled(spark, d).select("id", enc.onehot_pm1(F.col("label"), K).alias("u")).select("id", F.array_join(F.transform("u", lambda x: x.cast("string")), ",").alias("u"))


@query
def onehot_01(spark, d):
    return labelled(spark, d).select("id", enc.onehot_01(F.col("label"), K).alias("u")).select("id", F.array_join(F.transform("u", lambda x: x.cast("int").cast("string")), ",").alias("u"))


@query
def argmax_label(spark, d):
    return graphs.points(spark, d).select("id", enc.argmax_label(F.col("features")).alias("label"))


@query
def threshold(spark, d):
    e = graphs.points(spark, d).select("id", F.element_at("features", 1).alias("x"))
    return e.select("id", six(enc.threshold(F.col("x"))).alias("at_zero"), six(enc.threshold(F.col("x"), -0.1)).alias("below_zero"))


@query
def standard_labels(spark, d):
    n = labelled(spark, d).withColumn("label", F.col("label") * 10 + 3)
    return labelling.standard_labels(n)


@query
def binary_labels(spark, d):
    return labelling.binary_labels(labelled(spark, d).select("id", (F.col("label") + 7).alias("label")))


@query
def binary_labels_std(spark, d):
    n = labelling.standard_labels(labelled(spark, d).filter("label < 2").select("id", (F.col("label") * 4).alias("label")))
    return labelling.binary_labels(n)


@query
def communities(spark, d):
    return labelling.communities(labelled(spark, d)).select("label", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query
def communities_explode(spark, d):
    return labelling.explode_communities(labelling.communities(labelled(spark, d)))


# --- initial assignments ------------------------------------------------------------------------------------------------


@query
def init_equal(spark, d):
    return labelling.init_equal(graphs.points(spark, d), 7)


@query
def init_random(spark, d):
    return labelling.init_random(graphs.points(spark, d), 7)


@query
def init_binary_equal(spark, d):
    return labelling.init_binary_equal(graphs.points(spark, d))


@query
def init_binary_random(spark, d):
    return labelling.init_binary_random(graphs.points(spark, d)).select("id", six(F.col("u")).alias("u"))


@query
def init_binary_vector(spark, d):
    """The points' second feature stands for the second eigenvector, so that SQL can follow it."""
    return labelling.init_binary_vector(graphs.points(spark, d).select("id", F.col("features").alias("v"))).select("id", six(F.col("u")).alias("u"))


@query
def init_semi_supervised(spark, d):
    return labelling.init_semi_supervised(labelled(spark, d))


@query
def init_supervised_overlay(spark, d):
    return labelling.init_overlay(labelled(spark, d), K)


# --- metrics ------------------------------------------------------------------------------------------------------------


def _modularity(null: str, weighted: bool = True, gamma: float = 1.0) -> Query:
    def run(spark, d):
        e = graphs.trade(spark, d)
        e = e if weighted else e.withColumn("w", F.lit(1))
        return metrics.modularity(e, labelled(spark, d), null, gamma).select(six(F.col("modularity")).alias("modularity"))

    return run


QUERIES["modularity_ng"] = _modularity("ng")
QUERIES["modularity_ng_half"] = _modularity("ng", gamma=0.5)
QUERIES["modularity_er"] = _modularity("er", weighted=False)
QUERIES["modularity_er_full"] = _modularity("er_full")
QUERIES["modularity_ng_unweighted"] = _modularity("ng", weighted=False)


@query
def purity(spark, d):
    return metrics.purity(labelled(spark, d)).select(six(F.col("purity")).alias("purity"))


@query
def inverse_purity(spark, d):
    return metrics.purity(labelled(spark, d), inverse=True).select(six(F.col("purity")).alias("purity"))


@query
def ari(spark, d):
    return metrics.adjusted_rand(labelled(spark, d)).select(six(F.col("ari")).alias("ari"))


@query
def nmi(spark, d):
    return metrics.normalised_mutual_information(labelled(spark, d)).select(six(F.col("nmi")).alias("nmi"))


@query
def contingency(spark, d):
    return metrics.contingency(labelled(spark, d))


@query
def cluster_sizes(spark, d):
    return labelling.cluster_sizes(labelled(spark, d))


@query
def num_clusters(spark, d):
    return labelled(spark, d).agg(F.countDistinct("label").alias("n"))


@query
def run_report(spark, d):
    """Mean scores over repetitions: labellings of ten seeds, each scored, averaged for each number of classes."""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("truth"))
    runs = n.select("id", "truth", F.explode(F.array(*[F.struct(F.lit(s).alias("run"), F.lit(k).alias("k"), (key("id", s) % k).cast("int").alias("label")) for k in (4, 5) for s in range(10)])).alias("r")).select("id", "truth", "r.run", "r.k", "r.label")
    cells = runs.groupBy("k", "run", "label", "truth").agg(F.count("id").alias("n"))
    by = cells.groupBy("k", "run", "label").agg(F.max("n").alias("m"), F.sum("n").alias("n")).groupBy("k", "run").agg((F.sum("m") / F.sum("n")).alias("purity"), F.count("label").alias("classes"))
    return by.groupBy("k").agg(six(F.avg("purity")).alias("purity"), six(F.avg("classes")).alias("classes"), F.count("run").alias("runs"))


@query
def dt_bounds(spark, d):
    """The largest degree, the norm of a full +-1 assignment and the lower time bound."""
    g = matrices.degrees(graphs.trade(spark, d)).agg(F.max("d").cast("double").alias("m"), F.count("id").alias("n"))
    return g.select(six(F.col("m")).alias("max_degree"), six(F.sqrt(F.col("n") * K)).alias("norm"), F.round(0.15 / (1.5 * F.col("m")), 9).alias("dt_low"))


# --- spectra ------------------------------------------------------------------------------------------------------------


def _values(spark: SparkSession, lam) -> DataFrame:
    return spark.createDataFrame([(i, round(float(x), 6) + 0.0) for i, x in enumerate(lam)], "k int, value double")


@query
def spectral_embed(spark, d):
    return _values(spark, spectral.embedding(graphs.trade(spark, d), "lmix_sym", K)[0])


@query
def spectral_embed_rw(spark, d):
    return _values(spark, spectral.embedding(graphs.trade(spark, d), "lmix_rw", K)[0])


@query
def spectral_embed_lb(spark, d):
    return _values(spark, spectral.embedding(graphs.trade(spark, d), "lb_sym", K)[0])


@query
def power_iteration_t(spark, d):
    """Three products of I + D^-1 W with the first unit vector."""
    e = graphs.trade(spark, d)
    x = e.select(F.col("src").alias("id")).distinct().select("id", F.when(F.col("id") == 0, 1.0).otherwise(0.0).alias("x"))
    for _ in range(3):
        x = spectral.power_step(e, x)
    return x.select("id", six(F.col("x")).alias("x"))


def _nystrom(**kw) -> Query:
    return lambda spark, d: _values(spark, nystrom.spectrum(graphs.points(spark, d), 60, 8, **({"tau": 0.5} | kw))[0])


QUERIES["nystrom_l_sym"] = _nystrom()
QUERIES["nystrom_l_rw"] = _nystrom(norm="rw")
QUERIES["nystrom_lmix"] = _nystrom(kind="lmix")
QUERIES["nystrom_lmix_rw"] = _nystrom(kind="lmix", norm="rw")
QUERIES["nystrom_lmix_er"] = _nystrom(kind="lmix", null="er")
QUERIES["nystrom_lb"] = _nystrom(kind="lb")
QUERIES["nystrom_lb_er"] = _nystrom(kind="lb", null="er")
QUERIES["nystrom_classic"] = _nystrom(kind="classic", tau=2.0)


@query
def nystrom_degree_k1(spark, d):
    """Approximate degrees from one landmark: c_i * sum(c) / a, with a = 1."""
    c = affinity.rbf_block(graphs.points(spark, d), 1, 0.5)
    return c.crossJoin(F.broadcast(c.agg(F.sum("value").alias("s")))).select("id", six(F.col("value") * F.col("s")).alias("degree"))  # one row


# --- solvers ------------------------------------------------------------------------------------------------------------


def _solve(scheme: str, kind: str, times: int, **kw) -> Query:
    """The trade graph: the best of 20 starts in five classes."""

    def run(spark, d):
        e = materialise(graphs.trade(spark, d))
        lam, v = spectral.embedding(e, kind, min(times * K, 24))
        r = mbo.solve_many(scheme, lam, v, matrices.degrees(e), mbo.random_starts(matrices.degrees(e), K, list(range(20))), K, edges=e, **kw)
        return baselines.canonical(mbo.best(r, e, kw.get("gamma", 0.5)))

    return run


for _kind in ("lmix_sym", "lmix_rw", "lb_sym", "lb_rw"):
    QUERIES[f"mbo_projection_{_kind}"] = _solve("projection", _kind, 1)
    QUERIES[f"mbo_finite_difference_{_kind}"] = _solve("finite_difference", _kind, 1)
for _kind in ("laplacian_sym", "laplacian_rw"):
    QUERIES[f"mbo_hu_{_kind}"] = _solve("hu", _kind, 1, gamma=1.0)
    QUERIES[f"mbo_boyd_{_kind}"] = _solve("boyd", _kind, 5)
QUERIES["mbo_projection_modularity_stop"] = _solve("projection", "lmix_sym", 1, stopping="modularity", tol=1e-4)


def _solve_points(scheme: str, kind: str, times: int) -> Query:
    """The feature path end to end: points, their nearest neighbours' weights, eigenvectors, the solver from a random start."""

    def run(spark, d):
        p = graphs.points(spark, d)
        e = materialise(affinity.averaged(affinity.gaussian_weights(p)))
        lam, v = spectral.embedding(e, kind, 10 * times)
        r = mbo.solve(scheme, lam, v, matrices.degrees(e), labelling.init_random(p, 10, 7), 10, edges=e)
        return r.labels.select("id", "label")

    return run


QUERIES["mbo_points_projection"] = _solve_points("projection", "lmix_sym", 1)
QUERIES["mbo_points_finite_difference"] = _solve_points("finite_difference", "lmix_sym", 1)
QUERIES["mbo_points_hu"] = _solve_points("hu", "laplacian_sym", 1)
QUERIES["mbo_points_boyd"] = _solve_points("boyd", "laplacian_sym", 2)


def _rounds(scheme: str, rounds: int) -> Query:
    """Rounds over all points: the first four features stand for eigenvectors, so that SQL can follow them."""

    def run(spark, d):
        p = graphs.points(spark, d)
        deg = p.select("id", (1 + F.col("id") % 5).cast("double").alias("d"))
        r = mbo.solve(scheme, [0.1, 0.2, 0.3, 0.4], p.select("id", F.slice("features", 1, 4).alias("v")), deg, labelling.init_random(p, 5, 7), 5, max_iter=rounds)
        return r.labels.select("id", "label")

    return run


for _scheme in ("projection", "finite_difference", "hu", "boyd"):
    QUERIES[f"mbo_round_{_scheme}"] = _rounds(_scheme, 1)
    QUERIES[f"mbo_rounds_{_scheme}"] = _rounds(_scheme, 4)


@query
def mbo_threshold(spark, d):
    """Labels from the forcing step's scores."""
    n = labelled(spark, d)
    return mbo.threshold(mbo.hu_forcing(n, matrices.degrees(graphs.trade(spark, d)), K, 0.5, 0.001))


@query
def mbo_stop_standard(spark, d):
    a, b = labelled(spark, d), graphs.nations(spark, d, K, 8)
    return labelling.changed(a, b)


@query
def mbo_stop_modularity(spark, d):
    e = graphs.trade(spark, d)
    a, b = metrics.modularity(e, labelled(spark, d)), metrics.modularity(e, graphs.nations(spark, d, K, 8))
    return a.crossJoin(b.withColumnRenamed("modularity", "other")).select(six(F.abs(F.col("modularity") - F.col("other"))).alias("stop"))  # one row each


@query
def hu_degree_weighted_mean(spark, d):
    return mbo.hu_mean(labelled(spark, d), matrices.degrees(graphs.trade(spark, d)), K).select("k", six(F.col("mean")).alias("mean"))


@query
def hu_forcing_step(spark, d):
    return mbo.hu_forcing(labelled(spark, d), matrices.degrees(graphs.trade(spark, d)), K, 0.5, 0.001).select("id", "k", six(F.col("w")).alias("w"))


# --- baselines ----------------------------------------------------------------------------------------------------------


@query
def louvain(spark, d):
    return baselines.louvain(graphs.trade(spark, d))


@query
def louvain_moves(spark, d):
    """Four rounds of moves, from single nodes."""
    return baselines.local_moves(materialise(graphs.trade(spark, d)), rounds=4)[0].select("id", "label")


@query
def louvain_delta_q(spark, d):
    return baselines.move_gains(graphs.trade(spark, d), labelled(spark, d)).select("id", "own", "cand", six(F.col("gain")).alias("gain"))


@query
def graph_contract(spark, d):
    return baselines.contract(graphs.trade(spark, d), labelled(spark, d))


@query
def cnm(spark, d):
    return baselines.greedy_merge(graphs.trade(spark, d))


@query
def cnm_first_merge(spark, d):
    return baselines.first_merge(graphs.trade(spark, d))


@query
def girvan_newman(spark, d):
    return baselines.girvan_newman(graphs.trade(spark, d))


@query
def cnm_batches(spark, d):
    """Greedy merging of the heaviest trade links by its distributed rounds."""
    return baselines.merge_batches(materialise(_strong_links(spark, d)))


@query
def edge_betweenness(spark, d):
    """Shortest paths through each of the trade links of more than the mean weight."""
    b = baselines.edge_betweenness(_heavy_links(spark, d))
    return b.select("src", "dst", six(F.col("paths")).alias("paths"))


def _strong_links(spark: SparkSession, d: str) -> DataFrame:
    """The three heaviest links of each nation, both directions."""
    e = graphs.trade(spark, d)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    strong = e.withColumn("rank", rank).filter("rank <= 3")
    return strong.select("src", "dst", "w").union(strong.select("dst", "src", "w")).distinct()


def _heavy_links(spark: SparkSession, d: str) -> DataFrame:
    e = graphs.trade(spark, d)
    return e.crossJoin(F.broadcast(e.agg(F.avg("w").alias("mean")))).filter("w > mean").select("src", "dst")  # one row


@query
def bfs_levels(spark, d):
    return baselines.bfs_levels(graphs.trade(spark, d))


@query
def connected_components(spark, d):
    """Components of the heaviest trade links."""
    e = graphs.trade(spark, d)
    cut = e.groupBy("src").agg(F.max("w").alias("m"))
    strong = e.join(cut, "src").filter("w = m").select("src", "dst")
    both = strong.union(strong.select("dst", "src")).distinct()
    return baselines.connected_components(both)


@query
def spectral_kmeans(spark, d):
    return baselines.spectral_kmeans(graphs.trade(spark, d), K)


@query
def power_clusters(spark, d):
    """The trade graph in five clusters by six power steps and five rounds on the line."""
    return baselines.power_clusters(materialise(graphs.trade(spark, d)), K, 6, 5)


# --- experiments --------------------------------------------------------------------------------------------------------


@query
def experiment_grid(spark, d):
    """The whole grid on the trade graph: twelve configurations of 20 starts and the baselines, and the operators that hold a null model
    once more (_er) with the uniform one; all but the time."""
    e, n = graphs.trade(spark, d), labelled(spark, d).select("id", "truth")
    runs = experiment.run_grid(e, n, K, nulls=("ng", "er"), others=experiment.BASELINES, gamma=1.0)
    return experiment.averages(runs).select("algo", "operator", "runs", "n_iter", *[six(F.col(c)).alias(c) for c in ("modularity", "modularity_er", "ari", "purity", "inverse_purity", "nmi")])


@query
def landmark_grid(spark, d):
    """The feature path of all twelve configurations: spectra of the full kernel from 60 landmarks, degrees and scores from the graph of
    nearest neighbours, five starts each, stopped by modularity; and the label counts' scores against the points' classes."""
    p = materialise(graphs.points(spark, d))
    e = affinity.averaged(affinity.gaussian_weights(p))
    runs = experiment.run_grid(e, p.select("id", "truth"), 10, repeats=5, n_t=5, tol=1e-4, stopping="modularity", spectra=experiment.landmark_spectra(p, 60, 0.5))
    return experiment.averages(runs).select("algo", "operator", "runs", "n_iter", *[six(F.col(c)).alias(c) for c in ("modularity", "modularity_er", "ari", "purity", "inverse_purity", "nmi")])
