"""The grid of experiments: every solver on every operator, over repeated starts, scored and averaged."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import labelling, metrics
from ..operators.matrices import degrees
from . import baselines, mbo, nystrom, spectral
from .tables import discard, materialise

#: The twelve configurations: solver, operator, eigenvectors per class.
CONFIGURATIONS = [(s, o, 1) for s in ("projection", "finite_difference") for o in ("lmix_sym", "lmix_rw", "lb_sym", "lb_rw")] + [("hu", o, 1) for o in ("laplacian_sym", "laplacian_rw")] + [("boyd", o, 5) for o in ("laplacian_sym", "laplacian_rw")]
BASELINES: dict[str, Callable[[DataFrame, int, float], DataFrame]] = {
    "louvain": lambda e, k, gamma: baselines.louvain(e, gamma),
    "cnm": lambda e, k, gamma: baselines.greedy_merge(e, gamma),
    "girvan_newman": lambda e, k, gamma: baselines.girvan_newman(e),
    "spectral": lambda e, k, gamma: baselines.spectral_kmeans(e, k),
}
SCORES = ("modularity", "modularity_er", "ari", "purity", "inverse_purity", "nmi")
SCHEMA = "run int, algo string, operator string, n_iter int, converged boolean, modularity double, modularity_er double, ari double, purity double, inverse_purity double, nmi double, secs double"


def _scores(edges: DataFrame, labels: DataFrame, truth: DataFrame, gamma: float) -> dict[int, dict]:
    """The scores of every run of labels (run, id, label)."""
    both = materialise(labels.hint("merge").join(truth.select("id", "truth"), "id"))  # never to the driver
    out = {r["run"]: r.asDict() for r in metrics.report(edges, both, gamma, ("run",)).collect()}
    discard(both)
    return out


def _starts(truth: DataFrame, k: int, repeats: int, init: str) -> DataFrame:
    if init == "random":
        return mbo.random_starts(truth, k, list(range(repeats)))
    runs = None
    for run in range(repeats):
        one = labelling.init_equal(truth.select("id"), k, run).select("id", F.struct(F.lit(run).alias("run"), "label").alias("s"))
        runs = one if runs is None else runs.unionByName(one)
    return runs.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["label"]).alias("labels"))


def _spectra(edges: DataFrame, configurations: list[tuple[str, str, int]], k: int, n: int, null: str) -> dict[tuple[str, int], tuple]:
    """(kind, pairs) to eigenvalues, vectors and seconds: one eigen-solve for all that differ in the number of pairs or the norm alone."""
    out: dict[tuple[str, int], tuple] = {}
    solved: dict[str, tuple] = {}
    tables = {norm: spectral.scaled(edges, norm, null) for norm in {"rw" if kind == "lb_rw" else "sym" for _, kind, _ in configurations}}
    for kind in dict.fromkeys(kind for _, kind, _ in configurations):
        sizes = sorted({min(times * k, n - 1) for _, x, times in configurations if x == kind})
        base = kind.rsplit("_", 1)[0]
        name = kind if base == "lb" else base
        most = max(min(times * k, n - 1) for _, x, times in configurations if x == kind or (base != "lb" and x.startswith(base)))
        began = time.perf_counter()
        if name not in solved:
            solver = kind if base == "lb" else f"{base}_sym"
            op = spectral.operator(edges, solver, null, tables[solver.rsplit("_", 1)[1]])
            lam, v = spectral.smallest(op, most)
            solved[name] = lam, materialise(v.join(op.nodes.select("id", "l"), "id"))
        lam, v = solved[name]
        rows = v.select("id", F.transform("v", lambda x: x * F.col("l")).alias("v")) if kind.endswith("_rw") and base != "lb" else v.select("id", "v")
        secs = time.perf_counter() - began
        for m in sizes:
            out[kind, m] = lam[:m], rows.select("id", F.slice("v", 1, m).alias("v")), secs
    for pair in tables.values():
        discard(*pair)
    return out


def landmark_spectra(points: DataFrame, landmarks: int, tau: float) -> Callable[..., dict[tuple[str, int], tuple]]:
    """What `run_grid` takes as `spectra`: those of the full kernel graph of the points from landmarks, where edges (of nearest
    neighbours, say) only give degrees and scores."""

    def spectra(edges: DataFrame, configurations: list[tuple[str, str, int]], k: int, n: int, null: str) -> dict[tuple[str, int], tuple]:
        out = {}
        for kind in dict.fromkeys(kind for _, kind, _ in configurations):
            sizes = sorted({min(times * k, n - 1, landmarks) for _, x, times in configurations if x == kind})
            base, norm = kind.rsplit("_", 1)
            began = time.perf_counter()
            lam, v = nystrom.spectrum(points, landmarks, sizes[-1], tau, kind=base, null=null, norm=norm)
            v = materialise(v)
            secs = time.perf_counter() - began
            for _, x, times in configurations:
                if x == kind:
                    m = min(times * k, n - 1, landmarks, len(lam))
                    out[kind, min(times * k, n - 1)] = lam[:m], v.select("id", F.slice("v", 1, m).alias("v")), secs
        return out

    return spectra


def run_grid(edges: DataFrame, truth: DataFrame, k: int, nulls: Iterable[str] = ("ng",), repeats: int = 20, configurations: Iterable[tuple[str, str, int]] = tuple(CONFIGURATIONS), others: Iterable[str] = (), gamma: float = 0.5, n_t: int = 3, tol: float = 0.0, stopping: str = "standard", init: str = "random", spectra: Callable[..., dict[tuple[str, int], tuple]] | None = None) -> DataFrame:
    """A row for each run. spectra: where eigenpairs come from, if not from the graph of `edges` itself. All starts of all configurations are solved together, a round being one pass for all that still run, and scored
    together. Operators that hold a null model are solved for each of `nulls` (named <operator>_er for the uniform one), the
    others once. gamma is the resolution of solvers, baselines and scores. secs holds the eigen-solver and an equal share of the solver. truth: (id, truth)."""
    spark, rows = edges.sparkSession, []
    edges = materialise(edges)
    deg, starts = materialise(degrees(edges)), materialise(_starts(truth, k, repeats, init))
    n = deg.count()
    problems, names, eigen = [], [], []
    for i, null in enumerate(nulls):
        some = [c for c in configurations if not i or not c[1].startswith("laplacian")]
        solved = (spectra or _spectra)(edges, some, k, n, null)
        for algo, kind, times in some:
            lam, v, secs = solved[kind, min(times * k, n - 1)]
            problems.append(mbo.Problem(algo, lam, v))
            names.append((algo, f"{kind}_er" if null == "er" and not kind.startswith("laplacian") else kind))
            eigen.append(secs)
    if problems:
        began = time.perf_counter()
        r = mbo.solve_together(problems, deg, starts, k, edges=edges, tol=tol, n_t=n_t, gamma=gamma, stopping=stopping)
        share = (time.perf_counter() - began) / len(r.rounds)
        for i, s in sorted(_scores(edges, r.labels, truth, gamma).items()):
            p, run = divmod(i, repeats)
            rows.append((run, *names[p], r.rounds[i], r.converged[i], *[s[c] for c in SCORES], eigen[p] + share))
    told, took = [], []
    for i, name in enumerate(others):
        began = time.perf_counter()
        told.append(materialise(BASELINES[name](edges, k, gamma).select("id", F.col("label").cast("long").alias("label"), F.lit(i).alias("run"))))
        took.append((name, time.perf_counter() - began))
    if told:
        found = _scores(edges, reduce(DataFrame.unionByName, told), truth, gamma)
        rows += [(0, name, "-", None, True, *[found[i][c] for c in SCORES], secs) for i, (name, secs) in enumerate(took)]
        discard(*told)
    discard(deg, starts, edges)
    return spark.createDataFrame(rows, SCHEMA)


def averages(runs: DataFrame) -> DataFrame:
    """The mean of every score for each configuration."""
    scores = ["n_iter", "modularity", "modularity_er", "ari", "purity", "inverse_purity", "nmi", "secs"]
    return runs.groupBy("algo", "operator").agg(F.count("run").alias("runs"), *[F.avg(c).alias(c) for c in scores])
