"""Modularity maximisation by alternating diffusion and thresholding, in the space of m eigenvectors.

A node's state is its label in each of several runs (problems times starts): the largest entry of its row of V times a filtered m x K matrix. So a
state is that matrix, and a round is one narrow pass over V for all runs at once, which writes nothing: it takes the labels of
this state and of the last one, counts the moves, and sums V'u of the new labels u, which the driver filters. A partition sends
runs * m * K numbers, whatever its nodes.

A run ends when its stopping rule holds, or after max_iter rounds. A state that comes again makes the rounds periodic: then the
state after max_iter rounds is known to be one of the period, and only the rounds up to it are made. `converged` tells which.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import key
from ..operators.metrics import modularity
from ..shipping import ship
from .quality import Tracker
from .tables import discard, materialise

MAX_ITER = 10_000


@dataclass
class Result:
    labels: DataFrame  # (id, label); solve_many: (run, id, label)
    rounds: int | list[int]
    trace: list[float]
    converged: bool | list[bool] = True


def time_step(max_degree: float, lam: float, n: int, k: int, gamma: float = 0.5, eps: float = 1.0) -> float:
    """The geometric mean of a lower and an upper bound."""
    low = 0.15 / ((gamma + 1) * max_degree)
    return float(np.sqrt(low * np.log(np.sqrt(n * k) / eps) / lam))


def _one(labels: np.ndarray, k: int) -> np.ndarray:
    """+1 at the label, -1 elsewhere; labels below 0 stand for none."""
    u = -np.ones((len(labels), k))
    ok = labels >= 0
    u[np.flatnonzero(ok), labels[ok]] = 1
    return u


def _digest(ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Two 32-bit halves of an order-free hash of (id, label)."""
    x = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((labels.astype(np.int64).view(np.uint64) + np.uint64(3)) * np.uint64(0xD1342543DE82EF95))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    t = (x ^ (x >> np.uint64(29))).sum(dtype=np.uint64)
    return np.array([float(t >> np.uint64(32)), float(t & np.uint64(0xFFFFFFFF))])


def _sums(v: np.ndarray, d: np.ndarray, labels: np.ndarray, ids: np.ndarray, k: int, forced: bool) -> np.ndarray:
    u = _one(labels, k)
    more = [v.T @ (u * d[:, None]), d @ u] if forced else []
    return np.concatenate([a.ravel() for a in (v.T @ u, *more, _digest(ids, labels))])


Filters = list[np.ndarray | None]


@dataclass
class Run:
    """One start of one problem. Its filter is None while the state is the start itself."""

    slot: int  # which of a node's rows of eigenvectors
    first: int  # which of a node's first labels
    m: int
    forced: bool

    def labels(self, v: list[np.ndarray], first: np.ndarray, c: np.ndarray | None) -> np.ndarray:
        return first[:, self.first] if c is None else (v[self.slot] @ c).argmax(1)


def _arrays(pdf: pd.DataFrame, slots: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows of V of each slot, and the first labels."""
    return [np.stack([x[s] for x in pdf.vs]) for s in range(slots)], np.stack(list(pdf.labels))


def _round(start: DataFrame, slots: int, runs: list[Run], old: Filters, new: Filters, k: int) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """For each run the sums of the new state over all nodes, and how many nodes have moved: one pass for all runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, moved = None, np.zeros(len(new), np.int64)
        for pdf in batches:
            if len(pdf):
                (v, first), d, ids = _arrays(pdf, slots), pdf.d.to_numpy(), pdf.id.to_numpy()
                parts = []
                for i, r in enumerate(runs):
                    now = r.labels(v, first, new[i])
                    moved[i] += (now != r.labels(v, first, old[i])).sum()
                    parts.append(_sums(v[r.slot], d, now, ids, k, r.forced))
                part = np.concatenate(parts)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"s": [total], "moved": [moved]})

    rows = start.mapInPandas(run, "s array<double>, moved array<long>").collect()  # a row for each partition
    flat, at, out = np.sum([r["s"] for r in rows], axis=0), 0, []
    for r in runs:
        parts = []
        for shape in [(r.m, k), *([(r.m, k), (k,)] if r.forced else []), (2,)]:
            size = int(np.prod(shape))
            parts.append(flat[at : at + size].reshape(shape))
            at += size
        out.append(parts)
    return out, np.sum([r["moved"] for r in rows], axis=0)


def _moments(start: DataFrame, slot: int) -> tuple[np.ndarray, np.ndarray]:
    """V'DV and V'd."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                v, d = np.stack([x[slot] for x in pdf.vs]), pdf.d.to_numpy()
                part = np.concatenate([(v.T @ (v * d[:, None])).ravel(), v.T @ d])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"s": [total]})

    total = np.sum([r["s"] for r in start.select("vs", "d").mapInPandas(run, "s array<double>").collect()], axis=0)
    m = int((np.sqrt(4 * len(total) + 1) - 1) / 2)
    return total[: m * m].reshape(m, m), total[m * m :]


def random_starts(nodes: DataFrame, k: int, seeds: list[int]) -> DataFrame:
    """(id, labels): a uniform class for each node and seed, as labelling.init_random gives for each."""
    return nodes.select("id", F.array(*[(key("id", s) % k).cast("int") for s in seeds]).alias("labels"))


@dataclass
class Problem:
    """A scheme (projection, finite_difference, hu or boyd) on a spectrum: eigenvalues and (id, v)."""

    scheme: str
    lam: np.ndarray
    vectors: DataFrame


def _filter(p: Problem, max_degree: float, n: int, k: int, n_t: int, gamma: float, eps: float) -> tuple[np.ndarray, float]:
    """What a round multiplies the coefficients of the eigenvectors by, and the time step."""
    lam, scheme = np.asarray(np.real(p.lam), float), p.scheme
    positive = lam[lam > 1e-9]
    # a disconnected graph has several zero eigenvalues: the first that is not counts
    pick = (lam[0] if scheme == "finite_difference" else lam[1]) if len(lam) > 1 else lam[0]
    pick = pick if pick > 1e-9 else (positive[0] if len(positive) else 1.0)
    dt = time_step(max_degree, pick, n, k, gamma, eps)
    if scheme == "finite_difference":
        dt /= 2 * n_t
    filters = {"projection": lambda: np.exp(-0.5 * lam * dt), "boyd": lambda: np.exp(-lam * dt), "finite_difference": lambda: 1 / (1 + dt * lam), "hu": lambda: 1 / (1 + dt * lam)}
    return filters[scheme]()[:, None], dt


def solve_together(problems: list[Problem], degrees: DataFrame, inits: DataFrame, k: int, edges: DataFrame | None = None, tol: float = 0.0, n_t: int = 3, gamma: float = 0.5, eps: float = 1.0, max_iter: int = MAX_ITER, stopping: str = "standard") -> Result:
    """All problems from all starts, every round one pass for all that still run. degrees: (id, d); inits: (id, labels), null for none, a
    label for each start. Runs are numbered problem by problem: run p * starts + s is start s of problem p.

    stopping: standard (four times the nodes that move) or modularity (of `edges`), at most tol."""
    spark = inits.sparkSession
    ship(spark)
    tables = {id(p.vectors): p.vectors for p in problems}  # a spectrum that several problems share is held once
    slot = {key_: i for i, key_ in enumerate(tables)}
    rows = None
    for key_, table in tables.items():
        one = table.select("id", F.struct(F.lit(slot[key_]).alias("slot"), "v").alias("s"))
        rows = one if rows is None else rows.unionByName(one)
    vs = rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["v"]).alias("vs"))
    state = vs.join(degrees.select("id", F.col("d").cast("double").alias("d")), "id").join(inits, "id").select("id", "vs", "d", F.transform("labels", lambda x: F.coalesce(x.cast("int"), F.lit(-1))).alias("labels"))
    start = materialise(state)
    stats = start.agg(F.max("d").alias("m"), F.count("id").alias("n"), F.sum("d").alias("t"), F.max(F.size("labels")).alias("runs")).first()
    total, starts = stats["t"], stats["runs"]
    filters = [_filter(p, stats["m"], stats["n"], k, n_t, gamma, eps) for p in problems]
    forcing = {slot[id(p.vectors)]: None for p in problems if p.scheme == "hu"}
    forcing = {s: _moments(start, s) for s in forcing}
    runs = [Run(slot[id(p.vectors)], s, len(p.lam), p.scheme == "hu") for p in problems for s in range(starts)]

    def filtered(i: int, sums: list[np.ndarray]) -> np.ndarray:
        filt, dt = filters[i // starts]
        if not runs[i].forced:
            return filt * sums[0]
        # inner steps in the space of the eigenvectors: w = u + sum of 2 gamma dt D (v_j - mean_j)
        (vw, vdu, du, _), (vdv, vd), c = sums, forcing[runs[i].slot], None
        for _ in range(n_t):
            mean = (du if c is None else vd @ c) / total
            vw = vw + 2 * gamma * dt * ((vdu if c is None else vdv @ c) - np.outer(vd, mean))
            c = filt * vw
        return c

    n = len(runs)
    state: Filters = [None] * n
    found, _ = _round(start, len(slot), runs, state, state, k)
    sums = dict(enumerate(found))
    seen: list[dict[tuple, int]] = [{tuple(s[-1]): 0} for s in found]
    last, rounds, converged, before = [max_iter] * n, [0] * n, [False] * n, [0.0] * n
    trace: list[float] = []
    live = list(range(n)) if max_iter > 0 else []
    tracker = Tracker(edges, n, k, gamma) if stopping == "modularity" else None
    t = 0
    while live:
        new = list(state)
        for i in live:
            new[i] = filtered(i, sums[i])
        found, count = _round(start, len(slot), [runs[i] for i in live], [state[i] for i in live], [new[i] for i in live], k)
        sums, moved = dict(zip(live, found, strict=True)), dict(zip(live, count, strict=True))
        was, state, t = state, new, t + 1
        quality: dict[int, float] = {}
        if tracker:
            labels = _labels(start, len(slot), [runs[i] for i in live], [was[i] for i in live], [state[i] for i in live])
            if t == 1:
                tracker.full(labels, live)
            else:
                tracker.update(labels, live, int(sum(moved.values())))
            quality = dict(enumerate(tracker.modularity().tolist()))
        if n == 1 and quality:
            trace.append(quality[0])
        still = []
        for i in live:
            rounds[i] = t
            stop = abs(quality[i] - before[i]) if quality else 4.0 * moved[i]
            before[i] = quality.get(i, 0.0)
            if stop <= tol:
                converged[i] = True
                continue
            if t < last[i] and (since := seen[i].setdefault(tuple(sums[i][-1]), t)) < t and last[i] == max_iter:
                last[i] = t + (max_iter - t) % (t - since)  # the state after max_iter rounds
            if t >= last[i]:
                rounds[i] = max_iter
                continue
            still.append(i)
        live = still
    out = materialise(_runs(start, len(slot), runs, state))
    discard(start)
    if tracker:
        tracker.close()
    return Result(out, rounds, trace, converged)


def solve_many(scheme: str, lam: np.ndarray, vectors: DataFrame, degrees: DataFrame, inits: DataFrame, k: int, **kw) -> Result:
    """solve_together for one problem: a run is a start."""
    return solve_together([Problem(scheme, lam, vectors)], degrees, inits, k, **kw)


def _runs(start: DataFrame, slots: int, runs: list[Run], state: Filters) -> DataFrame:
    """(run, id, label); -1 for none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v, first = _arrays(pdf, slots)
                now = np.stack([r.labels(v, first, c) for r, c in zip(runs, state, strict=True)], 1)
                yield pd.DataFrame({"run": np.tile(np.arange(now.shape[1], dtype=np.int32), len(now)), "id": np.repeat(pdf.id.to_numpy(), now.shape[1]), "label": now.ravel().astype(np.int32)})

    return start.mapInPandas(run, "run int, id long, label int")


def _labels(start: DataFrame, slots: int, runs: list[Run], was: Filters, now: Filters) -> DataFrame:
    """(id, was, now): the labels of all runs in two states; -1 for none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v, first = _arrays(pdf, slots)
                a, b = (np.stack([r.labels(v, first, c) for r, c in zip(runs, state, strict=True)], 1).astype(np.int32) for state in (was, now))
                yield pd.DataFrame({"id": pdf.id, "was": list(a), "now": list(b)})

    return start.mapInPandas(run, "id long, was array<int>, now array<int>")


def solve(scheme: str, lam: np.ndarray, vectors: DataFrame, degrees: DataFrame, init: DataFrame, k: int, **kw) -> Result:
    """solve_many for one start (id, label)."""
    r = solve_many(scheme, lam, vectors, degrees, init.select("id", F.array("label").alias("labels")), k, **kw)
    return Result(r.labels.select("id", "label"), r.rounds[0], r.trace, r.converged[0])


def best(result: Result, edges: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(id, label) of the run of largest modularity; the first of equal ones."""
    q = modularity(edges, result.labels, "ng", gamma, ("run",)).orderBy(F.desc(F.round("modularity", 9)), "run").limit(1)
    return result.labels.join(F.broadcast(q.select("run")), "run").select("id", "label")  # one row


def hu_mean(labels: DataFrame, degrees: DataFrame, k: int) -> DataFrame:
    """(k, mean): the degree-weighted mean of each class's +-1 column."""
    u = F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(i.alias("k"), F.when(i == F.col("label"), 1).otherwise(-1).alias("u"))))
    e = labels.join(degrees, "id").select("d", u.alias("c")).select("d", "c.k", "c.u")
    return e.groupBy("k").agg((F.sum(F.col("d") * F.col("u")) / F.sum("d")).alias("mean"))


def hu_forcing(labels: DataFrame, degrees: DataFrame, k: int, gamma: float, dt: float) -> DataFrame:
    """(id, k, w): the state after the first forcing step, u + 2 gamma dt D (u - mean)."""
    u = F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(i.alias("k"), F.when(i == F.col("label"), 1.0).otherwise(-1.0).alias("u"))))
    e = labels.join(degrees, "id").select("id", "d", u.alias("c")).select("id", "d", "c.k", "c.u")
    mean = F.broadcast(hu_mean(labels, degrees, k))  # k rows
    return e.join(mean, "k").select("id", "k", (F.col("u") + 2 * gamma * dt * F.col("d") * (F.col("u") - F.col("mean"))).alias("w"))


def threshold(scores: DataFrame) -> DataFrame:
    """(id, k, w) to (id, label): the class of the largest score, the lower one in a tie."""
    return scores.groupBy("id").agg(F.max_by("k", F.struct("w", (-F.col("k")).alias("o"))).alias("label"))
