"""Low-rank spectra of a full kernel graph from k landmarks.

C (n x k) is the kernel against the landmarks, A its landmark rows. With A+ the pseudo-inverse, W ~ C A+ C'. Every variant
needs sums of rows and products of C with itself: narrow passes over the points with partial sums, k x k work on the driver
(k is a parameter), and one pass that makes the vectors. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.affinity import landmarks
from ..shipping import ship
from .tables import materialise

RCOND = 1e-10


def kernel_rows(points: DataFrame, marks: np.ndarray, tau: float, divide: bool = False) -> DataFrame:
    """(id, c): the kernel of every point against the landmarks; divide: exp(-d2 / tau)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(list(pdf.features))
                d2 = np.maximum((x**2).sum(1)[:, None] - 2 * x @ marks.T + (marks**2).sum(1)[None, :], 0)
                yield pd.DataFrame({"id": pdf.id, "c": list(np.exp(-d2 / tau if divide else -tau * d2))})

    return points.select("id", "features").mapInPandas(run, "id long, c array<double>")


def _sum(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of f over blocks of C; one array for each partition reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                part = f(np.stack(list(pdf.c)))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"s": [np.asarray(total, float).ravel()]})

    return sum(np.array(r["s"]) for r in rows.select("c").mapInPandas(run, "s array<double>").collect())


def _vectors(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf.id, "v": list(f(np.stack(list(pdf.c))))})

    return rows.mapInPandas(run, "id long, v array<double>")


def _root(x: np.ndarray) -> np.ndarray:
    """1 / sqrt, zero where x is not positive (a negative approximate degree)."""
    return np.where(x > 0, 1 / np.sqrt(np.where(x > 0, x, 1)), 0)


def spectrum(points: DataFrame, k: int, m: int, tau: float, kind: str = "laplacian", null: str = "ng", norm: str = "sym", truncated: bool = False, own_null_degree: bool = True, seed: int = 7) -> tuple[np.ndarray, DataFrame]:
    """The m smallest eigenvalues and (id, v). kind: laplacian, lmix, lb or classic; norm: sym or rw.

    truncated sums the whole part of each degree in the total; own_null_degree scales the uniform null model by its own degree."""
    ship(points.sparkSession)
    p = points.select("id", "features")
    marks = np.array([r["features"] for r in landmarks(p, k, seed).orderBy("rank").collect()])  # k rows
    k = len(marks)
    rows = materialise(kernel_rows(p, marks, tau, divide=kind == "classic"))
    d2 = np.maximum((marks**2).sum(1)[:, None] - 2 * marks @ marks.T + (marks**2).sum(1)[None, :], 0)
    a = np.exp(-d2 / tau if kind == "classic" else -tau * d2)
    ai = np.linalg.pinv(a, rcond=RCOND, hermitian=True)
    n = rows.count()
    y = ai @ _sum(rows, lambda c: c.sum(0))
    degree = lambda c: c @ y
    if kind == "classic":
        return _one_shot(rows, a, degree, m, norm)
    if kind == "laplacian":
        scaled = lambda c: c * _root(degree(c))[:, None]
        return _solve(rows, scaled, ai, m, 1.0, (lambda c: _root(degree(c))) if norm == "rw" else None)
    total = float(_sum(rows, lambda c: np.array([np.floor(degree(c)).sum() if truncated else degree(c).sum()]))[0])
    rho = total / (n * (n - 1))
    mark_degree = degree(a)

    def null_block(c: np.ndarray) -> np.ndarray:
        return np.outer(degree(c), mark_degree) / total if null == "ng" else np.full(c.shape, rho)

    def low_rank_degree(part: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        inner = np.linalg.pinv(part(a), rcond=RCOND)
        z = inner @ _sum(rows, lambda c: part(c).sum(0))
        return lambda c: part(c) @ z

    if kind == "lmix":
        dn = (lambda c: np.full(len(c), rho * n)) if null == "er" and own_null_degree else degree

        def block(c: np.ndarray) -> np.ndarray:
            def scale(x: np.ndarray, d: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
                left, right = _root(d(c)), _root(d(a))
                return x * (left[:, None] * right[None, :] if norm == "sym" else (left**2)[:, None])

            return scale(c, degree) - scale(null_block(c), dn)
    else:
        pos, neg = (lambda c: np.maximum(c - null_block(c), 0)), (lambda c: np.maximum(null_block(c) - c, 0))
        dp, dm = low_rank_degree(pos), low_rank_degree(neg)

        def block(c: np.ndarray) -> np.ndarray:
            def scale(x: np.ndarray, d: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
                left, right = _root(d(c)), _root(d(a))
                return x * (left[:, None] * right[None, :] if norm == "sym" else (left**2)[:, None])

            return scale(pos(c), dp) - scale(neg(c), dm)

    return _solve(rows, block, np.linalg.pinv(block(a), rcond=RCOND), m, 2.0, None, positive=kind == "lb")


def _one_shot(rows: DataFrame, a: np.ndarray, degree: Callable[[np.ndarray], np.ndarray], m: int, norm: str) -> tuple[np.ndarray, DataFrame]:
    """1 less the eigenvalues of R = A^-1/2 G A^-1/2, G the sum of c c' over all points, kernel and landmark block scaled by their degrees:
    with U from R, C A^-1/2 U are the vectors, whose lengths are the roots of R's eigenvalues. The kernel must be positive semidefinite, as
    no eigenvalue of A below zero has a root."""

    def scaled(c: np.ndarray) -> np.ndarray:
        return c * _root(degree(c))[:, None]

    inside = _root(degree(a))
    s, u = np.linalg.eigh(a * np.outer(inside, inside))
    keep = s > s[-1] * RCOND
    half = (u[:, keep] / np.sqrt(s[keep])) @ u[:, keep].T  # the root of the pseudo-inverse
    g = _sum(rows, lambda c: (scaled(c) * inside).T @ (scaled(c) * inside)).reshape(a.shape)
    r = half @ g @ half
    lam, w = np.linalg.eigh((r + r.T) / 2)
    lam, w = lam[::-1][:m], w[:, ::-1][:, :m]
    ok = lam > lam[0] * RCOND
    to = (inside[:, None] * half @ w[:, ok]) / np.sqrt(lam[ok])
    if norm == "rw":
        return 1 - lam[ok], _vectors(rows, lambda c: scaled(c) @ to * _root(degree(c))[:, None])
    return 1 - lam[ok], _vectors(rows, lambda c: scaled(c) @ to)


def _solve(rows: DataFrame, block: Callable[[np.ndarray], np.ndarray], inner: np.ndarray, m: int, shift: float, rescale: Callable[[np.ndarray], np.ndarray] | None, positive: bool = False) -> tuple[np.ndarray, DataFrame]:
    """Eigenpairs of shift * I - B inner B' with B = block(C), by the Gram matrix of B (rank-revealing)."""
    k = len(inner)
    g = _sum(rows, lambda c: block(c).T @ block(c)).reshape(k, k)
    s, u = np.linalg.eigh((g + g.T) / 2)
    keep = s > max(s[-1], 0) * 1e-12
    s, u = s[keep], u[:, keep]
    r = np.sqrt(s)[:, None] * u.T  # B = Q R
    small = r @ inner @ r.T
    lam, w = np.linalg.eigh((small + small.T) / 2)
    lam, w = lam[::-1], w[:, ::-1]  # descending, so shift - lam ascends
    values = shift - lam
    if positive:
        ok = values > 0
        values, w = values[ok], w[:, ok]
    values, w = values[:m], w[:, :m]
    to = (u / np.sqrt(s)) @ w
    if rescale is None:
        return values, _vectors(rows, lambda c: block(c) @ to)
    return values, _vectors(rows, lambda c: (block(c) @ to) * rescale(c)[:, None])
