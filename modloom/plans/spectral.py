"""Smallest eigenpairs of graph operators, applied without storing n x n matrices.

An operator is a shift, sparse terms (a column of the edge table between two node scalings) and rank-one terms (products of
node columns, applied as scalar products). Graphs of up to DENSE nodes, a checked bound, are solved on the driver; larger
ones over packed parts of the graph (plans/blocks.py), a shuffle for each product: by a block Krylov method with thick restarts or, without
symmetry and where a Krylov space ends, by Chebyshev-filtered subspace iteration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import key
from ..operators.matrices import node_table, null_weight
from ..shipping import ship
from .blocks import Blocks, beside, turned, turned_parts, unpacked
from .tables import discard, materialise, materialise_by

DENSE = 2048
#: Products of a chain; vectors of a basis at most and after a restart, for each one asked for; a residual's norm at the end.
CHAIN, MOST, LEFT, RESIDUAL = 6, 12, 4, 1e-4


@dataclass
class LinearOp:
    nodes: DataFrame  # id and the scalings' columns
    edges: DataFrame  # src, dst and the terms' columns
    shift: float
    sparse: list[tuple[float, str, str, str]]  # factor, edge column, left and right scaling
    rank_one: list[tuple[float, str, str]]  # factor, left and right column
    bound: float  # all eigenvalues are at most this
    symmetric: bool = True

    def scalings(self) -> list[str]:
        return [c for c in self.nodes.columns if c != "id"]

    def apply(self, x: DataFrame, m: int) -> DataFrame:
        """(id, x0..) to (id, x0..): the product with m vectors."""
        xs = self.nodes.join(x, "id")
        dots = xs.agg(*[F.sum(F.col(r) * F.col(f"x{j}")).alias(f"q{k}_{j}") for k, (_, _, r) in enumerate(self.rank_one) for j in range(m)]) if self.rank_one else None
        sums = [F.sum(F.col(e) * F.col(r) * F.col(f"x{j}")).alias(f"s{k}_{j}") for k, (_, e, _, r) in enumerate(self.sparse) for j in range(m)]
        # edges and vectors lie in the same buckets: a product moves the vectors' sums by node alone
        got = self.edges.join(xs, self.edges.dst == xs.id).groupBy(F.col("src").alias("id")).agg(*sums)
        y = xs.join(got, "id", "left")
        if dots is not None:
            y = y.crossJoin(F.broadcast(dots))  # one row
        out = []
        for j in range(m):
            v = F.lit(self.shift) * F.col(f"x{j}")
            for k, (f, _, left, _) in enumerate(self.sparse):
                v = v + F.lit(f) * F.col(left) * F.coalesce(F.col(f"s{k}_{j}"), F.lit(0.0))
            for k, (f, left, _) in enumerate(self.rank_one):
                v = v + F.lit(f) * F.col(left) * F.col(f"q{k}_{j}")
            out.append(v.alias(f"x{j}"))
        return y.select("id", *out)

    def dense(self) -> tuple[list[int], np.ndarray]:
        nodes = self.nodes.orderBy("id").toPandas()
        at = {i: k for k, i in enumerate(nodes.id)}
        a = self.shift * np.eye(len(nodes))
        e = self.edges.toPandas()
        i, j = e.src.map(at).to_numpy(), e.dst.map(at).to_numpy()
        for f, col, left, right in self.sparse:
            np.add.at(a, (i, j), f * nodes[left].to_numpy()[i] * e[col].to_numpy(float) * nodes[right].to_numpy()[j])
        for f, left, right in self.rank_one:
            a += f * np.outer(nodes[left], nodes[right])
        return list(map(int, nodes.id)), a


def scaled(edges: DataFrame, norm: str, null: str = "ng") -> tuple[DataFrame, DataFrame]:
    """The tables of all operators of one norm (sym or rw), written once: nodes with their scalings, in buckets of id; edges with the
    positive part of W - P, in buckets of dst. Zero degrees scale to zero."""
    n = node_table(edges, null)
    inv = lambda c: F.coalesce(1 / F.nullif(F.col(c), F.lit(0.0)), F.lit(0.0))
    root = lambda c: F.sqrt(F.greatest(inv(c), F.lit(0.0)))
    rw = norm == "rw"
    one = F.lit(1.0)
    pl = F.col("d") / F.col("tot") if null == "ng" else null_weight("er", one, one, F.col("tot"), F.col("n"))
    pr = F.col("d") if null == "ng" else one
    cols = {"l": inv("d") if rw else root("d"), "r": one if rw else root("d"), "lp": inv("dp") if rw else root("dp"), "rp": one if rw else root("dp"), "ln": inv("dn") if rw else root("dn"), "rn": one if rw else root("dn")}
    nodes = n.select("id", "d", "dp", "dn", *[v.alias(k) for k, v in cols.items()], pl.alias("pl"), pr.alias("pr"))
    nodes = nodes.select("*", (F.col("l") * F.col("pl")).alias("lpl"), (F.col("r") * F.col("pr")).alias("rpr"), (F.col("ln") * F.col("pl")).alias("lnpl"), (F.col("rn") * F.col("pr")).alias("rnpr"))
    e = edges.join(n.select(F.col("id").alias("src"), F.col("d").alias("di"), "tot", "n"), "src").join(n.select(F.col("id").alias("dst"), F.col("d").alias("dj")), "dst")
    p = null_weight(null, F.col("di"), F.col("dj"), F.col("tot"), F.col("n"))
    e = e.select("src", "dst", F.col("w").cast("double").alias("w"), F.greatest(F.col("w") - p, F.lit(0.0)).alias("bp")).withColumn("wb", F.col("bp") - F.col("w"))
    return materialise_by(nodes, "id"), materialise_by(e, "dst")


def operator(edges: DataFrame, kind: str, null: str = "ng", tables: tuple[DataFrame, DataFrame] | None = None) -> LinearOp:
    """laplacian_sym, lmix_sym or lb_sym (and their _rw forms) of a graph. tables: what `scaled` gives, where it is at hand."""
    base, norm = kind.rsplit("_", 1)
    nodes, e = scaled(edges, norm, null) if tables is None else tables
    symmetric = norm == "sym"
    if base == "laplacian":
        return LinearOp(nodes, e, 1.0, [(-1.0, "w", "l", "r")], [], 2.0, symmetric)
    if base == "lmix":
        return LinearOp(nodes, e, 2.0, [(-1.0, "w", "l", "r")], [(1.0, "lpl", "rpr")], 4.0, symmetric)
    return LinearOp(nodes, e, 2.0, [(-1.0, "bp", "lp", "rp"), (1.0, "wb", "ln", "rn")], [(1.0, "lnpl", "rnpr")], 4.0, symmetric)


def ordered_eig(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a real matrix by real part and unit vectors in real columns: a complex pair (real part equal, the one of
    negative imaginary part first) has the real and the imaginary part of its vector as its two columns. Real values come as real numbers."""
    lam, v = np.linalg.eig(a)
    order = np.lexsort((lam.imag, np.round(lam.real, 12)))
    lam, v = lam[order], v[:, order]
    cols = np.where(lam.imag > 0, v.imag, v.real)
    cols = cols / np.maximum(np.linalg.norm(cols, axis=0), 1e-300)
    return (lam.real if np.abs(lam.imag).max(initial=0) <= 1e-9 * max(1.0, np.abs(lam).max(initial=0)) else lam), cols


def smallest(op: LinearOp, m: int, dense: int = DENSE, rounds: int = 200, degree: int = 8, seed: int = 7) -> tuple[np.ndarray, DataFrame]:
    """The m eigenvalues of smallest real part, ascending, and (id, v array). Complex pairs of an operator that is not symmetric are
    reported as complex values, with vectors as in `ordered_eig`; a pair that m would part is cut.

    Graphs of up to `dense` nodes are solved on the driver. Larger symmetric ones by `krylov`, the rest by subspace iteration: a Chebyshev filter of products, an
    orthonormal basis by tall QR, and the eigenvalues of the small projected matrix; without symmetry the basis turns to that matrix's Schur
    vectors in order, so its leading columns stay an invariant subspace. Rounds go on until the values stand still; after `rounds`
    of them without that, an error tells so. The driver holds matrices of some m x m numbers."""
    n = op.nodes.count()
    spark = op.nodes.sparkSession
    if n <= dense:
        ids, a = op.dense()
        lam, v = np.linalg.eigh((a + a.T) / 2) if op.symmetric else ordered_eig(a)
        lam, v = lam[:m], v[:, :m]
        return lam, spark.createDataFrame([(i, list(map(float, r))) for i, r in zip(ids, v, strict=True)], "id long, v array<double>")
    size = min(n, m + max(4, m // 2))
    blocks = Blocks(op)
    if op.symmetric and n >= 4 * (MOST + CHAIN + 1) * m and (found := krylov(blocks, op, m, rounds, seed)):
        blocks.close()
        return found
    x = blocks.start(_drawn(op, size, seed))
    turns: list[np.ndarray] = []
    upper, cut, lam = op.bound, op.bound * 0.6, np.full(m, np.inf)
    for _ in range(rounds):
        # a Chebyshev polynomial keeps [cut, upper] small and lets what lies below grow
        after = blocks.filtered(x, size, turns, degree, cut, upper)
        discard(x)
        x, turns = after, []
        for _ in range(2):  # an orthonormal basis of the same space; the second time takes what the first one's rounding leaves
            _, s, vt = np.linalg.svd(tall_r(x.select("x"), size, rows=partial(_block_rows, m=size, turns=turns)))
            turns = [*turns, vt.T / np.maximum(s, s[0] * 1e-15)]
        g = blocks.gram(x, size, turns)
        theta, vectors = np.linalg.eigh((g + g.T) / 2) if op.symmetric else ordered_eig(g)
        done = np.allclose(theta[:m], lam, rtol=1e-6, atol=1e-7)
        lam, cut = theta[:m], min(float(theta[-1].real) + 1e-3, 0.95 * upper)
        turns = [*turns, vectors if op.symmetric or done else np.linalg.qr(vectors)[0]]
        if done:
            break
    else:
        raise ArithmeticError(f"the eigenvalues have not settled within {rounds} rounds")
    out = materialise(unpacked(x, size, turns, m))
    discard(x)
    blocks.close()
    return lam, out


def _drawn(op: LinearOp, size: int, seed: int) -> DataFrame:
    return op.nodes.select("id", F.array(*[key(F.concat_ws("-", "id", F.lit(j)), seed) / 2.0**32 - 0.5 for j in range(size)]).alias("v"))


def krylov(blocks: Blocks, op: LinearOp, m: int, rounds: int = 200, seed: int = 7) -> tuple[np.ndarray, DataFrame] | None:
    """`smallest` of a symmetric operator by block Lanczos steps of m vectors, so a value as often as m times is found as often; None
    where the Krylov space ends before the residuals are small.

    A chain makes the Chebyshev polynomials 1 to CHAIN of the last m vectors of an orthonormal basis. What the operator does to all but the
    newest of them follows from the recurrence and the QR factor: the projected matrix and the residuals need no product. A basis that
    gets too large is cut to its best vectors and the last m, which hold all their residuals."""
    c = h = op.bound / 2  # the operator as (A - c) / h lies in [-1, 1]
    drawn = blocks.start(_drawn(op, m, seed))
    z, width, known = drawn.select("part", "ids", "x", F.lit(b"").alias("more")), m, np.zeros((m, 0))  # known: what comes of the basis without its last m
    basis, new, lam = None, None, np.full(m, np.inf)
    for t in range(rounds + 1):
        size = width + (CHAIN * m if t else 0)
        turns: list[np.ndarray] = []
        r = np.eye(size)
        for _ in range(2):
            one = tall_r(z.select("ids", "x", "more"), size, rows=partial(_wide_rows, m=width, last=m, turns=turns))
            if not np.isfinite(one).all() or np.abs(np.diag(one)).min() <= 1e-9 * np.abs(np.diag(one)).max():
                discard(*[t for t in (drawn, basis, new) if t is not None])
                return None
            turns, r = [*turns, np.linalg.inv(one)], one @ r
            if np.linalg.cond(one) <= 1e4:  # else the second time takes what the first one's rounding leaves
                break
        if t:
            head = size - m
            step = np.zeros((size, head))
            step[:width, : width - m] = known
            for i in range(CHAIN):  # the first polynomial is the operator itself
                at = slice(width - m + i * m, width + i * m)
                step[width + i * m : width + (i + 1) * m, at] += (0.5 if i else 1.0) * np.eye(m)
                if i:
                    step[width + (i - 2) * m : width + (i - 1) * m, at] += 0.5 * np.eye(m)
            known = r @ step @ np.linalg.inv(r[:head, :head])
            theta, vectors = np.linalg.eigh((known[:head] + known[:head].T) / 2)
            far = h * np.linalg.norm(known[head:] @ vectors, axis=0)
            still, lam = np.allclose(c + h * theta[:m], lam, rtol=1e-6, atol=1e-7), c + h * theta[:m]
            if still and (far[:m] <= RESIDUAL).all():
                best = turned_parts(z, width, m, [*turns, np.eye(size)[:, :head] @ vectors[:, :m]])
                out = materialise(unpacked(best, m, [], m))
                discard(basis, new)
                return lam, out
            if size > MOST * m:
                keep = vectors[:, : LEFT * m]
                turns = [*turns, np.block([[keep, np.zeros((head, m))], [np.zeros((m, LEFT * m)), np.eye(m)]])]
                known = np.concatenate([np.diag(theta[: LEFT * m]), known[head:] @ keep])
        after = blocks.kept(turned_parts(z, width, m, turns))
        discard(*[t for t in (drawn, basis, new) if t is not None])
        drawn, basis, width = None, after, turns[-1].shape[1]
        new = blocks.terms(basis, width, m, CHAIN, c - h, c + h)
        z = basis.select("part", "ids", "x").join(new.select("part", F.col("x").alias("more")), "part")
    raise ArithmeticError(f"the eigenvalues have not settled within {rounds} rounds")


def _wide_rows(pdf: pd.DataFrame, m: int, last: int, turns: list[np.ndarray]) -> list[np.ndarray]:
    return [turned(beside(ids, x, m, more, last), turns) for ids, x, more in zip(pdf.ids, pdf.x, pdf.more, strict=True)]


def _block_rows(pdf: pd.DataFrame, m: int, turns: list[np.ndarray]) -> list[np.ndarray]:
    return [turned(np.frombuffer(b).reshape(-1, m), turns) for b in pdf.x]


def _array(x: DataFrame, m: int, name: str) -> DataFrame:
    return x.select("id", F.array(*[F.col(f"x{j}") for j in range(m)]).alias(name))


def _rotate(x: DataFrame, w: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf.id, "v": list(np.stack(list(pdf.v)) @ w)})

    got = _array(x, w.shape[0], "v").mapInPandas(run, "id long, v array<double>")
    return got.select("id", *[F.col("v")[j].alias(f"x{j}") for j in range(w.shape[1])])


def tall_r(x: DataFrame, m: int, column: str = "v", branches: int = 64, rows: Callable[[pd.DataFrame], list[np.ndarray]] | None = None) -> np.ndarray:
    """R of the QR factors of the rows of a column of arrays (or of what `rows` makes of a batch), by a tree: each partition factors its rows batch by batch, each of
    `branches` groups the factors of its partitions, the driver theirs. Never a Gram matrix, which would square the condition number."""

    def stacked(parts: list[np.ndarray]) -> np.ndarray:
        r = np.linalg.qr(np.concatenate(parts), mode="r")
        return np.concatenate([r, np.zeros((m - len(r), m))]) if len(r) < m else r

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for pdf in batches:
            if len(pdf):
                new = rows(pdf) if rows else [np.stack(list(pdf[column]))]
                r = stacked(new if r is None else [r, *new])
        if r is not None:
            yield pd.DataFrame({"r": [r.ravel()]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [stacked([np.reshape(r, (m, m)) for r in pdf.r]).ravel()]})

    ship(x.sparkSession)
    factors = (x if rows else x.select(column)).mapInPandas(own, "r array<double>").withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(branches)))
    return stacked([np.zeros((m, m)), *[np.reshape(r["r"], (m, m)) for r in factors.groupBy("branch").applyInPandas(joined, "r array<double>").collect()]])


def _orthonormal(x: DataFrame, m: int) -> DataFrame:
    """The same space with orthonormal columns, written. The second pass takes what the first one's rounding leaves."""
    made: list[DataFrame] = []
    for _ in range(2):
        _, s, vt = np.linalg.svd(tall_r(_array(x, m, "v"), m))
        x = materialise_by(_rotate(x, vt.T / np.maximum(s, s[0] * 1e-15)), "id")
        made.append(x)
    discard(made[0])
    return x


def embedding(edges: DataFrame, kind: str, m: int, null: str = "ng", dense: int = DENSE) -> tuple[np.ndarray, DataFrame]:
    """Eigenpairs of an operator. The rw forms of laplacian and lmix share the sym form's values, with vectors scaled by the root of
    the degree; lb_rw has two degree matrices, shares nothing with lb_sym and is solved as it is, without symmetry."""
    base, norm = kind.rsplit("_", 1)
    if norm == "sym" or base == "lb":
        return smallest(operator(edges, kind, null), m, dense)
    op = operator(edges, f"{base}_sym", null)
    lam, v = smallest(op, m, dense)
    scaled = v.join(op.nodes.select("id", "l"), "id").select("id", F.transform("v", lambda x: x * F.col("l")).alias("v"))
    return lam, scaled


def power_step(edges: DataFrame, x: DataFrame) -> DataFrame:
    """(id, x) to (id, x): one unnormalised product with I + D^-1 W."""
    d = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").cast("double").alias("d"))
    got = edges.join(x, edges.dst == x.id).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    return x.join(got, "id").join(d, "id").select("id", (F.col("x") + F.col("s") / F.col("d")).alias("x"))


def gram_of(v: DataFrame) -> np.ndarray:
    """V'V of (id, v), by partial sums in each partition."""
    ship(v.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(list(pdf.v))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"g": [total.ravel()]})

    parts = [np.array(r["g"]) for r in v.select("v").mapInPandas(run, "g array<double>").collect()]  # m * m numbers for each partition
    g = sum(parts)
    return g.reshape(int(len(g) ** 0.5), -1)
