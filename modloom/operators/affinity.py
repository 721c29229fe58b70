"""Affinities of points: exact nearest neighbours and kernels. points: (id, features).

Defined results: points without features, or with a null or NaN among them, take no part; equal points are neighbours at distance 0;
ties go to the smaller id; an empty table gives no rows; further columns are ignored.

All pairs are met tile by tile: points are packed into blocks of bytes, a tile is so many blocks against so many others, at most LEFT
points against RIGHT, and is one partition. A product in single precision rules pairs out: it is widened by all that rounding can do, so
no pair within a row's bound is lost; those it leaves are measured in double precision. Only the best of each row leave a tile. So the n**2
work is done in matrix products, is dealt evenly, is bounded in memory and never becomes n**2 rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import key
from ..plans.tables import materialise
from ..shipping import ship

#: Points of a block; of the two sides of a tile at most; tiles that a small table is cut into at least.
BLOCK, LEFT, RIGHT, LEAST = 512, 16_384, 65_536, 24
#: Pairs that are measured at once.
PAIRS = 32_768


def usable(points: DataFrame) -> DataFrame:
    return points.filter(F.coalesce(F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size("features") > 0), F.lit(False)))


def _packed(points: DataFrame, extra: list[str], n: int) -> DataFrame:
    """(block, ids, x, tau): n blocks of points, their numbers as bytes."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"block": pdf.block.iloc[:1], "ids": pdf.id.to_numpy(np.int64).tobytes(), "x": np.stack(list(pdf.features)).astype(float).tobytes()}
        return pd.DataFrame(row | {"tau": pdf.tau.to_numpy(float).tobytes() if extra else b""})

    cut = points.select(F.pmod(key("id", 11), F.lit(n)).cast("int").alias("block"), "id", "features", *extra)
    return cut.groupBy("block").applyInPandas(pack, "block int, ids binary, x binary, tau binary")


@dataclass
class Side:
    """The points of one side of a tile."""

    ids: np.ndarray
    x: np.ndarray
    tau: np.ndarray | None

    @staticmethod
    def of(blocks: pd.DataFrame) -> "Side":
        ids = np.frombuffer(b"".join(blocks.ids), np.int64)
        return Side(ids, np.frombuffer(b"".join(blocks.x)).reshape(len(ids), -1), np.frombuffer(b"".join(blocks.tau)) if len(blocks.tau.iloc[0]) else None)


def _measured(a: Side, b: Side, rows: np.ndarray, cols: np.ndarray, self_too: bool) -> tuple[np.ndarray, ...]:
    """rows, cols, d2 and v of the pairs that are at a finite distance."""
    d2 = np.empty(len(rows))
    for i in range(0, len(rows), PAIRS):  # differences, not dot products: equal points get exactly 0
        d2[i : i + PAIRS] = ((b.x[cols[i : i + PAIRS]] - a.x[rows[i : i + PAIRS]]) ** 2).sum(1)
    v = d2
    if a.tau is not None:
        scale = np.sqrt(a.tau[rows] * b.tau[cols])
        v = np.divide(d2, scale, out=np.where(d2 > 0, np.inf, 0.0), where=scale > 0)
    ok = np.isfinite(v)
    if not self_too:
        ok &= a.ids[rows] != b.ids[cols]
    return rows[ok], cols[ok], d2[ok], v[ok]


def _factors(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, float]:
    """Matrices A and B in single precision and a factor f: -2 (A B')[i, j] is at most f * v of the pair, whatever is rounded. Rows that
    single precision cannot hold are NaN."""
    whole = b.x[np.isfinite(b.x).all(1)]
    centre = whole.mean(0) if len(whole) else 0.0
    centre = np.where(np.isfinite(centre), centre, 0.0)
    moved = [s.x - centre for s in (a, b)]
    norms = [(x**2).sum(1) for x in moved]
    top = max((n[np.isfinite(n)].max(initial=0.0) for n in norms), default=0.0)
    unit = np.ldexp(1.0, -int(np.frexp(np.sqrt(top))[1])) if top > 0 else 1.0  # a power of two: exact
    slack = 1 - 2 * (a.x.shape[1] + 16) * 2.0**-24
    least = min((t[t > 0].min(initial=1.0) for t in (a.tau, b.tau) if t is not None), default=1.0)
    out = []
    for i, (s, x, n) in enumerate(zip((a, b), moved, norms, strict=True)):
        half, one = -0.5 * slack * n * unit * unit, np.ones(len(n))
        m = np.column_stack([x * unit, *((half, one) if i == 0 else (one, half))])
        if s.tau is not None:  # where tau is 0 only equal points count: any large factor keeps others out
            m *= np.where(s.tau > 0, 1 / np.sqrt(np.where(s.tau > 0, s.tau, 1.0)), 1e3 / np.sqrt(least))[:, None]
        m = m.astype(np.float32)
        m[~np.isfinite(m).all(1)] = np.nan
        out.append(m)
    return out[0], out[1], unit * unit


def _pruned(found: list[tuple[np.ndarray, ...]], a: Side, b: Side, k: int, ties: bool) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The k best of each row of what is found (ties: and all that equal the k-th), and each row's bound: no pair beyond it can be among them."""
    rows, cols, d2, v = (np.concatenate(x) for x in zip(*found, strict=True))
    near = np.round(v, 9)
    order = np.lexsort((b.ids[cols], near, rows))
    rows, cols, d2, v, near = rows[order], cols[order], d2[order], v[order], near[order]
    first = np.searchsorted(rows, np.arange(len(a.ids)))
    rank = np.arange(len(rows)) - first[rows]
    last = np.full(len(a.ids), np.inf)
    last[rows[rank == k - 1]] = near[rank == k - 1]
    keep = near <= last[rows] if ties else rank < k
    bound = last + 1e-9 + 1e-9 * np.abs(last)
    if a.tau is not None:
        bound[a.tau == 0] = 0.0
    return (rows[keep], cols[keep], d2[keep], v[keep]), bound


def _best_of_tile(a: Side, b: Side, k: int, self_too: bool, ties: bool) -> pd.DataFrame:
    with np.errstate(all="ignore"):
        fa, fb, f = _factors(a, b)
        fb = np.ascontiguousarray(fb.T)
        bound = np.full(len(a.ids), np.inf) if a.tau is None else np.where(a.tau > 0, np.inf, 0.0)
        kept: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        at, step = 0, 512
        while at < len(b.ids):
            stop, found, count = min(at + step, len(b.ids)), [kept], 0
            for r in range(0, len(a.ids), 512):
                close = fa[r : r + 512] @ fb[:, at:stop]  # -v / 2, or more
                limit = bound[r : r + 512]
                if stop - at > k + 1 and (new := np.flatnonzero(np.isinf(limit))).size:  # a first bound: k + 1 that look best
                    top = np.argpartition(close[new], -(k + 1), axis=1)[:, -(k + 1) :]
                    rows, _, _, v = _measured(a, b, np.repeat(new + r, k + 1), top.ravel() + at, self_too)
                    near = np.full((len(new), k + 1), np.inf)
                    i = np.searchsorted(new + r, rows)
                    near[i, np.arange(len(i)) - np.searchsorted(i, np.arange(len(new)))[i]] = v
                    kth = np.sort(near, axis=1)[:, k - 1]
                    limit[new] = kth + 1e-9 + 1e-9 * np.abs(kth)
                rows, cols = np.divmod(np.flatnonzero(~(close < (-0.5 * (1 + 1e-6) * f * limit - 1e-37).astype(np.float32)[:, None])), stop - at)
                found.append(_measured(a, b, rows + r, cols + at, self_too))
                count += len(found[-1][0])
                if count > 4_000_000:  # very many equal distances
                    kept, bound = _pruned(found, a, b, k, ties)
                    found, count = [kept], 0
            kept, bound = _pruned(found, a, b, k, ties)
            at, step = stop, min(2 * step, 4096)
    rows, cols, d2, v = kept
    return pd.DataFrame({"src": a.ids[rows], "dst": b.ids[cols], "d2": d2, "v": v})


def best_pairs(points: DataFrame, k: int, scaled: bool = False, self_too: bool = False, ties: bool = False) -> DataFrame:
    """(src, dst, d2, v): for every point the k best others. v is the squared distance or, scaled by the column tau,
    d2 / sqrt(tau_src * tau_dst); least first, ties to the smaller id. ties: all that equal the k-th stay too. Where a tau
    is 0, v is 0 for equal points and others are infinitely far (left out)."""
    ship(points.sparkSession)
    points = usable(points)
    count = points.count()
    n = -(-count // BLOCK) or 1
    left, right = min(n, max(LEAST, -(-count // LEFT))), -(-count // RIGHT) or 1
    blocks = _packed(points, ["tau"] if scaled else [], n)
    g, h = F.col("block") % left, F.col("block") % right
    ahead = F.transform(F.sequence(F.lit(0), F.lit(right - 1)), lambda j: F.struct((g * right + j).alias("tile"), F.lit(True).alias("left")))
    back = F.transform(F.sequence(F.lit(0), F.lit(left - 1)), lambda i: F.struct((i * right + h).alias("tile"), F.lit(False).alias("left")))
    dealt = blocks.select(F.explode(F.concat(ahead, back)).alias("t"), "ids", "x", "tau").select("t.tile", "t.left", "ids", "x", "tau")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in batches if len(pdf)]
        if parts:  # one tile
            both = pd.concat(parts)
            a, b = both[both.left], both[~both.left]
            if len(a) and len(b):
                yield _best_of_tile(Side.of(a), Side.of(b), k, self_too, ties)

    best = dealt.repartitionById(left * right, "tile").mapInPandas(run, "src long, dst long, d2 double, v double")
    w = Window.partitionBy("src").orderBy(F.round("v", 9), *([] if ties else ["dst"]))
    return best.withColumn("rank", (F.rank() if ties else F.row_number()).over(w)).filter(F.col("rank") <= k)


def knn(points: DataFrame, k: int = 10) -> DataFrame:
    """(src, dst, d2, rank)."""
    return best_pairs(points, k).select("src", "dst", "d2", "rank")


def gaussian_weights(points: DataFrame, k: int = 10) -> DataFrame:
    """(src, dst, w): exp(-4 d2 / d2 of the k-th neighbour)."""
    e = knn(points, k).withColumn("dk", F.max("d2").over(Window.partitionBy("src")))  # the neighbours are found once
    return e.select("src", "dst", F.exp(-4 * F.col("d2") / F.nullif("dk", F.lit(0.0))).alias("w"))


def _both_ways(directed: DataFrame) -> DataFrame:
    """Every entry and its mirror image; the table is read once."""
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return directed.select(F.explode(ends).alias("e"), "w").select("e.src", "e.dst", "w")


def averaged(directed: DataFrame) -> DataFrame:
    """(W + W') / 2."""
    return _both_ways(directed).groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))


def self_tuned(points: DataFrame, k: int = 10) -> DataFrame:
    """exp(-d2 / sqrt(tau_i tau_j)), tau the squared distance of the k-th neighbour; the k + 1 largest of each row (itself
    among them) and all that equal the least of these stay, the greater of both directions counts."""
    tau = knn(points, k).groupBy("src").agg(F.max("d2").alias("tau"))
    p = materialise(points.join(tau, points.id == tau.src).select("id", "features", "tau"))  # counted, then met
    best = best_pairs(p, k + 1, scaled=True, self_too=True, ties=True).select("src", "dst", F.exp(-F.col("v")).alias("w"))
    return _both_ways(best).groupBy("src", "dst").agg(F.max("w").alias("w"))


def neighbour_rbf(points: DataFrame, k: int = 10, gamma: float = 0.5) -> DataFrame:
    """exp(-gamma (D + D') / 2) over squared distances of the k nearest, a point itself among them; entries of 1 go."""
    e = knn(points, k - 1).select("src", "dst", F.col("d2").alias("w"))
    return averaged(e).select("src", "dst", F.exp(-gamma * F.col("w")).alias("w")).filter("w < 1")


def mean_normalised(affinity: DataFrame, n: Column | int | None = None) -> DataFrame:
    """Entries of exactly 1 dropped, divided by the mean degree."""
    a = materialise(affinity.filter("w <> 1"))  # read twice
    mean = a.groupBy("src").agg(F.sum("w").alias("d")).agg(F.avg("d").alias("m"))
    return a.crossJoin(F.broadcast(mean)).select("src", "dst", (F.col("w") / F.col("m")).alias("w"))  # one row


def landmarks(points: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """The k points of least key, with their rank."""
    some = points.withColumn("key", key("id", seed)).orderBy("key", "id").limit(k)
    return some.withColumn("rank", F.row_number().over(Window.orderBy("key", "id"))).drop("key")


def rbf_block(points: DataFrame, k: int, tau: float, divide: bool = False, seed: int = 7) -> DataFrame:
    """(id, landmark rank, value): the kernel against k landmarks (a fixed number, broadcast). divide: exp(-d2 / tau) in single precision."""
    marks = [(r["rank"], r["features"]) for r in landmarks(points, k, seed).collect()]  # k rows
    out = F.array(*[F.struct(F.lit(rank).alias("rank"), _d2(F.col("features"), x).alias("d2")) for rank, x in marks])
    e = points.select("id", F.explode(out).alias("m")).select("id", "m.rank", "m.d2")
    return e.select("id", "rank", F.exp(-F.col("d2") / tau).cast("float").cast("double").alias("value") if divide else F.exp(-tau * F.col("d2")).alias("value"))


def _d2(v: Column, x: list[float]) -> Column:
    return F.aggregate(F.zip_with(v, F.array(*[F.lit(float(c)) for c in x]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t)


Moments = tuple[float, np.ndarray, np.ndarray]


def _merged(a: Moments | None, b: Moments) -> Moments:
    """Count, mean and sums of products about the mean of two sets together (Chan's update): no cancellation however far the mean is from 0."""
    if a is None:
        return b
    (na, ma, sa), (nb, mb, sb) = a, b
    n, gap = na + nb, mb - ma
    return n, ma + gap * (nb / n), sa + sb + np.outer(gap, gap) * (na * nb / n)


def block_moments(points: DataFrame, branches: int = 64) -> Moments | None:
    """The moments of all features in one pass: blocks of rows within each partition, then a tree; `branches` sets of d * d numbers reach
    the driver."""
    ship(points.sparkSession)

    def packed(m: Moments) -> pd.DataFrame:
        return pd.DataFrame({"n": [m[0]], "mean": [m[1]], "s": [m[2].ravel()]})

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(list(pdf.features))
                mean = x.mean(0)
                total = _merged(total, (float(len(x)), mean, (x - mean).T @ (x - mean)))
        if total is not None:
            yield packed(total)

    def unpacked(rows: list[tuple]) -> Moments | None:
        total = None
        for n, mean, s in rows:
            total = _merged(total, (n, np.array(mean), np.reshape(s, (len(mean), len(mean)))))
        return total

    schema = "n double, mean array<double>, s array<double>"
    parts = usable(points).select("features").mapInPandas(own, schema).withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(branches)))
    joined = parts.groupBy("branch").applyInPandas(lambda pdf: packed(unpacked(list(zip(pdf.n, pdf["mean"], pdf.s, strict=True)))), schema)
    return unpacked([tuple(r) for r in joined.collect()])


def moments(points: DataFrame) -> DataFrame:
    """(i, j, covariance, gram) of the features, i <= j."""
    m = block_moments(points)
    rows = []
    if m is not None:
        n, mean, s = m
        gram = s + n * np.outer(mean, mean)
        rows = [(i, j, float(s[i, j] / (n - 1)) if n > 1 else None, float(gram[i, j])) for i in range(len(mean)) for j in range(i, len(mean))]
    return points.sparkSession.createDataFrame(rows, "i int, j int, covariance double, gram double")


def pca(points: DataFrame, k: int) -> DataFrame:
    """(id, projected): centred, onto the k leading eigenvectors of the covariance (signs: largest component positive)."""
    ship(points.sparkSession)
    points = usable(points)
    found = block_moments(points)
    if found is None:
        return points.select("id", F.array().cast("array<double>").alias("projected")).limit(0)
    n, centre, s = found
    _, v = np.linalg.eigh(s / max(n - 1, 1))
    v = v[:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(k)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf.id, "projected": list((np.stack(list(pdf.features)) - centre) @ v)})

    return points.select("id", "features").mapInPandas(run, "id long, projected array<double>")
