"""Approximate nearest neighbours of points, without meeting all pairs: buckets of random projections, then neighbours of neighbours.

Buckets. Each of `tables` sorts the points by a code (on which side of random planes through the mean a point lies) and then along one
more random direction, and cuts the order into buckets of `bucket` points. A hot code is cut like any other, so every bucket is
bounded, whatever the data. A bucket's pairs are met in numpy; each point keeps its `pool` nearest.

Descent. In a round every point gathers its pool and the points nearest to it of those that have it in theirs, `pool` at most of
each; all pairs of this list of which one is new in a pool are met, and pairs nearer than what the pools hold go into them. Rounds go on until
fewer than `settled` of the entries are new. The work is n * pool^2 distances a round, in n lists of bounded size.

Result: (src, dst, d2, rank), k nearest of the pool, ties to the smaller id. Defined results: points without features, or with a null or
NaN among them, take no part; of equal ids one point does; equal points are neighbours at distance 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import discard, materialise
from ..shipping import ship
from .affinity import usable

#: Points of a bucket, tables; entries of a pool for each neighbour that is asked for; share of new entries at which rounds end.
BUCKET, TABLES, POOL, SETTLED = 256, 4, 4, 0.002
PAIRS = "src long, dst long, d2 double"
#: Parts that the lists of a round are dealt to at least; points that a part may hold; pairs that are merged at once.
PARTS, VECTORS, MOST = 24, 1_000_000, 2_000_000


def plane(table: int, bit: int, dims: int, seed: int) -> np.ndarray:
    """A direction: keyed numbers between -1/2 and 1/2, the same everywhere."""
    from hashlib import md5

    return np.array([int(md5(f"{table}-{bit}-{j}:{seed}".encode()).hexdigest()[:8], 16) / 2.0**32 - 0.5 for j in range(dims)])


def projections(points: DataFrame, tables: int = TABLES, bucket: int = BUCKET, seed: int = 7) -> DataFrame:
    """(id, features, table, code, along): the sides of ceil(log2(n / bucket)) planes as a number, and the place along one more direction."""
    ship(points.sparkSession)
    n, dims = points.agg(F.count("id"), F.max(F.size("features"))).first()
    if not n:
        return points.sparkSession.createDataFrame([], "id long, features array<double>, table int, code long, along double")
    means = [r["m"] for r in points.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()]  # a number for each dimension
    bits = max(1, math.ceil(math.log2(max(n / bucket, 1))))
    centre = np.array(means)
    sides = np.stack([plane(t, b, dims, seed) for t in range(tables) for b in range(bits + 1)], 1)
    power = 1 << np.arange(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at = ((np.stack(list(pdf.features)) - centre) @ sides).reshape(len(pdf), tables, bits + 1)
                code, along = (at[:, :, :bits] > 0) @ power, at[:, :, bits]
                for t in range(tables):
                    yield pd.DataFrame({"id": pdf.id, "features": pdf.features, "table": np.full(len(pdf), t, np.int32), "code": code[:, t].astype(np.int64), "along": along[:, t]})

    return points.select("id", "features").mapInPandas(run, "id long, features array<double>, table int, code long, along double")


def _nearest(ids: np.ndarray, d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least of each row, ties to the smaller id."""
    k = min(k, d2.shape[1])
    order = np.lexsort((np.broadcast_to(ids, d2.shape), np.round(d2, 9)), axis=1)[:, :k]
    rows, cols = np.repeat(np.arange(len(d2)), k), order.ravel()
    ok = np.isfinite(d2[rows, cols])
    return rows[ok], cols[ok]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([((y - a) ** 2).sum(1) for a in x])  # differences: equal points get exactly 0


def _bucket_pairs(points: DataFrame, pool: int, tables: int, bucket: int, seed: int) -> DataFrame:
    """(src, dst, d2): the pool nearest of each point in each of its buckets."""
    placed = projections(points, tables, bucket, seed)
    order = ["table", "code", "along", "id"]
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialise(placed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    # a bucket lies in one part of the order: (part, table, place in the part by bucket)
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    cut = ordered.select("id", "features", part.alias("part"), F.floor(place / bucket).alias("piece"), "table")
    rows = cut.groupBy("part", "piece", "table").agg(F.collect_list(F.struct("id", "features")).alias("rows")).select("rows")  # `bucket` at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some in pdf.rows:
                ids, x = np.array([r["id"] for r in some]), np.array([r["features"] for r in some])
                d2 = _distances(x, x)
                np.fill_diagonal(d2, np.inf)
                i, j = _nearest(ids, d2, pool)
                yield pd.DataFrame({"src": ids[i], "dst": ids[j], "d2": d2[i, j]})

    out = materialise(rows.mapInPandas(run, PAIRS).groupBy("src", "dst").agg(F.min("d2").alias("d2")))
    discard(ordered)
    return out


def _best(pairs: DataFrame, pool: int, of: str = "src") -> DataFrame:
    other = "dst" if of == "src" else "src"
    w = Window.partitionBy(of).orderBy(F.round("d2", 9), other)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= pool)


def _packed(points: DataFrame) -> DataFrame:
    """(id, dims, x), written: the numbers as bytes, in single precision where it holds all of them exactly."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(list(pdf.features)).astype(float)
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                yield pd.DataFrame({"id": pdf.id, "dims": x.shape[1], "x": [(b if (b == a).all() else a).tobytes() for a, b in zip(x, short, strict=True)]})

    return materialise(points.select("id", "features").mapInPandas(run, "id long, dims int, x binary"))


def _numbers(b: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(b, np.float32 if len(b) == 4 * dims else float).astype(float)


def _merged(found: list[tuple[np.ndarray, ...]], pool: int) -> pd.DataFrame:
    """Of several lists' pairs the pool nearest of each src, each pair once."""
    src, dst, d2 = (np.concatenate(a) for a in zip(*found, strict=True))
    order = np.lexsort((dst, np.round(d2, 9), src))
    src, dst, d2 = src[order], dst[order], d2[order]
    new = np.ones(len(src), bool)
    new[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    src, dst, d2 = src[new], dst[new], d2[new]
    keep = np.arange(len(src)) - np.searchsorted(src, src) < pool
    return pd.DataFrame({"src": src[keep], "dst": dst[keep], "d2": d2[keep]})


def _round(points: DataFrame, pools: DataFrame, pool: int) -> DataFrame:
    """(src, dst, d2) that are nearer than the last of a full pool of src: pairs of the points around each point, one of them fresh.

    Lists are dealt to parts, and a point's numbers go once to each part that has it in a list. A part is a task; it holds about VECTORS
    points at most and gives the best of some lists at a time."""
    ahead = pools.select(F.col("src").alias("around"), F.col("dst").alias("id"), "fresh")
    back = _best(pools, pool, "dst").select(F.col("dst").alias("around"), F.col("src").alias("id"), "fresh")
    lists = ahead.unionByName(back).repartition("around").groupBy("around", "id").agg(F.max("fresh").alias("fresh"))
    lists = materialise(lists.withColumn("any", F.max("fresh").over(Window.partitionBy("around"))).filter("any").drop("any"))  # others have no pair to meet
    (n, dims), rows = points.agg(F.count("id"), F.max("dims")).first(), lists.count()
    parts = PARTS if n <= VECTORS else max(PARTS, -(-rows // VECTORS))
    dealt = lists.select(F.pmod(F.xxhash64("around"), F.lit(parts)).cast("int").alias("part"), "around", "id", "fresh")
    last = pools.groupBy(F.col("src").alias("id")).agg(F.when(F.count("dst") >= pool, F.max("d2")).alias("last"))
    known = points.join(last, "id", "left").drop("dims")
    # a point goes to each part once, however many lists it stands in
    wanted = dealt.groupBy("id").agg(F.collect_set("part").alias("to")).join(known, "id").select(F.explode("to").alias("part"), "id", "last", "x")
    both = dealt.select("part", "around", "id", "fresh", F.lit(None).cast("double").alias("last"), F.lit(None).cast("binary").alias("x")).unionByName(wanted.select("part", F.lit(None).cast("long").alias("around"), "id", F.lit(False).alias("fresh"), "last", "x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries, vectors = [], []
        for pdf in batches:
            is_list = pdf.x.isna().to_numpy()
            a, b = pdf[is_list], pdf[~is_list]
            if len(a):
                entries.append((a.around.to_numpy(np.int64), a.id.to_numpy(np.int64), a.fresh.to_numpy(bool)))
            if len(b):
                vectors.append((b.id.to_numpy(np.int64), b["last"].to_numpy(float), b.x.to_numpy(object)))
        if not entries:
            return
        around, member, fresh = (np.concatenate(a) for a in zip(*entries, strict=True))
        ids, bound, x = (np.concatenate(a) for a in zip(*vectors, strict=True))
        order = np.argsort(ids)
        ids, bound, x = ids[order], np.where(np.isnan(bound[order]), np.inf, bound[order]), x[order]
        order = np.lexsort((member, around))
        at, fresh = np.searchsorted(ids, member[order]), fresh[order]
        found, count = [], 0
        for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(around[order])) + 1):
            i, near = at[some], fresh[some]
            d2 = _distances(v := np.stack([_numbers(b, dims) for b in x[i]]), v)
            np.fill_diagonal(d2, np.inf)
            d2[(d2 > bound[i][:, None]) | ~(near[:, None] | near[None, :])] = np.inf
            a, b = _nearest(ids[i], d2, pool)
            found.append((ids[i[a]], ids[i[b]], d2[a, b]))
            count += len(a)
            if count > MOST:
                yield _merged(found, pool)
                found, count = [], 0
        if found:
            yield _merged(found, pool)

    out = materialise(both.repartitionById(parts, "part").mapInPandas(run, PAIRS).groupBy("src", "dst").agg(F.min("d2").alias("d2")))
    discard(lists)
    return out


def approximate_knn(points: DataFrame, k: int = 10, pool: int | None = None, tables: int = TABLES, bucket: int = BUCKET, settled: float = SETTLED, seed: int = 7) -> DataFrame:
    """(src, dst, d2, rank): the result reads the last round's written pools."""
    pool = POOL * k if pool is None else max(pool, k)
    points = materialise(usable(points).select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features")).groupBy("id").agg(F.min("features").alias("features")))
    found, packed = _bucket_pairs(points, pool, tables, max(bucket, 2), seed), _packed(points)
    pools = materialise(_best(found, pool).select("src", "dst", "d2", F.lit(True).alias("fresh")))
    discard(found)
    while True:
        entries, new = pools.agg(F.count("src"), F.count_if("fresh")).first()
        if new <= settled * entries:
            break
        found = _round(packed, pools, pool)
        both = pools.select("src", "dst", "d2", F.lit(False).alias("fresh")).unionByName(found.withColumn("fresh", F.lit(True)))
        merged = both.groupBy("src", "dst").agg(F.min("d2").alias("d2"), F.min("fresh").alias("fresh"))
        after = materialise(_best(merged, pool).select("src", "dst", "d2", "fresh"))
        discard(pools, found)
        pools = after
    discard(points, packed)
    return _best(pools, k).select("src", "dst", "d2", "rank")
