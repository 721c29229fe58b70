"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Equal vectors are one node (with the smallest ids that a result can need); nodes are dealt to shards by a hash, so every shard
is a like sample of the whole. Shards hold SHARD nodes, or a SHARDS-th of all where that is more, up to LARGE, which bounds a
task's memory; so the work of searching grows with queries times shards only beyond SHARDS * LARGE nodes. In a shard, vectors
are centred and scaled (so squares of the largest and smallest numbers stay finite), distances come from differences in double
precision, and nodes enter in growing batches: a greedy beam search from the medoid proposes neighbours, robust pruning
(relaxed by ALPHA) keeps diverse edges, reverse edges are added and pruned alike. Queries go to every shard in blocks, and a
shard is read once for ASKED of them; a beam search finds each shard's best nodes, exact double-precision distances rank them,
and the best of all shards are merged.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor as
candidates; vectors meet only those of their own length; a null vec_id takes no part; repeated rows count once; equal
distances go to the smaller vec_id; with fewer than k candidates all are returned; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, held, materialise, ship

SHARD, SHARDS, LARGE = 4096, 64, 65_536
DEGREE, SLACK, BEAM, ALPHA = 32, 48, 64, 1.2
SEARCH_BEAM, WIDE, BLOCK, ASKED = 96, 4, 512, 8192


def shard_size(n: int) -> int:
    """Nodes of a shard of n nodes in all."""
    return min(max(SHARD, n // SHARDS), LARGE)


def _distances(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of every q[i] to x[ids[i]]: of differences, as what is far from the origin would cancel."""
    p = x[ids]
    p -= q[:, None, :]
    return np.einsum("bkd,bkd->bk", p, p)


def scaling(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and scale that put x into [-2, 2]."""
    top = np.abs(x).max()
    centre = (x / top).mean(0) * top
    return centre, float(max(np.abs(x / 2 - centre / 2).max() * 2, np.finfo(float).tiny))


def scaled(x: np.ndarray, centre: np.ndarray, scale: float) -> np.ndarray:
    """Queries may lie far outside: 1e100 is as good as any further place, as all of the shard is equally far from there."""
    with np.errstate(over="ignore"):
        return np.clip(x / scale - centre / scale, -1e100, 1e100)


def euclidean(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the rows of x to q."""
    with np.errstate(over="ignore", under="ignore"):
        d = x - q
        out = np.sqrt((d**2).sum(1))
    odd = ~np.isfinite(out) | (out < 1e-140)
    if odd.any():  # squares beyond double precision
        half = x[odd] / 2 - q / 2
        top = np.maximum(np.abs(half).max(1), np.finfo(float).tiny)
        with np.errstate(over="ignore"):
            out[odd] = np.sqrt(((half / top[:, None]) ** 2).sum(1)) * top * 2
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` best nodes found for each row of q, and their squared distances; -1 where fewer were found."""
    b, n = len(q), len(x)
    rows = np.arange(b)[:, None]
    ids, dist, open_ = np.full((b, beam), -1), np.full((b, beam), np.inf), np.zeros((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)
    seen[:, [start, n]] = True
    ids[:, 0], dist[:, 0], open_[:, 0] = start, _distances(x, q, np.full((b, 1), start))[:, 0], True
    while open_.any():
        rank = np.where(open_, dist, np.inf)
        at = np.argpartition(rank, min(WIDE, beam - 1), axis=1)[:, :WIDE] if beam > WIDE else np.argsort(rank, axis=1)[:, :WIDE]
        go = open_[rows, at]
        open_[rows, at] = False
        near = np.where(go[:, :, None], graph[np.maximum(ids[rows, at], 0)], -1).reshape(b, -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[rows, near]] = n
        seen[rows, near] = True
        live = np.flatnonzero((near < n).any(1))
        if not len(live):
            continue
        near = near[live]
        near.sort(axis=1)
        near = near[:, : int((near < n).sum(1).max())]
        d = _distances(x, q[live], np.minimum(near, n - 1))
        d[near == n] = np.inf
        fresh = (near < n) & np.isfinite(d)
        all_d = np.concatenate([dist[live], d], 1)
        top = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        part = np.arange(len(live))[:, None]
        ids[live] = np.concatenate([ids[live], np.where(near == n, -1, near)], 1)[part, top]
        open_[live] = np.concatenate([open_[live], fresh], 1)[part, top]
        dist[live] = all_d[part, top]
    order = np.argsort(dist, axis=1, kind="stable")
    return ids[rows, order], dist[rows, order]


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For every node the kept candidates (-1: none): nearest first, each one removing those that it is alpha times nearer to."""
    cand = np.sort(np.where((cand < 0) | (cand == nodes[:, None]), len(x), cand), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = len(x)
    d = _distances(x, x[nodes], np.minimum(cand, len(x) - 1))
    d[cand == len(x)] = np.inf
    rows = np.arange(len(nodes))
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = cand[rows[:, None], order], d[rows[:, None], order]
    p = x[np.minimum(cand, len(x) - 1)]
    out = np.full((len(nodes), degree), -1)
    alive = np.isfinite(d)
    for k in range(degree):
        first = alive.argmax(1)
        ok = alive[rows, first]
        if not ok.any():
            break
        out[ok, k] = cand[rows, first][ok]
        apart = p - p[rows, first][:, None, :]
        to = np.einsum("bkd,bkd->bk", apart, apart)
        alive &= ~(alpha * alpha * to <= d) & ok[:, None]
        alive[rows, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, slack: int = SLACK, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (n, slack; -1: none) and the start node, of scaled vectors."""
    n = len(x)
    graph = np.full((n, slack), -1, np.int64)
    start = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    todo = np.random.default_rng(n).permutation(n)
    todo = todo[todo != start]
    at, size = 0, 1
    while at < len(todo):
        new = todo[at : at + size]
        at, size = at + size, min(256, 2 * size)
        found, _ = beam_search(x, graph, start, x[new], beam)
        kept = robust_prune(x, new, found, degree, alpha)
        graph[new, :degree] = kept
        dst, src = kept.ravel(), np.repeat(new, degree)
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        ends, first, count = *np.unique(dst, return_index=True), np.bincount(dst, minlength=n)
        used = (graph[ends] >= 0).sum(1)
        place = np.arange(len(dst)) - np.repeat(first, count[ends]) + np.repeat(used, count[ends])
        fits = np.repeat(used + count[ends] <= slack, count[ends])
        graph[dst[fits], place[fits]] = src[fits]
        over = ends[used + count[ends] > slack]
        for i in range(0, len(over), 128):
            some = over[i : i + 128]
            wide = np.full((len(some), slack + int(count[some].max())), -1)
            wide[:, :slack] = graph[some]
            lo, hi = np.searchsorted(dst, some), np.searchsorted(dst, some, side="right")
            for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
                wide[k, slack : slack + b - a] = src[a:b]
            graph[some] = -1
            graph[some, :degree] = robust_prune(x, some, wide, degree, alpha)
    return graph, start


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the distinct rows that take part."""
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    big = F.lit(float("inf"))
    ok = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < big)) & F.exists("v", lambda c: c != 0)
    return v.filter(F.coalesce(ok, F.lit(False))).distinct()


def nodes_of(rows: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """(v, ids): distinct valid vectors with their k + 1 smallest ids, which is all that k results besides the query can need."""
    # the rank limit is applied before the exchange too, so a hot vector sends k + 1 rows from each task
    v = valid(rows, id_col, vector_col).withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    return v.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def index(rows: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int | None = None) -> DataFrame:
    """One row a shard: dim, shard, ids, vectors, edges, start; written to the shared folder."""
    ship(rows.sparkSession)
    nodes = materialise(nodes_of(rows, k, id_col, vector_col))
    n = nodes.count()
    shard = shard or shard_size(n)
    shards = -(-n // shard) or 1
    dealt = nodes.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    # a shard is few bytes and much work: a task for each, which a stated number keeps from being merged by size
    dealt = dealt.repartitionById(shards, "shard")

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        from modloom.llm import ann_graph as g

        g.held("ann_graph")
        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda a: a[0]))
        x = np.stack(list(pdf.v)).astype(np.float64)
        graph, start = g.build(g.scaled(x, *g.scaling(x)))
        return pd.DataFrame({"dim": [int(pdf.dim.iloc[0])], "shard": [int(pdf.shard.iloc[0])], "ids": [[list(map(int, i)) for i in pdf.ids]], "vectors": [x.tobytes()], "edges": [graph.astype(np.int32).tobytes()], "start": [start]})

    graphs = materialise(dealt.groupBy("dim", "shard").applyInPandas(make, "dim int, shard int, ids array<array<long>>, vectors binary, edges binary, start int"))
    discard(nodes)
    return graphs


def search(graphs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every valid query, its own id left out."""
    ship(graphs.sparkSession)
    q = valid(queries, id_col, vector_col)
    n = q.count()
    last = graphs.agg(F.max("shard")).first()[0] or 0
    q = q.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(-(-n // ASKED) or 1)).cast("int"))
    blocks = q.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("asked"))
    # a stated query set against all shards, in blocks: a row for each block of ASKED queries and shard, one at a time in a task
    pairs = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(graphs, ["dim", "shard"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from modloom.llm import ann_graph as g

        g.held("ann_graph")
        r = next(pdf.itertuples(index=False))
        x = np.frombuffer(r.vectors).reshape(-1, r.dim)
        edges = np.frombuffer(r.edges, np.int32).reshape(len(x), -1)
        asked, v = [a["id"] for a in r.asked], np.stack([a["v"] for a in r.asked]).astype(np.float64)
        centre, scale = g.scaling(x)
        inner, out = g.scaled(x, centre, scale), []
        for b in range(0, len(asked), BLOCK):
            found, _ = g.beam_search(inner, edges, r.start, g.scaled(v[b : b + BLOCK], centre, scale), max(beam, k + 1))
            for i, own in enumerate(asked[b : b + BLOCK]):
                f = found[i][found[i] >= 0]
                near = [(float(s), int(c), own) for s, j in zip(g.euclidean(x[f], v[b + i]).tolist(), f.tolist(), strict=True) for c in r.ids[j] if c != own]
                out += sorted(near)[:k]
        return pd.DataFrame(out, columns=["score", "vec_id", "query_id"]).astype({"score": float, "vec_id": "int64", "query_id": "int64"})

    # the join has dealt the rows by shard, which is all that the grouping needs
    best = pairs.groupBy("dim", "shard", "block").applyInPandas(run, "score double, vec_id long, query_id long")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(index(rows), rows.filter(F.col("vec_id") % 100 == 0))
