"""Chains of products of an operator with m vectors, of which each is one shuffle.

Nodes are dealt to parts by a hash of their id. A part is one row of a bucketed table that is written once: its nodes with the factors of the
rank-one terms, and the edges that end there, each with its one coefficient. To make a product, a part sends to every part where its edges
start the sums for that part's nodes, packed as bytes, and its share of the rank-one terms' scalar products. The task that adds up what arrives
sends the next product's sums at once, so a polynomial of the operator is one job that writes only its result, and no edge moves.

Parts grow in number with the edges and nodes, so that a part does not grow in size (all edges of one node lie in one part: some 20 bytes
for each while it is packed and read). Small parts are few, since a node's sums go once to each part that its edges lie in. Scalar products
are parts**2 rows of m numbers, few beside the edges. A chain's shuffles are deleted as soon as its result is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .tables import discard, dropping_shuffles, materialise, materialise_by

#: Edges and nodes of a part at most, about; edges that are worth a part of their own while there are fewer parts than shuffle partitions.
EDGES, NODES, LEAST = 500_000, 30_000, 100_000
GRAPH = "part int, ids binary, outer binary, inner binary, src binary, of binary, place binary, a binary"
#: sender -1: a part's own vectors, this term's and the last one's (or all earlier ones); else sums for the part's nodes, and the sender's scalar products.
STATE = "part int, sender int, ids binary, x binary, q binary"


def _own(part: int, ids: bytes, *vectors: np.ndarray) -> tuple:
    return part, -1, ids, np.concatenate(vectors).tobytes(), b""


def _vectors(x: bytes, ids: bytes, m: int) -> np.ndarray:
    """(kinds, nodes, m)."""
    return np.frombuffer(x).reshape(-1, len(ids) // 8, m)


def turned(x: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    for w in turns:  # one by one: the later ones take what the rounding of the first ones leaves
        x = x @ w
    return x


class Blocks:
    """An operator's parts. Vectors are (part, sender, ids, x, q): a row for each part."""

    def __init__(self, op) -> None:
        spark = op.nodes.sparkSession
        ship(spark)
        self.shift, self.rank = op.shift, len(op.rank_one)
        n, edges = int(spark.conf.get("spark.sql.shuffle.partitions")), op.edges.count()
        self.parts = parts = max(min(n, -(-edges // LEAST)), -(-edges // EDGES), -(-op.nodes.count() // NODES), 1)
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
        row = lambda cols: F.array(*[c.cast("double") for c in cols]).cast("array<double>")
        self.nodes = op.nodes.select("id", part("id").alias("part"), row([F.lit(f) * F.col(left) for f, left, _ in op.rank_one]).alias("outer"), row([F.col(right) for *_, right in op.rank_one]).alias("inner"))
        ends = op.nodes.select("id", *sorted({c for _, _, left, right in op.sparse for c in (left, right)}))
        i, j = ends.toDF(*[f"i_{c}" for c in ends.columns]), ends.toDF(*[f"j_{c}" for c in ends.columns])
        e = op.edges.join(j, F.col("dst") == F.col("j_id")).join(i, F.col("src") == F.col("i_id"))
        a = sum((F.lit(f) * F.col(f"i_{left}") * F.col(col) * F.col(f"j_{right}") for f, col, left, right in op.sparse), F.lit(0.0))
        edges = e.select(part("dst").alias("part"), part("src").alias("of"), "src", "dst", a.alias("a"))

        def pack(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
            nodes = nodes.sort_values("id")
            edges = edges.iloc[np.lexsort((edges.dst, edges.src, edges.of))]
            ids = nodes.id.to_numpy(np.int64)
            at = np.searchsorted(ids, edges.dst.to_numpy(np.int64)).astype(np.int32)
            scalings = [np.stack(list(c)).astype(float).tobytes() for c in (nodes.outer, nodes.inner)]
            columns = [c.to_numpy(t).tobytes() for c, t in ((edges.src, np.int64), (edges.of, np.int32))]
            return pd.DataFrame([(int(nodes.part.iloc[0]), ids.tobytes(), *scalings, *columns, at.tobytes(), edges.a.to_numpy(float).tobytes())])

        # the inner joins leave no edge without its node
        self.buckets = min(n, parts)
        with dropping_shuffles(spark):
            self.graph = materialise_by(self.nodes.groupBy("part").cogroup(edges.groupBy("part")).applyInPandas(pack, GRAPH), "part", self.buckets)

    def start(self, table: DataFrame) -> DataFrame:
        """Written vectors from (id, v array)."""

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            return pd.DataFrame([_own(int(pdf.part.iloc[0]), pdf.id.to_numpy(np.int64).tobytes(), np.stack(list(pdf.v)).astype(float))])

        return materialise(self.nodes.select("id", "part").join(table, "id").groupBy("part").applyInPandas(pack, STATE))

    def _step(self, state: DataFrame, m: int, turns: list[np.ndarray], now: tuple[float, float, float] | None, send: bool, gram: bool = False, every: bool = False) -> DataFrame:
        """Add up what has arrived (now: the factors of the product, of this term and of the last one) and send the sums of the next product.
        every: all terms are kept, the newest first; the last step leaves out the first one."""
        shift, rank, parts = self.shift, self.rank, self.parts

        def run(got: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
            if not len(graph):
                return pd.DataFrame()
            g, mine = graph.iloc[0], got[got.sender < 0].iloc[0]
            ids = np.frombuffer(g.ids, np.int64)
            factors = [np.frombuffer(b).reshape(len(ids), rank) for b in (g.outer, g.inner)]
            terms = _vectors(mine.x, g.ids, m)
            x = turned(terms[0], turns)
            kept = [x]
            if now:
                y = shift * x
                q = np.zeros((rank, m))
                for who, sent, sums, dots in zip(got.sender, got.ids, got.x, got.q, strict=True):
                    if dots:
                        q = q + np.frombuffer(dots).reshape(rank, m)
                    if who >= 0 and sent:
                        y[np.searchsorted(ids, np.frombuffer(sent, np.int64))] += np.frombuffer(sums).reshape(-1, m)
                y += factors[0] @ q
                if gram:
                    return pd.DataFrame({"g": [(x.T @ y).ravel()]})
                x = now[0] * y + now[1] * x + (now[2] * terms[1] if now[2] else 0.0)
                kept = [x, *(terms if every else kept)]
            rows = [_own(int(g.part), g.ids, *(kept if send else kept[:-1] if every else [x]))]
            if send:
                src, of, at, a = (np.frombuffer(b, t) for b, t in ((g.src, np.int64), (g.of, np.int32), (g.place, np.int32), (g.a, float)))
                dots = (factors[1].T @ x).tobytes() if rank else b""
                for p in range(parts) if rank else np.unique(of):
                    low, high = np.searchsorted(of, [p, p + 1])
                    to, first = np.unique(src[low:high], return_index=True)
                    sums = np.add.reduceat(a[low:high, None] * x[at[low:high]], first) if len(to) else np.zeros((0, x.shape[1]))
                    rows.append((int(p), int(g.part), to.tobytes(), sums.tobytes(), dots))
            return pd.DataFrame(rows)

        both = state.groupBy("part").cogroup(self.graph.groupBy("part"))
        return both.applyInPandas(run, "g array<double>" if gram else STATE)

    def filtered(self, x: DataFrame, m: int, turns: list[np.ndarray], degree: int, low: float, high: float) -> DataFrame:
        """Written: the Chebyshev polynomial of a degree that stays small on [low, high]."""
        c, h = (high + low) / 2, (high - low) / 2
        state = self._step(x, m, turns, None, True)
        for i in range(degree):
            now = (2 / h, -2 * c / h, -1.0) if i else (1 / h, -c / h, 0.0)
            state = self._step(state, m, [], now, i < degree - 1)
        with dropping_shuffles(x.sparkSession):
            return materialise(state)

    def terms(self, basis: DataFrame, m: int, last: int, degree: int, low: float, high: float) -> DataFrame:
        """Written in the buckets of the parts: the Chebyshev polynomials degree, .., 1 of [low, high] of the last vectors of a basis of m."""
        c, h = (high + low) / 2, (high - low) / 2
        state = self._step(basis, m, [np.eye(m)[:, m - last :]], None, True)
        for i in range(degree):
            now = (2 / h, -2 * c / h, -1.0) if i else (1 / h, -c / h, 0.0)
            state = self._step(state, last, [], now, i < degree - 1, every=True)
        return self.kept(state)

    def kept(self, x: DataFrame) -> DataFrame:
        """Vectors written in the buckets of the parts: what joins them by part moves nothing."""
        with dropping_shuffles(x.sparkSession):
            return materialise_by(x, "part", self.buckets)

    def gram(self, x: DataFrame, m: int, turns: list[np.ndarray]) -> np.ndarray:
        """X'AX: m * m numbers from each part."""
        sent = self._step(x, m, turns, None, True)
        return np.sum([r["g"] for r in self._step(sent, m, [], (1.0, 0.0, 0.0), False, gram=True).collect()], axis=0).reshape(m, m)

    def close(self) -> None:
        discard(self.graph)


def beside(ids: bytes, x: bytes, m: int, more: bytes, last: int) -> np.ndarray:
    """A part's m vectors and the terms made from the last of them, lowest degree first, as columns."""
    return np.concatenate([_vectors(x, ids, m)[0], *_vectors(more, ids, last)[::-1]], axis=1) if more else _vectors(x, ids, m)[0]


def turned_parts(x: DataFrame, m: int, last: int, turns: list[np.ndarray]) -> DataFrame:
    """Vectors from (part, ids, x, more), turned."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, ids, b, more in zip(pdf.part, pdf.ids, pdf.x, pdf.more, strict=True):
                yield pd.DataFrame([_own(int(part), ids, turned(beside(ids, b, m, more, last), turns))], columns=["part", "sender", "ids", "x", "q"])

    return x.mapInPandas(run, STATE)


def unpacked(x: DataFrame, m: int, turns: list[np.ndarray], keep: int) -> DataFrame:
    """(id, v): the first columns of the turned vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, b in zip(pdf.ids, pdf.x, strict=True):
                yield pd.DataFrame({"id": np.frombuffer(ids, np.int64), "v": list(turned(_vectors(b, ids, m)[0], turns)[:, :keep])})

    return x.select("ids", "x").mapInPandas(run, "id long, v array<double>")
