"""Modularity of many partitions that change a little from round to round: only edges at nodes that have moved are joined.

With both directions of an edge in the table, moving a set of nodes changes the inner weight by the rows that leave a moved node:
once where the other end has moved too, twice where it has not (its own row is the mirror image). Degree sums change by the moved nodes'
degrees. So a round joins the rows at moved nodes with the labels of their other ends; the edges lie in buckets of one end and are
never shuffled, and where few nodes move, their ids reach the scan as a filter on row groups sorted by that end.

Defined results: those of operators.metrics. Labels below 0 stand for none and are a class like others. An edge between a node and
itself always counts as inner weight. The edges must hold both directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matrices import degrees
from .tables import discard, materialise, materialise_by

#: Moved nodes whose ids are sent to the scan itself; more are joined. Both give the same rows.
PUSHED = 1000


def _stack(x: pd.Series) -> np.ndarray:
    return np.stack(list(x))


class Tracker:
    """The modularity of several runs. `full` starts it; `update` follows the moves."""

    def __init__(self, edges: DataFrame, runs: int, k: int, gamma: float = 1.0):
        self.k, self.gamma = k, gamma
        self.edges = materialise_by(edges.select("src", "dst", F.col("w").cast("double").alias("w")), "src")
        self.d = materialise(degrees(self.edges))
        self.total = self.d.agg(F.sum("d")).first()[0] or 0.0
        self.inside, self.sums = np.zeros(runs), np.zeros((runs, k + 1))  # the last class: no label
        #: rows of the edge table that each call has joined
        self.joined: list[int] = []

    def _degree_sums(self, labels: DataFrame, n: int) -> np.ndarray:
        """What was -> now adds to the degree sums of n runs; labels: id, was (may be null), now."""
        k = self.k

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((n, k + 1))
            for pdf in batches:
                if len(pdf):
                    d, now = pdf.d.to_numpy(), _stack(pdf.now)
                    was = None if pdf.was.iloc[0] is None else _stack(pdf.was)
                    for i in range(n):
                        out[i] += np.bincount(now[:, i] % (k + 1), d, k + 1)
                        if was is not None:
                            out[i] -= np.bincount(was[:, i] % (k + 1), d, k + 1)
            yield pd.DataFrame({"s": [out.ravel()]})

        rows = labels.join(self.d, "id").select("d", "was", "now").mapInPandas(run, "s array<double>").collect()  # a row for each partition
        return np.sum([r["s"] for r in rows], axis=0).reshape(n, k + 1) if rows else np.zeros((n, k + 1))

    def _inner(self, both: DataFrame, n: int) -> np.ndarray:
        """What the rows (w, was_s, now_s, was_d, now_d) add to the inner weight of n runs; was_s null: all of it is new."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, rows = np.zeros(n), 0
            for pdf in batches:
                if len(pdf):
                    rows += len(pdf)
                    w, s, d = pdf.w.to_numpy()[:, None], _stack(pdf.now_s), _stack(pdf.now_d)
                    if pdf.was_s.iloc[0] is None:
                        out += (w * (s == d)).sum(0)
                        continue
                    s0, d0 = _stack(pdf.was_s), _stack(pdf.was_d)
                    times = np.where(s0 == s, 0, np.where(d0 == d, 2, 1))
                    out += (w * times * ((s == d).astype(int) - (s0 == d0))).sum(0)
            yield pd.DataFrame({"s": [out], "rows": [rows]})

        rows = both.select("w", "was_s", "now_s", "was_d", "now_d").mapInPandas(run, "s array<double>, rows long").collect()  # a row for each partition
        self.joined.append(sum(r["rows"] for r in rows))
        return np.sum([r["s"] for r in rows], axis=0) if rows else np.zeros(n)

    def _ends(self, labels: DataFrame, end: str) -> DataFrame:
        ends = labels.select(F.col("id").alias(end), F.col("was").alias(f"was_{end[0]}"), F.col("now").alias(f"now_{end[0]}"))
        return ends.hint("merge")  # small as files, large as rows of a broadcast

    def full(self, labels: DataFrame, runs: list[int]) -> None:
        """Take the runs' scores from scratch: one pass over all edges. labels: (id, now), now an array with a label for each of `runs`."""
        labels = labels.select("id", F.lit(None).cast("array<int>").alias("was"), "now")
        self.inside[runs] = self._inner(self.edges.join(self._ends(labels, "src"), "src").join(self._ends(labels, "dst"), "dst"), len(runs))
        self.sums[runs] = self._degree_sums(labels, len(runs))

    def update(self, labels: DataFrame, runs: list[int], most: int) -> None:
        """Follow the moves of `runs`. labels: (id, was, now) of all nodes, arrays with a label for each of `runs`; most: a number that
        the nodes that move in any of them do not exceed."""
        if not most:
            self.joined.append(0)
            return
        moved, edges = materialise(labels.filter("was <> now")), self.edges
        if most <= PUSHED:
            edges = edges.filter(F.col("src").isin([r["id"] for r in moved.select("id").collect()]))  # PUSHED at most
        at = edges.join(self._ends(moved, "src"), "src")
        self.inside[runs] += self._inner(at.join(self._ends(labels, "dst"), "dst"), len(runs))
        self.sums[runs] += self._degree_sums(moved, len(runs))
        discard(moved)

    def modularity(self) -> np.ndarray:
        if not self.total:
            return np.zeros(len(self.inside))
        return self.inside / self.total - self.gamma * (self.sums**2).sum(1) / self.total**2

    def close(self) -> None:
        discard(self.edges, self.d)
