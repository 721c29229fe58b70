"""Scores of a partition. labels: (id, label[, truth]); edges: both directions. With `by`, labels hold several partitions (a column that
numbers runs), and there is a row for each.

Defined results: without edges the weight share of communities counts as 0, and so does the null model's where a graph has no pairs;
a single row, or partitions without spread, have an adjusted Rand index and mutual information of 1; nodes without a label, or
outside the graph, count with a degree of 0; rows whose truth is null are a class of their own; an empty table gives nulls (no
row with `by`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matrices import degrees

Keys = tuple[str, ...]


def _ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def _beside(a: DataFrame, b: DataFrame, by: Keys) -> DataFrame:
    return a.join(b, list(by)) if by else a.crossJoin(b)  # one row each without keys


def community_sums(edges: DataFrame, labels: DataFrame, by: Keys = ()) -> DataFrame:
    """label, inside (weight of both directions), d, size."""
    if by:  # runs times nodes: files of a few classes are small, the rows that a broadcast takes to the driver are not
        labels = labels.hint("merge")
    a, b = labels.select(*by, F.col("id").alias("src"), F.col("label").alias("a")), labels.select(*by, F.col("id").alias("dst"), F.col("label").alias("b"))
    inside = edges.join(a, "src").join(b, ["dst", *by]).filter("a = b").groupBy(*by, F.col("a").alias("label")).agg(F.sum("w").alias("inside"))
    sums = labels.join(degrees(edges), "id", "left").groupBy(*by, "label").agg(F.sum(F.coalesce("d", F.lit(0))).alias("d"), F.count("id").alias("size"))
    return sums.join(inside, [*by, "label"], "left").select(*by, "label", F.coalesce("inside", F.lit(0)).cast("double").alias("inside"), F.col("d").cast("double").alias("d"), F.col("size").cast("double").alias("size"))


def _sums(edges: DataFrame, labels: DataFrame, by: Keys) -> DataFrame:
    c = community_sums(edges, labels, by)
    return c.groupBy(*by).agg(F.sum("d").alias("tot"), F.sum("size").alias("n"), F.sum("inside").alias("inside"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("size") * F.col("size")).alias("ss"))


def _modularity(null: str, gamma: float) -> Column:
    n, tot = F.col("n"), F.col("tot")
    pairs = {"ng": _ratio(F.col("dd"), tot * tot), "er_full": _ratio(F.col("ss"), n * (n - 1)), "er": _ratio(F.col("ss") - n, n * (n - 1))}[null]
    return _ratio(F.col("inside"), tot) - gamma * pairs


def modularity(edges: DataFrame, labels: DataFrame, null: str = "ng", gamma: float = 1.0, by: Keys = ()) -> DataFrame:
    """One row. null: ng; er (pairs of different nodes); er_full (every ordered pair, a node with itself too)."""
    return _sums(edges, labels, by).select(*by, _modularity(null, gamma).alias("modularity"))


def contingency(labels: DataFrame, by: Keys = ()) -> DataFrame:
    return labels.groupBy(*by, "truth", "label").agg(F.count("id").alias("n"))


def _purity(cells: DataFrame, inverse: bool, by: Keys) -> DataFrame:
    most = cells.groupBy(*by, "truth" if inverse else "label").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return most.groupBy(*by).agg(F.try_divide(F.sum("m"), F.sum("n")).alias("purity"))


def purity(labels: DataFrame, inverse: bool = False, by: Keys = ()) -> DataFrame:
    return _purity(contingency(labels, by), inverse, by)


def _pairs(x: str) -> Column:
    c = F.col(x).cast("double")
    return c * (c - 1) / 2


def _adjusted_rand(c: DataFrame, by: Keys) -> DataFrame:
    cells = c.groupBy(*by).agg(F.sum(_pairs("n")).alias("cells"), F.sum("n").alias("n"))
    rows = c.groupBy(*by, "truth").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(_pairs("n")).alias("rows"))
    cols = c.groupBy(*by, "label").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(_pairs("n")).alias("cols"))
    t = _beside(_beside(cells, rows, by), cols, by)
    expected = _ratio(F.col("rows") * F.col("cols"), _pairs("n"))
    spread = (F.col("rows") + F.col("cols")) / 2 - expected
    return t.select(*by, F.when(spread == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("cells") - expected, spread)).alias("ari"))


def adjusted_rand(labels: DataFrame, by: Keys = ()) -> DataFrame:
    return _adjusted_rand(contingency(labels, by), by)


def _mutual_information(c: DataFrame, by: Keys) -> DataFrame:
    """Entropies of the cells, the classes and the communities: the mutual information is the last two less the first."""

    def entropy(name: str, *cols: str) -> DataFrame:
        e = c.groupBy(*by, *cols).agg(F.sum("n").cast("double").alias("n")).groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"))
        return e.select(*by, (F.log("t") - F.try_divide(F.col("s"), F.col("t"))).alias(name))

    t = _beside(_beside(entropy("h", "truth", "label"), entropy("ha", "truth"), by), entropy("hb", "label"), by)
    mean = (F.col("ha") + F.col("hb")) / 2
    return t.select(*by, F.when(F.abs(mean) < 1e-12, F.lit(1.0)).otherwise(F.try_divide(F.col("ha") + F.col("hb") - F.col("h"), mean)).alias("nmi"))


def normalised_mutual_information(labels: DataFrame, by: Keys = ()) -> DataFrame:
    """Mutual information over the arithmetic mean of the entropies, natural logarithms."""
    return _mutual_information(contingency(labels, by), by)


def report(edges: DataFrame, labels: DataFrame, gamma: float = 1.0, by: Keys = ()) -> DataFrame:
    """A row with every score. edges and labels are best given as written tables: one pass over the edges gives both modularities, one
    over the labels the contingency table that all other scores come from."""
    q = _sums(edges, labels, by).select(*by, _modularity("ng", gamma).alias("modularity"), _modularity("er", gamma).alias("modularity_er"))
    c = contingency(labels, by)
    scores = [_purity(c, False, by), _purity(c, True, by).withColumnRenamed("purity", "inverse_purity"), _adjusted_rand(c, by), _mutual_information(c, by)]
    for s in scores:
        q = _beside(q, s, by)
    return q
