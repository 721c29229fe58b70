"""Null models, modularity matrices and (signless) Laplacians of an edge table, without n x n storage.

Entries are given on the support: the edges and the diagonal. What lies outside it is a product of node columns (the null
model), which the linear operators of plans.spectral apply as scalar products. Divisions by a zero degree give null there
and zero in the operators (pseudo-inverse).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))


def totals(deg: DataFrame) -> DataFrame:
    """One row: tot (twice the weight), n."""
    return deg.agg(F.sum("d").cast("double").alias("tot"), F.count("id").alias("n"))


def null_weight(null: str, di: Column, dj: Column, tot: Column, n: Column) -> Column:
    """The expected weight of a pair: by degrees (ng) or uniform (er)."""
    return di * dj / tot if null == "ng" else F.try_divide(tot, (n * (n - 1)).cast("double"))


def node_table(edges: DataFrame, null: str = "ng") -> DataFrame:
    """id, d, tot, n, dp and dn: row sums of the positive and negative parts of W - P (the diagonal counts in the latter)."""
    deg = degrees(edges).withColumn("d", F.col("d").cast("double"))
    deg = deg.crossJoin(F.broadcast(totals(deg)))  # one row
    pair = edges.join(deg.select(F.col("id").alias("src"), F.col("d").alias("di"), "tot", "n"), "src").join(deg.select(F.col("id").alias("dst"), F.col("d").alias("dj")), "dst")
    p = null_weight(null, F.col("di"), F.col("dj"), F.col("tot"), F.col("n"))
    pos = pair.groupBy(F.col("src").alias("id")).agg(F.sum(F.greatest(F.col("w") - p, F.lit(0.0))).alias("dp"))
    row = F.col("d") if null == "ng" else null_weight("er", F.col("d"), F.col("d"), F.col("tot"), F.col("n")) * F.col("n")
    return deg.join(pos, "id").withColumn("dn", F.col("dp") - F.col("d") + row)


def support(edges: DataFrame, nodes: DataFrame, null: str) -> DataFrame:
    """Edges and diagonal with every quantity that the matrices are made of."""
    diagonal = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"))
    s = edges.select("src", "dst", F.col("w").cast("double").alias("w")).union(diagonal)
    i = nodes.select(F.col("id").alias("src"), F.col("d").alias("di"), F.col("dp").alias("pi"), F.col("dn").alias("ni"), "tot", "n")
    j = nodes.select(F.col("id").alias("dst"), F.col("d").alias("dj"), F.col("dp").alias("pj"), F.col("dn").alias("nj"))
    s = s.join(i, "src").join(j, "dst")
    s = s.withColumn("p", null_weight(null, F.col("di"), F.col("dj"), F.col("tot"), F.col("n"))).withColumn("one", (F.col("src") == F.col("dst")).cast("double"))
    b = F.col("w") - F.col("p")
    return s.withColumn("bp", F.greatest(b, F.lit(0.0))).withColumn("bn", F.greatest(-b, F.lit(0.0)))


def _root(a: str) -> Column:
    return F.sqrt(F.nullif(F.col(f"{a}i") * F.col(f"{a}j"), F.lit(0.0)))


def _by(a: str) -> Column:
    return F.nullif(F.col(f"{a}i"), F.lit(0.0))


#: Entry formulas by name.
ENTRIES = {
    "null_model": lambda: F.col("p"),
    "laplacian": lambda: F.col("one") * F.col("di") - F.col("w"),
    "laplacian_sym": lambda: F.col("one") - F.col("w") / _root("d"),
    "laplacian_rw": lambda: F.col("one") - F.col("w") / _by("d"),
    "signless": lambda: F.col("one") * F.col("di") + F.col("p"),
    "signless_sym": lambda: F.col("one") + F.col("p") / _root("d"),
    "signless_rw": lambda: F.col("one") + F.col("p") / _by("d"),
    "lmix_sym": lambda: 2 * F.col("one") - (F.col("w") - F.col("p")) / _root("d"),
    "lmix_rw": lambda: 2 * F.col("one") - (F.col("w") - F.col("p")) / _by("d"),
    "modularity_matrix": lambda: F.col("w") - F.col("p"),
    "b_pos": lambda: F.col("bp"),
    "b_neg": lambda: F.col("bn"),
    "b_pos_lap_sym": lambda: F.col("one") - F.col("bp") / _root("p"),
    "b_pos_lap_rw": lambda: F.col("one") - F.col("bp") / _by("p"),
    "b_neg_signless_sym": lambda: F.col("one") + F.col("bn") / _root("n"),
    "b_neg_signless_rw": lambda: F.col("one") + F.col("bn") / _by("n"),
    "lb_sym": lambda: 2 * F.col("one") - F.col("bp") / _root("p") + F.col("bn") / _root("n"),
    "lb_rw": lambda: 2 * F.col("one") - F.col("bp") / _by("p") + F.col("bn") / _by("n"),
}


def entries(edges: DataFrame, name: str, null: str = "ng") -> DataFrame:
    """(src, dst, v) of a matrix on the support."""
    nodes = node_table(edges, null)
    return support(edges, nodes, null).select("src", "dst", ENTRIES[name]().alias("v"))
