"""Connected components of a link table by label propagation with pointer jumping, and joins that keep a hot key from one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Rows of one key that may go to one task; tasks that the rows of a hotter key are dealt over.
HEAVY, SPREAD = 1000, 32


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", salt: Column | None = None, made: list[DataFrame] | None = None) -> DataFrame:
    """left joined with right on a key that is unique in right. Keys with more than HEAVY rows in left are dealt over SPREAD tasks by a
    hash (of the column `by`, or `salt`), and right's rows of these keys are copied so often; all other keys are joined as usual. `made` takes the table that the result reads."""
    dealt = F.pmod(F.xxhash64(by) if salt is None else salt, F.lit(SPREAD)).cast("int")
    hot = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > HEAVY).select(key, F.lit(True).alias("__hot"))
    if not hot.limit(1).count():
        return left.join(right, key, how)
    hot = materialise(hot)
    if made is not None:
        made.append(hot)
    copies = hot.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    marked = left.withColumn("__salt", dealt).join(copies, [key, "__salt"], "left").withColumn("__salt", F.when(F.col("__hot"), F.col("__salt")).otherwise(F.lit(0))).drop("__hot")
    lookup = right.join(hot, key, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return marked.join(lookup, [key, "__salt"], how).drop("__salt")


def _checksum(labels: DataFrame) -> tuple:
    """Two independent 64-bit hashes of a whole table: no join is needed to see that nothing has changed."""
    return tuple(labels.agg(F.bit_xor(F.xxhash64("node", "label")), F.bit_xor(F.xxhash64("label", "node", F.lit(5)))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of the links with the smallest node that it reaches. Each round is written to the shared folder.

    A hub's links are dealt over tasks once (`share`, by the other end), and its label is copied to each share in every round. A
    label's own label is looked up in the few labels that have moved, copied over SPREAD tasks, as many nodes share a label."""
    edges = materialise(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(b, a)).filter("x <> y").distinct())
    hubs = materialise(edges.groupBy(F.col("y").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HEAVY).select("node", (F.col("n") / HEAVY + 1).cast("int").alias("shares")))
    labels = materialise(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")))
    some = hubs.limit(1).count() > 0
    if some:
        at = hubs.select(F.col("node").alias("y"), "shares", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
        dealt = edges.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SPREAD)).cast("int")).join(at, ["y", "salt"], "left")
        dealt = materialise(dealt.select("x", "y", F.coalesce(F.pmod(F.xxhash64("x", F.lit(3)), F.col("shares")).cast("int"), F.lit(0)).alias("share")))
        discard(edges)
        edges = dealt
    stored = edges
    if not some:
        edges = edges.withColumn("share", F.lit(0))
    now = _checksum(labels)
    while True:
        told = labels.select(F.col("node").alias("y"), "label")
        if some:
            told = told.join(hubs.withColumnRenamed("node", "y"), "y", "left").select("y", "label", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
        else:
            told = told.withColumn("share", F.lit(0))
        heard = edges.join(told, ["y", "share"]).select(F.col("x").alias("node"), "label")
        least = labels.union(heard).groupBy("node").agg(F.min("label").alias("label"))
        # the label's own label may be smaller still: few labels have moved
        further = least.filter("node <> label").select(F.col("node").alias("label"), F.col("label").alias("further")).join(least.select("label").distinct(), "label")
        further = further.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        jump = least.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int")).join(further, ["label", "salt"], "left").select("node", F.coalesce("further", "label").alias("label"))
        new = materialise(jump)
        before, now = now, _checksum(new)
        discard(labels)
        labels = new
        if before == now:
            discard(hubs, stored)
            return labels
