"""Initial assignments, label tables and their conversions.

Defined results: a null label stays null and is no class of its own; ids are taken as unique; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import key
from ..plans.tables import materialise


def ranked(nodes: DataFrame, seed: int) -> DataFrame:
    """(id, rank), from 1, in the order of a keyed number: a permutation that any partitioning reproduces.

    Ranges of the number are ranked each on its own and moved up by the rows of the ranges before, so no task takes all rows."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(nodes.select("id", key("id", seed).alias("key")).repartitionByRange(n, "key", "id").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.count("id").alias("rows"))  # a row for each range
    before = sums.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("key", "id"))
    return dealt.withColumn("own", own).join(before, "part").select("id", (F.col("own") + F.col("before")).alias("rank"))


def init_equal(nodes: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """n // k nodes for each class by keyed rank; the n % k left over stay without a label."""
    n = nodes.agg(F.count("id").alias("n"))
    r = ranked(nodes.select("id"), seed).crossJoin(F.broadcast(n))  # one row
    label = F.floor((F.col("rank") - 1) / F.greatest(F.floor(F.col("n") / k), F.lit(1)))
    return r.select("id", F.when(label < k, label).cast("int").alias("label"))


def init_random(nodes: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """A uniform class for each node."""
    return nodes.select("id", (key("id", seed) % k).cast("int").alias("label"))


def init_binary_equal(nodes: DataFrame, seed: int = 7) -> DataFrame:
    """+1 for the first half by keyed rank, -1 for the rest."""
    n = nodes.agg(F.count("id").alias("n"))
    r = ranked(nodes.select("id"), seed).crossJoin(F.broadcast(n))  # one row
    return r.select("id", F.when(F.col("rank") <= F.floor(F.col("n") / 2), 1).otherwise(-1).alias("u"))


def init_binary_random(nodes: DataFrame, seed: int = 7) -> DataFrame:
    """A uniform value in [-1, 1) for each node."""
    return nodes.select("id", (key("id", seed) / F.lit(2.0**31) - 1).alias("u"))


def init_binary_vector(vectors: DataFrame, place: int = 1) -> DataFrame:
    """Each node's entry of one eigenvector (id, v), by default of the second; null where v is shorter."""
    return vectors.select("id", F.get("v", F.lit(place)).alias("u"))


def seeds(labels: DataFrame, per_class: int, seed: int = 7) -> DataFrame:
    """per_class nodes of each true class, by keyed number."""
    w = Window.partitionBy("truth").orderBy(key("id", seed), "id")
    return labels.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_class).select("id", F.col("truth").alias("label"))


def init_semi_supervised(labels: DataFrame, per_class: int = 1, seed: int = 7) -> DataFrame:
    """The seeds' classes; null elsewhere."""
    return labels.select("id").join(seeds(labels, per_class, seed), "id", "left")


def init_overlay(labels: DataFrame, k: int, per_class: int = 1, seed: int = 7) -> DataFrame:
    """A random start with the seeds' true classes laid over it."""
    s = seeds(labels, per_class, seed).withColumnRenamed("label", "known")
    return init_random(labels, k, seed).join(s, "id", "left").select("id", F.coalesce("known", "label").alias("label"))


def standard_labels(labels: DataFrame, col: str = "label") -> DataFrame:
    """Labels replaced by their place among the distinct values, from 0; the distinct values alone are ranked."""
    codes = labels.select(F.col(col).alias("__of")).distinct().filter("__of IS NOT NULL").withColumn("code", F.row_number().over(Window.orderBy("__of")) - 1)
    return labels.join(codes, labels[col] == codes["__of"], "left").select("id", F.col("code").cast("int").alias("label"))


def binary_labels(labels: DataFrame, col: str = "label") -> DataFrame:
    """-1 for the least value, 1 for the second, 0 for any other."""
    codes = standard_labels(labels, col)
    return codes.select("id", F.when(F.col("label") == 0, -1).when(F.col("label") == 1, 1).when(F.col("label").isNotNull(), 0).alias("label"))


def communities(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("members"))


def explode_communities(c: DataFrame) -> DataFrame:
    return c.select(F.explode("members").alias("id"), "label")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("id").alias("n"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """The standard stopping quantity: four for every node that changes its class."""
    both = old.select("id", F.col("label").alias("a")).join(new.select("id", F.col("label").alias("b")), "id")
    return both.agg((4 * F.count_if(F.col("a") != F.col("b"))).alias("stop"))
