"""Graphs and points from the tables, generated graphs and small fixed ones. Edges are (src, dst, w), both directions stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import key

#: Order lines whose pairs go to one partition.
LINES = 500_000
#: The edges of the karate club graph (Zachary 1977), members numbered from 0.
KARATE = """0-1 0-2 0-3 0-4 0-5 0-6 0-7 0-8 0-10 0-11 0-12 0-13 0-17 0-19 0-21 0-31 1-2 1-3 1-7 1-13 1-17 1-19 1-21 1-30 2-3 2-7 2-8 2-9 2-13 2-27 2-28 2-32
3-7 3-12 3-13 4-6 4-10 5-6 5-10 5-16 6-16 8-30 8-32 8-33 9-33 13-33 14-32 14-33 15-32 15-33 18-32 18-33 19-33 20-32 20-33 22-32 22-33 23-25 23-27 23-29 23-32 23-33
24-25 24-27 24-31 25-31 26-29 26-33 27-33 28-31 28-33 29-32 29-33 30-32 30-33 31-32 31-33 32-33"""
#: The members who stayed with Mr. Hi; the others went to the Officer.
MR_HI = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 16, 17, 19, 21)


def symmetrised(arcs: DataFrame) -> DataFrame:
    """Both directions of every arc, weights of parallel arcs added, loops dropped."""
    both = arcs.select("src", "dst", "w").union(arcs.select("dst", "src", "w")).filter("src <> dst")
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def edges_of(spark: SparkSession, text: str) -> DataFrame:
    pairs = [(int(a), int(b), 1) for a, b in (e.split("-") for e in text.split())]
    return symmetrised(spark.createDataFrame(pairs, "src int, dst int, w long"))


def karate(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    nodes = spark.createDataFrame([(i, "Mr. Hi" if i in MR_HI else "Officer") for i in range(34)], "id int, club string")
    return edges_of(spark, KARATE), nodes.withColumn("truth", truth_code("club"))


def truth_code(col: str) -> F.Column:
    """The clubs' codes: 1 and 0; null for any other."""
    return F.when(F.col(col) == "Mr. Hi", 1).when(F.col(col) == "Officer", 0)


def toy(spark: SparkSession) -> DataFrame:
    """Two triangles and a bridge."""
    return edges_of(spark, "0-1 0-2 1-2 3-4 3-5 4-5 2-3")


def trade_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation to supplier nation, by number of lines."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    # lines are summed by order and nation before they meet the orders
    per = lines.groupBy("l_orderkey", "s_nationkey").agg(F.count("l_suppkey").alias("w"))
    got = per.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("c_nationkey <> s_nationkey")
    return got.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("w").alias("w"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symmetrised(trade_arcs(spark, sf_dir))


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share an order, by number of line pairs. Partitions grow in number with the lines, so that a task's do not grow in size;
    pairs go to the partition of src as they are: hardly any two of one task are equal before."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES))
    lines = lines.repartition(n, "l_orderkey")
    a, b = lines.toDF("o", "src"), lines.toDF("o", "dst")
    pairs = a.join(b, "o").filter("src <> dst").select("src", "dst").repartition(n, "src")
    return pairs.groupBy("src", "dst").agg(F.count("src").alias("w"))


def nations(spark: SparkSession, sf_dir: str, k: int = 5, seed: int = 7) -> DataFrame:
    """id, truth (region) and a keyed labelling."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("truth"), (key("n_nationkey", seed) % k).cast("int").alias("label"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, features, truth."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("truth"))


def block_model(spark: SparkSession, n: int, k: int, p_in: float, p_out: float, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """A stochastic block model of k equal blocks; each pair is drawn by a keyed number, so any partitioning gives the same graph."""
    size = n // k
    a = spark.range(n).withColumnRenamed("id", "src")
    # pairs by generation, so that no join is needed: every node lists the nodes after it
    pairs = a.filter(F.col("src") < n - 1).select("src", F.explode(F.sequence(F.col("src") + 1, F.lit(n - 1).cast("long"))).alias("dst"))
    same = F.floor(F.col("src") / size) == F.floor(F.col("dst") / size)
    drawn = key(F.col("src") * n + F.col("dst"), seed) / F.lit(2.0**32)
    arcs = pairs.filter(drawn < F.when(same, p_in).otherwise(p_out)).select("src", "dst", F.lit(1).cast("long").alias("w"))
    return symmetrised(arcs), spark.range(n).select("id", F.floor(F.col("id") / size).cast("int").alias("truth"))
