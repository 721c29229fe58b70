"""Reading graphs and points from files, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graphs import symmetrised


def read_edges(spark: SparkSession, path: str, kind: str = "parquet", src: str = "src", dst: str = "dst", w: str | None = "w", **options: str) -> DataFrame:
    """A symmetric edge table from any file format that Spark reads; without a weight column every line counts 1."""
    rows = spark.read.options(**options).format(kind).load(path)
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    return symmetrised(rows.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), weight.alias("w")).filter("src IS NOT NULL AND dst IS NOT NULL AND w > 0"))


def read_points(spark: SparkSession, path: str, vector: str, id_col: str, kind: str = "parquet", **options: str) -> DataFrame:
    rows = spark.read.options(**options).format(kind).load(path)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("features"))


def write_partition(labels: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    labels.select("id", "label").write.format(kind).mode(mode).save(path)
