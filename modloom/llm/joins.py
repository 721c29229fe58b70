"""Places in a global order; and the library's join that keeps a hot key from one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import share_join
from .common import materialise

__all__ = ["numbered", "share_join"]


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 1) in a total order: a sort by ranges is written, and the sizes of its parts (one number each) give
    the places that each part begins at. rows must have no column __at. The result reads the written table."""
    spark = rows.sparkSession
    done = materialise(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    sizes = sorted(done.groupBy(F.shiftright("__at", 33).cast("int").alias("part")).count().collect())
    begins, at = [], 0
    for part, count in sizes:
        begins.append((part, at))
        at += count
    base = F.broadcast(spark.createDataFrame(begins, "__part int, __base long"))
    out = done.withColumn("__part", F.shiftright("__at", 33).cast("int")).join(base, "__part")
    return out.withColumn(name, F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*rows.columns, name)
