"""Joins that keep a hot key from one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that may always go to one task.
FAIR = 100


def share_join(left: DataFrame, right: DataFrame, key: str, by: str, counts: DataFrame, rows: str, how: str = "left") -> DataFrame:
    """left joined with right on a key that is unique in right and never null. `counts` has left's number of rows of each key
    (columns `key` and `rows`).

    A fair share is left's rows by the number of shuffle partitions. Only keys beyond it are dealt: over as many shares as they hold
    fair ones, by a hash of the column `by`; right's rows of these keys are copied as often. There are fewer such keys than
    partitions, and no more than twice as many copies, whatever the data, so the list of them is broadcast."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum(rows).alias("n")).first()["n"] or 0
    fair = max(FAIR, -(-total // n))
    hot = F.broadcast(counts.filter(F.col(rows) > fair).select(F.col(key), F.ceil(F.col(rows) / F.lit(fair)).cast("int").alias("__shares")))
    one = F.coalesce(F.col("__shares"), F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("__share", F.pmod(F.xxhash64(by), one).cast("int")).drop("__shares")
    copied = right.join(hot, key, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), one - 1))).drop("__shares")
    return dealt.join(copied, [key, "__share"], how).drop("__share")
