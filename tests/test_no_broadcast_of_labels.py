"""Labels of many runs are small as files and large as rows: no join takes them through the driver."""

from pyspark.sql import functions as F

from modloom.operators import metrics
from modloom.plans import quality
from modloom.plans.tables import materialise


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_of_many_runs_broadcast_no_labels(spark):
    edges = materialise(spark.range(4000).select((F.col("id") % 50).alias("src"), ((F.col("id") * 7 + 1) % 50).alias("dst"), F.lit(1.0).alias("w")))
    labels = materialise(spark.range(50).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("run")).select("run", "id", ((F.col("id") + F.col("run")) % 3).cast("int").alias("label")))
    inside = metrics.community_sums(edges, labels, ("run",))
    assert "Broadcast" not in _plan(inside)


def test_the_tracker_joins_ends_by_merging(spark):
    edges = spark.range(400).select((F.col("id") % 20).alias("src"), ((F.col("id") * 7 + 1) % 20).alias("dst"), F.lit(1.0).alias("w"))
    t = quality.Tracker(edges, 1, 3)
    labels = spark.range(20).select("id", F.array(F.lit(0)).alias("was"), F.array((F.col("id") % 3).cast("int")).alias("now"))
    assert "BroadcastHashJoin" not in _plan(t.edges.join(t._ends(labels, "src"), "src").join(t._ends(labels, "dst"), "dst"))
    t.close()
