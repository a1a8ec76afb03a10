"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.session import drop_path, scratch_path


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (id, component): every id of an edge with the smallest id that its links reach.

    Each round gives an id the smallest label among its own and its neighbours', then the label of that label. Minima are
    formed before the shuffle, so that a hub costs one row per task; joins on a hub are left to adaptive execution, which
    splits them. Labels are written to the shared folder after each round. No edges: no rows. Loops and repeated edges are
    allowed; edges with a null end are no edges.
    """
    spark = edges.sparkSession
    base = scratch_path(spark, "components")
    both = edges.filter("a is not null and b is not null").select("a", "b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both.write.parquet(f"{base}/edges")
    both = spark.read.parquet(f"{base}/edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component"))
    step = 0
    labels.write.parquet(f"{base}/0")
    while True:
        now = spark.read.parquet(f"{base}/{step}")
        near = (
            both.join(now.select(F.col("id").alias("b"), F.col("component").alias("theirs")), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("theirs").alias("theirs"))
        )
        best = now.join(near, "id").select("id", "component", F.least("component", "theirs").alias("best"))
        jump = now.select(F.col("id").alias("best"), F.col("component").alias("far"))
        best.join(jump, "best").select("id", F.least("best", "far").alias("component"), (F.least("best", "far") < F.col("component")).alias("moved")).write.parquet(
            f"{base}/{step + 1}"
        )
        moved = spark.read.parquet(f"{base}/{step + 1}").filter("moved").limit(1).count()
        drop_path(spark, f"{base}/{step}")
        step += 1
        if not moved:
            drop_path(spark, f"{base}/edges")
            return spark.read.parquet(f"{base}/{step}").select("id", "component")
