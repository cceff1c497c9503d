"""Graphs of rules: degrees, hubs, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that executors share, spark.checkpoint.dir; where that is unset a temporary one in local mode, else an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corvella-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write rows to the folder that executors share and read them back, to cut a loop's lineage."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of an edge list (a, b)."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) with the least node of each component as its root.

    Each round every node takes the least label around it and then that label's own label, so labels travel twice as far
    every time; rounds grow with the logarithm of the longest path.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_m"))
        near = labels.join(around, "node").select("node", F.least("root", "_m").alias("root"))
        jump = near.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        after = stored(near.join(jump, "root", "left").select("node", F.least("root", F.coalesce("_next", "root")).alias("root")))
        if after.join(labels.withColumnRenamed("root", "_old"), "node").where("root <> _old").isEmpty():
            return after
        labels = after
