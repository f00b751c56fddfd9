"""Intermediate tables in the shared folder, and connected components over DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import shared_dir


#: Spark removes the shuffle files of an execution at its end where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one operator run. put() writes a table and reads it back, which cuts its lineage; drop() removes it.

    Shuffle files of a written table's plan go as soon as it is written. Tables that the returned DataFrame reads stay in the
    shared folder, which the cluster cleans; the others are dropped when no later step needs them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable by the undirected edges (a, b), for every node on an edge.

    Labels go along the edges and then jump to the label of their label, so that the rounds grow with the logarithm of the
    longest path. Sums by key are pre-aggregated, and the joins read both sides from exchanges, so that adaptive execution can
    split a hub's rows. Each round is written to the shared folder.
    """
    both = scratch.put(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a")).where("src <> dst").distinct(), f"{name}-edges")
    labels = scratch.put(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels, both.src == labels.node).groupBy("dst").agg(F.min("label").alias("m"))
        moved = scratch.put(labels.join(near, labels.node == near.dst, "left").select("node", "label", F.least("label", "m").alias("next")), f"{name}-near-{k}")
        hop = moved.select(F.col("node").alias("at"), F.col("next").alias("hop"))
        now = scratch.put(moved.join(hop, moved.next == hop["at"], "left").select("node", F.least("next", "hop").alias("label"), (F.least("next", "hop") < F.col("label")).alias("changed")), f"{name}-{k}")
        scratch.drop(f"{name}-near-{k}", f"{name}-{k - 1}")
        labels = now.select("node", "label")
        if now.where("changed").isEmpty():
            return labels.withColumnRenamed("label", "component")
