"""Connected components of edge tables, with lineage cut by tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set a local session, as of tests, gets a temporary one; a cluster has no folder of its own to share."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxelmill-checkpoint-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one job in the shared folder, as Parquet: plans don't grow, lost executors lose nothing, and Spark knows their sizes.

    What a job no longer needs it drops; what its result is read from stays.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{checkpoint_dir(spark)}/voxelmill-{uuid.uuid4()}"
        self.paths: list[tuple[DataFrame, str]] = []

    def cut(self, df: DataFrame) -> DataFrame:
        """The same rows from a table that is written now."""
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df, path in self.paths:
            if any(df is t for t in tables):
                remove(self.spark, path)

    def keep(self, *tables: DataFrame) -> None:
        """Drops all other tables."""
        self.drop(*[df for df, _ in self.paths if not any(df is t for t in tables)])


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder."""
    return Scratch(df.sparkSession).cut(df)


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of `edges` (a, b): the smallest node of the component of each.

    Every round takes the smallest label around each node, then the label of that label, so a round
    doubles the distance that labels have come. Tables of rounds before are removed.
    """
    scratch = Scratch(edges.sparkSession)
    both = scratch.cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = before = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        less = scratch.cut(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")))
        onward = less.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = scratch.cut(less.join(onward, "label").select("node", F.least("label", "next").alias("label"), "was"))
        done = moved.where("label <> was").isEmpty()
        scratch.drop(before, less, *([both] if done else []))
        labels, before = moved.select("node", "label"), moved
        if done:
            return labels
