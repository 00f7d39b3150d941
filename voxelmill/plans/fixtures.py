"""Image relations derived from the driver's tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_of(e):
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.5) * 255))).cast("int")


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 planes (image_id, h, w, data) from embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("embedding", lambda e: byte_of(e).cast("double")).alias("data"))


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 8x8 images (image_id, y, x, v)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "e"))
    return e.select("image_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), byte_of(F.col("e")).alias("v"))


def lbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of `px` with quadrant labels 1 to 4 where v >= 140, else 0."""
    quadrant = 1 + F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)
    return px(spark, sf_dir).withColumn("label", F.when(F.col("v") >= 140, quadrant).otherwise(0).cast("int"))


def mov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse TYX movie of 30 frames of 24x16 (t, y, x, v, label)."""
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4).otherwise(5)
    keyed = e.select((F.day("ts") - 1).alias("t"), F.hour("ts").alias("y"), (F.col("user_id") % 16).cast("int").alias("x"), "value", code.alias("k"))
    return keyed.groupBy("t", "y", "x").agg(F.floor(F.max("value")).cast("int").alias("v"), F.min("k").alias("label"))


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse voxels (image_id, t, z, y, x, v) with three label channels c1, c2, c3."""
    li = table(spark, sf_dir, "lineitem")
    keyed = li.select((F.col("l_suppkey") % 10).alias("image_id"), F.col("l_linenumber").alias("t"), (F.col("l_partkey") % 8).alias("z"), (F.col("l_orderkey") % 64).alias("y"),
                      (F.floor(F.col("l_orderkey") / 64) % 64).alias("x"), "l_quantity", "l_partkey")
    least = F.min("l_partkey")
    return keyed.groupBy("image_id", "t", "z", "y", "x").agg(F.floor(F.max("l_quantity")).cast("int").alias("v"), (least % 7).alias("c1"), (least % 5).alias("c2"), (least % 3).alias("c3"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names (path) of samples with channels, labels and masks, from document ids."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    stem = F.concat(F.lit("Sample_"), F.floor(F.col("doc_id") / 4).cast("string"))
    k = F.col("doc_id") % 4
    end = F.when(k == 0, F.lit(".tif")).when(k == 1, F.lit("_labels.tif")).when(k == 2, F.lit("_channel_1.tif")).otherwise(F.lit("_channel_12.tif"))
    return d.select(F.concat(stem, end).alias("path"))


PX = """px AS (SELECT vec_id AS image_id, p // 8 AS y, p % 8 AS x, CAST(greatest(0, least(255, floor((e::DOUBLE + 0.5::DOUBLE) * 255))) AS INT) AS v
  FROM (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding) AS e FROM embeddings))"""
LBL = PX + ", lbl AS (SELECT *, CAST(CASE WHEN v >= 140 THEN 1 + (y // 4) * 2 + (x // 4) ELSE 0 END AS INT) AS label FROM px)"
MOV = """mov AS (SELECT day(ts) - 1 AS t, hour(ts) AS y, user_id % 16 AS x, CAST(floor(max(value)) AS INT) AS v,
  min(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END) AS label
  FROM events GROUP BY day(ts) - 1, hour(ts), user_id % 16)"""
VOX = """vox AS (SELECT l_suppkey % 10 AS image_id, l_linenumber AS t, l_partkey % 8 AS z, l_orderkey % 64 AS y, (l_orderkey // 64) % 64 AS x,
  CAST(floor(max(l_quantity)) AS INT) AS v, min(l_partkey) % 7 AS c1, min(l_partkey) % 5 AS c2, min(l_partkey) % 3 AS c3
  FROM lineitem GROUP BY l_suppkey % 10, l_linenumber, l_partkey % 8, l_orderkey % 64, (l_orderkey // 64) % 64)"""
FILES = """files AS (SELECT 'Sample_' || (doc_id // 4) || CASE doc_id % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '_labels.tif' WHEN 2 THEN '_channel_1.tif' ELSE '_channel_12.tif' END AS path FROM documents)"""
