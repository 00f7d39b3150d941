"""Folders that images keep arriving in, as Structured Streaming: each file is dealt with once.

The checkpoint takes the place of lists of files that were done: a query that is started again goes on
where it was, and files that were written before it was stopped aren't read twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.regions import regionprops


def arriving(spark: SparkSession, folder: str, like: DataFrame, per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files of planes or pixels that come to a folder, with the columns of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def run_arriving(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs an operator on each batch of arriving images and appends its rows under the batch's number.

    Images come whole, so an operator that deals with each on its own gives what it would on all at once. A
    batch that is done again after a failure replaces its own rows.
    """

    def one(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_sizes(stream: DataFrame, label: str = "label") -> DataFrame:
    """(image_id, label, size, total) of all labelled pixels so far; for complete or update mode."""
    return stream.where(F.col(label) > 0).groupBy("image_id", F.col(label).alias("label")).agg(F.count("*").alias("size"), F.sum("v").alias("total"))


def regions_of_arriving(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Region properties of each arriving labelled image."""
    return run_arriving(stream, lambda batch: regionprops(batch), out, checkpoint)
