"""A training corpus in five stages: each takes what the one before it kept, as Parquet.

Quality and language reject documents, one document of each near-duplicate class stays, documents with
benchmark windows go, and the sources are mixed to target weights.

Null texts count as empty: the quality stage scores them as a chunk of padding, and the language stage drops
them as `und`. Null ids are documents, which models don't learn from; null sources are one source. Of rows with equal
texts the near-duplicate stage keeps one, that with the smallest id, so repeated rows are one document from there on.
Documents may have more columns, of any name; all stay as they are. Empty tables of documents give an empty
corpus, an empty benchmark drops nothing, and without labels of both kinds every document has quality 0.5 and stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm.common import checkpoint_dir, held_out, read, remove
from voxelmill.llm.decontaminate import remove_leaks
from voxelmill.llm.language import filter_language, fit_language
from voxelmill.llm.mixing import mix
from voxelmill.llm.neardup import first_of_classes
from voxelmill.llm.quality import filter_quality, fit_quality

#: What the quality stage keeps scores this or more.
QUALITY = 0.3
#: Share of a document's letters that its language's spans must hold: documents in which no language has half go, and so do those without letters or of scripts that nobody learned.
LANGUAGE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network finds good; it learns from labels that op3_quality learns from."""
    return filter_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0)), QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language."""
    return filter_language(docs, fit_language(docs, ~held_out(F.col("doc_id"), 4, 2)), LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class."""
    return first_of_classes(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return remove_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: Stages 1 to 3 are learned or sampled; they are tested against held-out labels and brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; a table goes when the next one is there."""
    docs, folder = read(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
        if k:
            remove(spark, f"{folder}/{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
