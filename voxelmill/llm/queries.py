"""The queries of the text operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import CHAT_SQL, chat_query
from .common import read
from .decontaminate import DECONTAMINATE_SQL, decontaminate_query
from .fingerprint import edited_query
from .language import language_query
from .licenses import license_query
from .manifest import MANIFEST_SQL, manifest_query
from .mixing import mixing_query
from .neardup import neardup_query
from .quality import quality_query
from .search import SEARCH_SQL, search_query
from .toxicity import toxicity_query
from .urls import URL_SQL, url_query
from .warc import ARCHIVE_SQL, archive_query


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_query(read(spark, sf_dir, "conversations"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_query(read(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_query(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_query(read(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_query(read(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_query(read(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_query(read(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate_query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_query(read(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_query(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_toxicity, op2_chat, op3_quality, op4_neardup, op5_language, op6_mixing, op7_fingerprint, op8_urls, op9_warc, op10_decontaminate, op11_search, op12_manifest, op13_licenses)
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": CHAT_SQL, "op8_urls": URL_SQL, "op9_warc": ARCHIVE_SQL, "op10_decontaminate": DECONTAMINATE_SQL, "op11_search": SEARCH_SQL, "op12_manifest": MANIFEST_SQL}
