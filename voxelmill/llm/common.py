"""What the text operators share: Arrow text access, labelled samples, lineage cuts."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graph import Scratch, checkpoint_dir, cut, remove  # noqa: F401  for the operators beside this module

TEXT = "__text"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of text that a kernel gets at a time.
BLOCK = 1 << 18


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(key: Column, mod: int, rest: int) -> Column:
    """True where crc32(key as text) mod `mod` is `rest`; a null key counts as held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % mod == rest, F.lit(True))


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def hashable(docs: DataFrame) -> list[Column]:
    """The columns that Spark can hash: all but those with a map or a variant in them."""
    return [quoted(f.name) for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end and the offsets of its rows; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def small_batches(spark: SparkSession) -> None:
    """Batches of a few MB between Spark and Python from here on, unless the session asks for smaller ones.

    Spark reads this when a plan runs, which may be long after it was made, so the setting stays.
    """
    now = spark.conf.get(BATCH_BYTES)
    if not now.isdigit() or int(now) > 4 << 20:
        spark.conf.set(BATCH_BYTES, str(4 << 20))


def map_text(docs: DataFrame, keep: Sequence[str], text: str, kernel: Callable, fields: Sequence[T.StructField], block: int = BLOCK) -> DataFrame:
    """The `keep` columns of each row beside what `kernel` makes of its text.

    kernel(data, offsets) gets the bytes of up to about `block` bytes of rows and returns one sequence
    for each of `fields`. Only `keep` and the text column are read, so other columns may have any name.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in keep] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in batches:
            if not batch.num_rows:
                continue
            from pyspark.sql.pandas.types import to_arrow_type

            types = types or [to_arrow_type(f.dataType) for f in fields]
            data, off = utf8(batch.column(len(keep)))
            for i, j in blocks(off, block):
                made = kernel(data[off[i] : off[j]], off[i : j + 1] - off[i])
                own = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(own + [pa.array(v, type=t) for v, t in zip(made, types, strict=True)], names=[f.name for f in schema])
        gc.collect()  # the task's functions and their tables are a cycle that would stay in the worker

    return docs.select(*[quoted(c).alias(f"k{n}") for n, c in enumerate(keep)], quoted(text).alias(TEXT)).mapInArrow(run, schema)


def filter_text(docs: DataFrame, text: str, keeps: Callable, block: int = BLOCK) -> DataFrame:
    """The rows for whose text `keeps(data, offsets)` is true, with all their columns as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, off = utf8(batch.column(at))
            mask = np.concatenate([np.asarray(keeps(data[off[i] : off[j]], off[i : j + 1] - off[i]), bool) for i, j in blocks(off, block)])
            yield batch.filter(pa.array(mask))
        gc.collect()

    plain = T.StructType([T.StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(docs.schema)])
    return docs.toDF(*plain.names).mapInArrow(run, plain).toDF(*docs.columns)  # names with dots don't pass otherwise


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, seed: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, y) of at most `per_class` documents of either label that satisfy `learn`.

    The ids with the smallest seeded hashes are taken, so reruns and any partitioning agree. A document
    with conflicting labels counts as 1; of repeated ids the greatest text is used. The ids are at most
    2 * per_class, so that side of the join is broadcast.
    """
    ids = labels.where(learn & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    ids = ids.withColumn("__h", F.xxhash64(F.lit(seed), "__id"))
    each = [ids.where(F.col("y") == y).orderBy("__h", "__id").limit(per_class) for y in (0, 1)]
    chosen = each[0].unionByName(each[1]).drop("__h")
    found = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id")
    return found.groupBy("__id", "y").agg(F.max("text").alias("text"))
