"""Writers: planes and labels as Parquet, TIFF or NumPy files, tables as CSV, image metadata as JSON columns. OME-Zarr is in `sources.zarr`."""

from __future__ import annotations

import io
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.graph import cut
from ..functions.planes import matrix
from ..plans.catalog import label_type
from . import tiff
from .store import replacing

#: Fixed value: the part of OME metadata that holds the scales of the levels.
OME = "multiscales array<struct<axes: array<struct<name: string, unit: string>>, datasets: array<struct<path: string, coordinateTransformations: array<struct<type: string, scale: array<double>>>>>>>"


def write_planes(planes: DataFrame, path: str, partition_by: Sequence[str] = (), level: int = 3) -> None:
    """Parquet with Zstandard, a folder for each value of the partition columns; what is there is replaced at the end."""
    out = planes.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level))
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def image_names(planes: DataFrame, folder: str, name: str, end: str) -> Column:
    stem = F.regexp_replace(F.col(name).cast("string"), r"^.*/|\.[^./]*$", "")
    return F.concat(F.lit(f"{folder.rstrip('/')}/"), stem, F.lit(end))


def label_dtype(planes: DataFrame, source: str = "uint32") -> str:
    """The type that label planes are written with: that of their source if it holds the largest label."""
    return label_type(int(planes.agg(F.max(F.array_max("data"))).first()[0] or 0), source)


def select_files(files: DataFrame, ends: Sequence[str], path: str = "path") -> DataFrame:
    """The files whose names end with one of `ends`, in any case."""
    chosen = F.lit(False)
    for e in ends:
        chosen = chosen | F.lower(path).endswith(e.lower())
    return files.where(chosen)


def write_labels(planes: DataFrame, folder: str, name: str = "path", source: str = "uint32", suffix: str = "_labels") -> DataFrame:
    """Label planes as TIFF files `{name}{suffix}.tif`, in the narrowest type that holds all labels, with the axes' sizes."""
    return write_images(planes, folder, name, label_dtype(planes, source), end=suffix)


def headed(rows: DataFrame, heads: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of images (image, ...) in order, all of an image in one partition, after a row of `heads` (image, ...) that tells of the whole image.

    Heads come as rows and by a hash of the name: after a join by the name Spark leaves out a repartition by it, and what it then
    reads by mappers splits images; and a column that is joined on is repeated with every plane.
    """
    both = rows.unionByName(heads, allowMissingColumns=True)
    return both.repartition(F.xxhash64("image")).sortWithinPartitions("image", *[F.col(c).asc_nulls_first() for c in order])


def write_images(planes: DataFrame, folder: str, name: str = "path", dtype: str = "uint16", form: str = "tif", end: str = "") -> DataFrame:
    """Writes planes (name, t, c, z, h, w, data) as one TIFF or .npy file an image and returns (image, planes) of what was written.

    Planes follow each other in order of t, z and c; a task writes an image from front to back with one plane in memory.
    TIFF pages carry the sizes of the axes. Files take their names when they are whole.
    """
    kind = np.dtype(dtype)
    image = image_names(planes, folder, name, f"{end}.{form}")
    rows = planes.select(image.alias("image"), *[F.col(a).cast("int").alias(a) for a in "tzc"], F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "data")
    sizes = rows.groupBy("image").agg(*[F.count_distinct(a).cast("int").alias(f"n{a}") for a in "tzc"])
    sorted_rows = headed(rows, sizes, ("t", "z", "c"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
        counts: tuple = ()
        for batch in batches:
            for k in range(batch.num_rows):
                image, t, h, w = (batch.column(n)[k].as_py() for n in ("image", "t", "h", "w"))
                if t is None:
                    counts = tuple(batch.column(n)[k].as_py() for n in ("nt", "nz", "nc"))
                else:
                    yield (image, *counts, h, w), matrix(batch.column("data").slice(k, 1)).reshape(h, w).astype(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, group in itertools.groupby(each(batches), key=lambda r: r[0]):
            path, shape = own[0], (*own[1:4], *own[4:])
            with replacing(path) as out:
                if form == "npy":
                    head = io.BytesIO()
                    np.lib.format.write_array_header_2_0(head, {"descr": kind.str, "fortran_order": False, "shape": tuple(n for k, n in enumerate(shape) if n > 1 or k > 2)})
                    out.write(head.getvalue())
                    n = sum(out.write(p.tobytes()) is None or 1 for _, p in group)
                else:
                    n = tiff.write_pages(out, (p for _, p in group), f"ImageJ=\nimages={int(np.prod(shape[:3]))}\nframes={shape[0]}\nslices={shape[1]}\nchannels={shape[2]}\n")
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["image", "planes"])

    return cut(sorted_rows.mapInArrow(run, "image string, planes long"))


def write_frames(pixels: DataFrame, path: str) -> None:
    """A folder for each `file` of split_timepoints or split_channels."""
    pixels.write.mode("overwrite").partitionBy("file").option("compression", "zstd").parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", first: Sequence[str] = ()) -> None:
    """CSV with a header; columns named in `first` come first."""
    rest = [c for c in df.columns if c not in first]
    df.select(*[c for c in first if c in df.columns], *rest).write.mode(mode).option("header", "true").csv(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key the CSV doesn't have yet, so a run that was cut short goes on; the number of rows added."""
    try:
        have = df.sparkSession.read.option("header", "true").csv(path).select(F.col(key).cast("string").alias("__key")).distinct()
        df = df.join(have, F.col(key).cast("string") == F.col("__key"), "left_anti")
    except AnalysisException:
        pass
    added = df.count()
    if added:
        write_table(df, path, "append")
    return added


def ome_scale(json: Column) -> Column:
    """The scale of the first level by axis name, from OME metadata; null without any."""
    first = F.from_json(json, OME)["multiscales"][0]
    scale = F.filter(first["datasets"][0]["coordinateTransformations"], lambda t: t["type"] == "scale")[0]["scale"]
    return F.map_from_arrays(F.transform(first["axes"], lambda a: a["name"]), scale)


def czi_scale(xml: str, axis: str) -> Column:
    """Micrometres a pixel along an axis from scaling metadata in metres; null outside of 0.01 to 100."""
    text = F.xpath_string(xml, F.lit(f'//Scaling/Items/Distance[@Id="{axis}"]/Value/text()'))
    value = text.try_cast("double") * 1e6
    return F.when(value.between(0.01, 100), value)


def czi_scales(images: DataFrame, xml: str = "xml") -> DataFrame:
    """`images` with scale_x, scale_y and scale_z in micrometres."""
    return images.withColumns({f"scale_{a.lower()}": czi_scale(xml, a) for a in "XYZ"})


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """(path, folder, name, size) of all files below a folder, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"))
