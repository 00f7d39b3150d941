"""Image files to planes: NumPy arrays and TIFF, page by page.

A plan of planes comes first: a row for each YX plane of each file, from the files' heads and tables of contents,
without pixels. What is wanted of it is loaded by ranges of bytes, so files of any size are spread over tasks and
a single plane is read alone. OME-Zarr is in `sources.zarr`.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.planes import lists, spread
from ..plans.catalog import loop_axes, resolve_axes
from . import tiff
from .store import Ranges

ENDS = (".npy", ".tif", ".tiff")
PLAN = "path string, axes string, dtype string, t int, c int, z int, h int, w int, spec string"
SCHEMA = "path string, axes string, dtype string, t int, c int, z int, h int, w int, data array<double>"
ERRORS = (ValueError, struct.error, KeyError, zlib.error, OSError, OverflowError)


def npy_planes(read: Ranges, hint: str | None) -> Iterator[tuple[str, str, dict, int, int, dict]]:
    """(axes, type, place, h, w, spec) of each plane of a .npy file."""
    head = io.BytesIO(read(0, min(read.size, 1 << 16)))
    version = np.lib.format.read_magic(head)
    shape, backwards, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if kind.hasobject:
        raise ValueError("arrays of objects aren't read")
    sizes = [n for n in shape if n != 1] if len(shape) > 2 else list(shape)  # axes of one element tell nothing
    axes = resolve_axes(sizes, hint)
    outer = [a for a in axes if a not in "YX"]
    plain = not backwards and axes.endswith("YX")
    h, w = sizes[axes.index("Y")], sizes[axes.index("X")]
    for k, place in enumerate(np.ndindex(*[sizes[axes.index(a)] for a in outer])):
        spec = {"npy": kind.str, "at": head.tell() + k * h * w * kind.itemsize if plain else 0}
        if not plain:
            spec |= {"shape": sizes, "backwards": bool(backwards), "axes": axes, "place": place, "at": head.tell()}
        yield "".join(outer) + "YX", kind.name, dict(zip(outer, place, strict=True)), h, w, spec


def tiff_planes(read: Ranges, hint: str | None) -> Iterator[tuple[str, str, dict, int, int, dict]]:
    """(axes, type, place, h, w, spec) of each sample of each page of a TIFF file."""
    found = list(tiff.pages(read))
    stated, sizes = tiff.hyperstack(found[0]["description"])
    samples, n = found[0]["samples"], len(found)
    if any((p["h"], p["w"], p["samples"]) != (found[0]["h"], found[0]["w"], samples) for p in found):
        raise ValueError("pages of several sizes aren't one image")
    if stated and int(np.prod(sizes)) == n and samples == 1 and not hint:
        axes, sizes = stated + "YX", list(sizes)
    else:
        sizes = [m for m in (n, samples) if m > 1] or [1]
        shape = [*([] if n == 1 else [n]), *([samples] if samples > 1 else []), found[0]["h"], found[0]["w"]]
        axes = resolve_axes(shape, hint, "CYX" if samples > 1 and n == 1 else None)
    for k in range(n * samples):
        page = found[k // samples]
        place = dict(zip(axes[:-2], np.unravel_index(k, sizes), strict=True)) if len(axes) > 2 else {}
        spec = {**{x: page[x] for x in ("h", "w", "samples", "planar", "compression", "predictor", "dtype", "th", "tw", "offsets", "counts", "ycc", "tables")}, "sample": k % samples}
        yield axes, np.dtype(page["dtype"]).newbyteorder("=").name, {a: int(i) for a, i in place.items()}, page["h"], page["w"], spec


def plane_plan(spark: SparkSession, folder: str, ends: Sequence[str] = ENDS, recursive: bool = True, axes: str | None = None, on_error: str = "raise") -> DataFrame:
    """(path, axes, dtype, t, c, z, h, w, spec): the planes of the files of a folder, of which nothing is loaded; axes that a file lacks are 0.

    Take the rows that are wanted, then `load_planes`. With `on_error` "skip" files that can't be read give no rows.
    """
    glob = "*{" + ",".join(ends) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(folder).select("path")
    names = [c.split()[0] for c in PLAN.split(", ")]
    schema = pa.schema(list(zip(names, [pa.string()] * 3 + [pa.int32()] * 5 + [pa.string()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                try:
                    with Ranges(path) as read:
                        for order, kind, at, h, w, spec in (npy_planes if path.lower().endswith(".npy") else tiff_planes)(read, axes):
                            rows.append(dict(zip(names, (path, order, kind, at.get("T", 0), at.get("C", 0), at.get("Z", 0), h, w, json.dumps(spec)), strict=True)))
                except ERRORS:
                    if on_error != "skip":
                        raise
                    continue
                for lo in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_pylist(rows[lo : lo + 1024], schema)

    return files.mapInArrow(run, PLAN)


def one_plane(read: Ranges, spec: dict, h: int, w: int) -> np.ndarray:
    if "npy" not in spec:
        return tiff.page_sample(read, spec, spec["sample"])
    kind = np.dtype(spec["npy"])
    if "shape" not in spec:
        return np.frombuffer(read(spec["at"], h * w * kind.itemsize), kind).reshape(h, w)
    n = int(np.prod(spec["shape"]))
    whole = np.frombuffer(read(spec["at"], n * kind.itemsize), kind).reshape(spec["shape"], order="F" if spec["backwards"] else "C")
    outer = [spec["axes"].index(a) for a in spec["axes"] if a not in "YX"]
    return whole.transpose([*outer, spec["axes"].index("Y"), spec["axes"].index("X")])[tuple(spec["place"])]


def load_planes(plan: DataFrame, on_error: str = "raise") -> DataFrame:
    """(path, axes, dtype, t, c, z, h, w, data) of a plan's rows, dealt anew so that the planes of one file are spread; a task holds one plane at a time.

    Columns that a plan has beside its own come before the data.
    """
    names = [*[c for c in plan.columns if c != "spec"], "data"]
    loaded = T.StructType([*[plan.schema[c] for c in names[:-1]], T.StructField("data", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                h, w = row.column("h")[0].as_py(), row.column("w")[0].as_py()
                try:
                    with Ranges(row.column("path")[0].as_py()) as read:
                        data = one_plane(read, json.loads(row.column("spec")[0].as_py()), h, w)
                except ERRORS:
                    if on_error != "skip":
                        raise
                    continue
                yield pa.RecordBatch.from_arrays([*[row.column(n) for n in names[:-1]], lists(data.reshape(1, -1))], names=names)

    return spread(plan, "path", "t", "c", "z").mapInArrow(run, loaded)


def read_planes(spark: SparkSession, folder: str, ends: Sequence[str] = ENDS, recursive: bool = True, axes: str | None = None, on_error: str = "raise") -> DataFrame:
    """(path, axes, dtype, t, c, z, h, w, data) of the image files in a folder; axes that a file lacks are 0.

    With `on_error` "skip" files and planes that can't be decoded give no rows; `conversion_report` lists files without any.
    """
    return load_planes(plane_plan(spark, folder, ends, recursive, axes, on_error), on_error)


def conversion_report(spark: SparkSession, folder: str, planes: DataFrame, ends: Sequence[str] = ENDS) -> DataFrame:
    """(path, status, planes, at): success or failed for each image file of a folder, skipped for other files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    read = planes.groupBy("path").agg(F.count("*").alias("planes"))
    known = F.lit(False)
    for e in ends:
        known = known | F.lower("path").endswith(e)
    status = F.when(~known, "skipped").when(F.col("planes").isNull(), "failed").otherwise("success")
    return files.join(read, "path", "left").select("path", status.alias("status"), F.coalesce("planes", F.lit(0)).alias("planes"), F.current_timestamp().alias("at"))


def pixels_of(planes: DataFrame) -> DataFrame:
    """(path, t, c, z, y, x, v) of planes."""
    out = planes.select("path", "t", "c", "z", "w", F.posexplode("data").alias("p", "v"))
    return out.select("path", "t", "c", "z", F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).alias("x"), "v")


def block_columns(axes: str, spatial: int = 3) -> tuple[list[str], list[str]]:
    """The columns that blocks of images with these axes are told apart by, and those of a block's own axes."""
    loop, space = loop_axes(axes, spatial)
    return ["path", *loop], space
