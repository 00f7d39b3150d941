"""Registered operators over a folder of images: what is read, in which form, and what is written follows from the operator's spec.

The plan of planes comes first. An operator's `wanted` leaves files out of it before any is opened for pixels. Operators that
only say which planes belong where (`loads` false) work on the plan itself, and planes are loaded once they have their
new place. What comes back is written as the operator's kind says, and the rows say from where to where.
"""

from __future__ import annotations

import inspect
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.planes import lists
from ..sources import arrays, sinks
from .registry import REGISTRY, Spec

PLACE = ("t", "c", "z")
DONE = "source string, image string, planes long"


def planes_like(pixels: DataFrame, plan: DataFrame, value: str) -> DataFrame:
    """Planes (path, t, c, z, h, w, data) of sparse pixels, with all planes that the plan has at their sizes; axes that the pixels lost are 0.

    A row for each plane of the plan goes along with the pixels, so that planes without any are there and no join is needed.
    """
    kept = [a for a in PLACE if a in pixels.columns]
    at = lambda df: [F.col(a).cast("int").alias(a) if a in kept else F.lit(0).alias(a) for a in PLACE]  # noqa: E731, ARG005
    sizes = plan.select("path", *at(plan), "h", "w").distinct().select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("y", "int"), ("x", "int"), ("v", "double"))])
    own = pixels.select("path", *at(pixels), *[F.lit(None).cast("int").alias(n) for n in "hw"], F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("double").alias("v"))

    def plane(table: pa.Table) -> pa.Table:
        h, w = (pc.max(table.column(n)).as_py() for n in "hw")
        out = np.zeros(h * w)
        some = table.filter(pc.is_valid(table.column("y")))
        out[some.column("y").to_numpy().astype(np.int64) * w + some.column("x").to_numpy()] = some.column("v").fill_null(0).to_numpy()
        first = [table.column(n).slice(0, 1).combine_chunks() for n in ("path", *PLACE)]
        return pa.table([*first, pa.array([h], pa.int32()), pa.array([w], pa.int32()), lists(out[None])], names=["path", *PLACE, "h", "w", "data"])

    return sizes.unionByName(own).groupBy("path", *PLACE).applyInArrow(plane, "path string, t int, c int, z int, h int, w int, data array<double>")


def arguments(spec: Spec, parameters: dict) -> dict:
    """An operator's parameters: those that were given, and the block that images of a folder have where it takes one."""
    own = inspect.signature(spec.func).parameters
    if unknown := set(parameters) - set(own):
        raise TypeError(f"{spec.name} has no parameters {sorted(unknown)}")
    axes = parameters.get("axes", ("y", "x"))
    given = {"block": ["path", *[a for a in PLACE if a not in axes]]} if "block" in own else {}
    return given | parameters


def process(spark: SparkSession, folder: str, out: str, name: str, form: str = "tif", dtype: str | None = None, on_error: str = "raise", **parameters) -> DataFrame:
    """(source, image, planes) of what a registered operator wrote to `out` from the images of a folder.

    Images and labels are files named as their sources with the operator's suffix, in `dtype` (else labels
    in uint32, others in uint16); tables of points or measurements are one Parquet table named by the suffix; operators that write themselves give paths; those without
    output give no rows.
    """
    spec = REGISTRY[name]
    own = arguments(spec, parameters)
    first = next(iter(inspect.signature(spec.func).parameters))
    plan = arrays.plane_plan(spark, folder, on_error=on_error)
    if spec.wanted:
        known = {k: v for k, v in own.items() if k in inspect.signature(spec.wanted).parameters}
        files = sinks.catalog(spark, folder).select("path")
        plan = plan.join(spec.wanted(files, **known).select("path").distinct(), "path", "left_semi")
    if not spec.loads:
        own = ({"basename": ""} if "basename" in inspect.signature(spec.func).parameters else {}) | own
        placed = spec.func(plan.withColumn("source", F.col("path")), **own)
        image = F.concat(stem(F.col("path")), F.col("file")) if "file" in placed.columns else stem(F.col("path"))
        placed = placed.withColumns({"image": image, **{a: F.lit(0) for a in PLACE if a not in placed.columns}}).withColumn("path", F.col("source")).select(*plan.columns, "image")
        return write(arrays.load_planes(placed, on_error).withColumn("path", F.col("image")), placed.select("image", "path"), out, spec, form, dtype)
    planes = arrays.load_planes(plan, on_error)
    given = planes if first == "planes" else arrays.pixels_of(planes)
    given = given.withColumnRenamed("v", "label") if first == "labels" else given
    found = spec.func(given, **own)
    if spec.kind == "none":
        return spark.createDataFrame([], DONE)
    if spec.kind == "path":
        return found.select(F.lit(None).cast("string").alias("source"), F.col("image"), F.lit(None).cast("long").alias("planes"))
    if spec.kind == "table":
        where = f"{out.rstrip('/')}/{spec.suffix.lstrip('_')}"
        found.write.mode("overwrite").parquet(where)
        return spark.read.schema(found.schema).parquet(where).groupBy(F.col("path").alias("source")).agg(F.lit(where).alias("image"), F.lit(None).cast("long").alias("planes"))
    if "data" not in found.columns:
        found = planes_like(found, plan, "label" if "label" in found.columns else "v")
    return write(found, plan.select(stem(F.col("path")).alias("image"), "path"), out, spec, form, dtype)


def stem(path: Column) -> Column:
    """A file's name without its end."""
    return F.regexp_replace(path, r"^.*/|\.[^./]*$", "")


def write(planes: DataFrame, names: DataFrame, out: str, spec: Spec, form: str, dtype: str | None) -> DataFrame:
    """Writes planes by their path; names (image, path) says which file an image is from, the first of several."""
    labels = "label" in spec.suffix or next(iter(inspect.signature(spec.func).parameters)) == "labels"
    done = sinks.write_images(planes.select("path", *PLACE, "h", "w", "data"), out, "path", dtype or ("uint32" if labels else "uint16"), form, spec.suffix)
    sources = names.groupBy(F.concat("image", F.lit(spec.suffix)).alias("__name")).agg(F.min("path").alias("source"))
    return done.withColumn("__name", stem(F.col("image"))).join(sources, "__name").select("source", "image", "planes")


def left(spark: SparkSession, folder: str, done: DataFrame, ends: Sequence[str] = arrays.ENDS) -> DataFrame:
    """(path) of the images of a folder that nothing was written from: what a run that was cut short has to do."""
    files = sinks.select_files(sinks.catalog(spark, folder), ends)
    return files.join(done.select(F.col("source").alias("path")).distinct(), "path", "left_anti").select("path")
