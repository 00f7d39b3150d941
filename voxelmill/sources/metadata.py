"""What is known of OME-Zarr images beside their pixels, as a table: read in tasks, joined to what operators made, written with it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graph import cut, remove
from .sinks import label_dtype
from .store import read_whole, replacing, settle, swap
from .zarr import attributes_of, described, level_scale, write_zarr

WINDOW = "struct<min: double, max: double, start: double, end: double>"


def image_catalog(spark: SparkSession, images: Sequence[str] | DataFrame) -> DataFrame:
    """(path, axes, dtype, shape, levels, scales, windows) of images: the scale along each axis of every level, the display window of every channel that has one.

    images: paths, or a table with a column `path`. No pixel is read.
    """
    paths = images if isinstance(images, DataFrame) else spark.createDataFrame([(p,) for p in images], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                attributes = attributes_of(path)
                levels = max(1, len((attributes.get("multiscales") or [{}])[0].get("datasets", [])))
                own = [described(path, k) for k in range(levels)]
                windows = [c["window"] for c in attributes.get("omero", {}).get("channels", []) if "window" in c]
                rows.append({
                    "path": path, "axes": own[0]["axes"], "dtype": np.dtype(own[0]["dtype"]).name, "shape": own[0]["shape"], "levels": levels,
                    "scales": json.dumps([d["scale"] for d in own]), "windows": json.dumps(windows),
                })
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.string()]
            names = ["path", "axes", "dtype", "shape", "levels", "scales", "windows"]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds, strict=True))))

    found = paths.select("path").mapInArrow(run, "path string, axes string, dtype string, shape array<int>, levels int, scales string, windows string")
    return found.withColumns({"scales": F.from_json("scales", "array<map<string, double>>"), "windows": F.from_json("windows", f"array<{WINDOW}>")})


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/|\.[^./]*$", "")


def without_axes(catalog: DataFrame, gone: str) -> DataFrame:
    """The catalog of what operators make that take axes away: scales go by name, so those of the other axes stay theirs."""
    return catalog.withColumns({"axes": F.translate("axes", gone, ""), "scales": F.transform("scales", lambda s: F.map_filter(s, lambda a, _: ~F.lit(gone).contains(a)))})


def replace_zarr(planes: DataFrame, folder: str, **how) -> DataFrame:
    """`write_zarr` beside what is there; each image takes its place when it is whole. (image, planes).

    A job that fails leaves all images that it replaces as they were. One that is cut short while an image is put in its
    place leaves that one to `restore`.
    """
    spark, folder = planes.sparkSession, folder.rstrip("/")
    draft = f"{folder}/_draft-{uuid.uuid4()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [f"{folder}/{p.rsplit('/', 1)[1]}" for p in batch.column("image").to_pylist()]
            for new, image in zip(batch.column("image").to_pylist(), images, strict=True):
                swap(new, image)
            yield pa.RecordBatch.from_arrays([pa.array(images), batch.column("planes")], names=["image", "planes"])

    try:
        return cut(write_zarr(planes, draft, **how).mapInArrow(run, "image string, planes long"))
    finally:
        remove(spark, draft)


def restore(folder: str, names: Sequence[str]) -> None:
    """Puts back what a job that was cut short had put aside, or takes it away if the new image is there."""
    for name in names:
        settle(f"{folder.rstrip('/')}/{name.removesuffix('.old')}")


def write_labels_like(labels: DataFrame, sources: DataFrame, folder: str, suffix: str = "_labels", chunk: int = 512, version: int = 3, gone: str = "") -> DataFrame:
    """Label planes (path, t, c, z, h, w, data) as `{name}{suffix}.zarr` with the axes, scales and levels of the images that they were made from.

    sources: an `image_catalog`; gone: axes that the operator took away. Labels are uint32, or uint64 where those don't do; images
    of the same name are replaced, and labels of images that the catalog lacks have all axes and one level.
    """
    like = without_axes(sources, gone) if gone else sources
    like = like.select(F.concat(stem(F.col("path")), F.lit(suffix)).alias("name"), "axes", "levels", "scales", F.lit(None).cast(f"array<{WINDOW}>").alias("windows"))
    named = labels.withColumn("__name", F.concat(stem(F.col("path")), F.lit(f"{suffix}.zarr")))
    return replace_zarr(named, folder, name="__name", dtype=label_dtype(labels), chunk=chunk, version=version, like=like)


def patch_metadata(images: DataFrame) -> DataFrame:
    """Writes scales and display windows into the metadata of images that are there; (path, levels).

    images (path, scale map, windows array of WINDOW): of the scale, that of the first level, the other levels' follow; axes it lacks
    and null windows stay as they are.
    """
    rows = images.select("path", F.to_json("scale").alias("scale"), F.to_json("windows").alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                new = (raw := read_whole(f"{r['path']}/zarr.json")) is not None
                file = json.loads(raw if new else read_whole(f"{r['path']}/.zattrs") or b"{}")
                holder = file.get("attributes", {}) if new else file
                ome = holder.get("ome", holder)
                scales = ome["multiscales"][0]
                axes = "".join(a["name"] if isinstance(a, dict) else a for a in scales["axes"])
                first = described(r["path"])["scale"] | json.loads(r["scale"] or "{}")
                for k, d in enumerate(scales["datasets"]):
                    others = [t for t in d.get("coordinateTransformations", []) if t.get("type") != "scale"]
                    d["coordinateTransformations"] = [{"type": "scale", "scale": level_scale([first], k, axes)}, *others]
                if r["windows"]:
                    channels = ome.setdefault("omero", {}).setdefault("channels", [])
                    windows = json.loads(r["windows"])
                    channels.extend({} for _ in range(len(windows) - len(channels)))
                    for channel, window in zip(channels, windows, strict=False):
                        channel["window"] = window
                with replacing(f"{r['path']}/{'zarr.json' if new else '.zattrs'}") as out:
                    out.write(json.dumps(file).encode())
                done.append((r["path"], len(scales["datasets"])))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], names=["path", "levels"])

    return cut(rows.mapInArrow(run, "path string, levels int"))
