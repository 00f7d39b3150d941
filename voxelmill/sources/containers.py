"""Files that hold several series of planes: LIF and ND2, as a plan of planes and then their pixels.

As with other sources the plan is read from the files' own tables without a pixel: series, place, size and micrometres a pixel
are columns to filter by. What is wanted of it is loaded by byte ranges; planes that a file should have but hasn't are zeros.
Whole plates of files are planned in parallel, a file by one task.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graph import cut
from ..functions.planes import lists, matrix, spread
from . import lif, nd2
from .sinks import headed
from .store import Ranges, replacing

ENDS = (".lif", ".nd2")
PLACE = "path string, series int, name string, dtype string, t int, m int, c int, z int, h int, w int, scale_x double, scale_y double, scale_z double"
PLAN = PLACE + ", stored boolean, spec string"
PLANES = PLACE + ", data array<double>"
ERRORS = (ValueError, struct.error, KeyError, zlib.error, OSError, IndexError)
TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def container_plan(spark: SparkSession, folder: str, on_error: str = "raise") -> DataFrame:
    """A row for each plane of each series of the LIF and ND2 files of a folder; m numbers the tiles of a mosaic, `stored` is false where the file lacks the plane.

    Null scales aren't known. With `on_error` "skip" files that can't be read give no rows. A file without series gives none either.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(ENDS) + "}").load(folder).select("path")
    schema = pa.schema([(c.split()[0], TYPES[c.split()[1]]) for c in PLAN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in itertools.chain.from_iterable(b.column("path").to_pylist() for b in batches):
            form = lif if path.lower().endswith(".lif") else nd2
            try:
                with Ranges(path) as read:
                    rows = ({**r, "path": path, "spec": json.dumps(r["spec"])} for r in form.plane_rows(read, read.size))
                    while some := list(itertools.islice(rows, 1024)):
                        yield pa.RecordBatch.from_pylist(some, schema)
            except ERRORS:
                if on_error != "skip":
                    raise

    return files.mapInArrow(run, PLAN)


def load_series(plan: DataFrame, on_error: str = "raise") -> DataFrame:
    """The planes of a plan's rows. Channels that are stored between each other are in one task, one after another, and their bytes are read once."""
    names = columns(PLANES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, b"")
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.slice(k, 1)
                row = {n: own.column(n)[0].as_py() for n in ("path", "dtype", "c", "h", "w", "stored", "spec")}
                row["spec"] = spec = json.loads(row["spec"])
                data = np.zeros((row["h"], row["w"]))
                try:
                    if row["stored"]:
                        key = row["path"], spec.get("chunk", spec.get("at"))
                        if held[0] != key:
                            with Ranges(row["path"]) as read:
                                held = key, nd2.frame(read, spec) if "chunk" in spec else read(spec["at"], spec["n"])
                        data = (nd2 if "chunk" in spec else lif).plane_of(held[1], row)
                except ERRORS:
                    if on_error != "skip":
                        raise
                    continue
                yield pa.RecordBatch.from_arrays([*[own.column(n) for n in names[:-1]], lists(data.reshape(1, -1))], names=names)

    frame = ["path", "series", "t", "m", "z"]
    return spread(plan, *frame).sortWithinPartitions(*frame, "c").mapInArrow(run, PLANES)


def read_series(spark: SparkSession, folder: str, series: int | None = None, on_error: str = "raise") -> DataFrame:
    """The planes of all series of a folder's files, or of those of one number."""
    plan = container_plan(spark, folder, on_error)
    return load_series(plan if series is None else plan.where(F.col("series") == series), on_error)


def write_series(planes: DataFrame, folder: str, name: str = "path", form: str = "lif", dtype: str = "uint16", scale: float = 1.0, packing: int = nd2.PLAIN) -> DataFrame:
    """Writes planes (name, series, t, c, z, h, w, data) as `{folder}/{name}.{form}`; returns (image, planes).

    A file is streamed by one task, which holds a frame at a time. Series are numbered from 0 without gaps; planes of an ND2 file are of one size, and its shorter series lack frames.
    """
    if form not in ("lif", "nd2"):
        raise ValueError(f"{form} isn't written")
    at = F.concat(F.lit(f"{folder.rstrip('/')}/"), F.regexp_replace(F.col(name).cast("string"), r"^.*/|\.[^./]*$", ""), F.lit(f".{form}"))
    rows = planes.select(at.alias("image"), *[F.col(a).cast("int").alias(a) for a in ("series", "t", "z", "c", "h", "w")], "data")
    most = [(F.max(a) + 1).alias(f"n{a}") for a in "tzc"]
    sizes = rows.groupBy("image", "series").agg(*most, F.max("h").alias("ah"), F.max("w").alias("aw"))
    whole = sizes.groupBy("image").agg(F.to_json(F.sort_array(F.collect_list(F.struct("series", "nt", "nz", "nc", F.col("ah").alias("h"), F.col("aw").alias("w"))))).alias("all"))  # a row a series
    order: Sequence[str] = ("series", "t", "z", "c") if form == "lif" else ("t", "series", "z", "c")
    ready = headed(rows, whole, order)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
        described = ""
        for batch in batches:
            for k in range(batch.num_rows):
                one = {n: batch.column(n)[k].as_py() for n in ("image", "all", *order, "h", "w")}
                if one["all"] is not None:
                    described = one["all"]
                else:
                    yield (one["image"], described), (*[one[a] for a in order], matrix(batch.column("data").slice(k, 1)).reshape(one["h"], one["w"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (image, described), group in itertools.groupby(each(batches), key=lambda r: r[0]):
            series = [{**s, "name": f"series {s['series']}", "scale": scale} for s in json.loads(described)]
            if [s["series"] for s in series] != list(range(len(series))):
                raise ValueError(f"{image}: series aren't numbered from 0")
            with replacing(image) as out:
                if form == "lif":
                    n = lif.write(out, series, (p for _, p in group), dtype)
                else:
                    if len({(s["h"], s["w"]) for s in series}) > 1:
                        raise ValueError(f"{image}: series are of several sizes")
                    n = nd2.write(out, {**series[0], **{a: max(s[a] for s in series) for a in ("nt", "nz", "nc")}, "ns": len(series)}, (p for _, p in group), dtype, packing)
            yield pa.RecordBatch.from_arrays([pa.array([image]), pa.array([n], pa.int64())], names=["image", "planes"])

    return cut(ready.mapInArrow(run, "image string, planes long"))
