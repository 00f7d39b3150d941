"""Whole slides (.ndpi, .svs, pyramids in .tif): levels as series, of which tiles are read and regions put together.

A level of a slide doesn't fit a task, so the plan has a row for each tile of each level, from the pages' tables alone; a region of a level
takes the tiles that it touches. `sources.arrays` reads pages of one size as planes.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graph import cut
from ..functions.planes import lists, matrix
from . import tiff
from .store import Ranges, replacing

ENDS = (".ndpi", ".svs", ".tif", ".tiff")
TILE = "path string, level int, factor double, scale double, y0 int, x0 int, h int, w int, plane_h int, plane_w int, dtype string"
PLAN = TILE + ", spec string"
TILES = TILE + ", c int, data array<double>"
REGION = "path string, level int, c int, h int, w int, data array<double>"
ERRORS = (ValueError, struct.error, KeyError, zlib.error, OSError, IndexError)
TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
#: Micrometres in an inch and in a centimetre, by the number of the unit.
UNITS = {2: 25400.0, 3: 10000.0}


def micrometres(page: dict) -> float | None:
    """Of a pixel: as the description says (`MPP = 0.5`), else from the resolution; null where neither is there."""
    if stated := re.search(r"MPP\s*=\s*([0-9.]+)", page["description"]):
        return float(stated[1])
    many, per = page["across"][:2]
    return UNITS[page["unit"]] * per / many if many and per and page["unit"] in UNITS else None


def tile_rows(path: str, read: Ranges) -> Iterator[dict]:
    """A row of a plan for each tile of each level."""
    found = tiff.levels(read)
    side = micrometres(found[0])
    for level, page in enumerate(found):
        if page["planar"] and page["samples"] > 1:
            raise ValueError(f"{path}: samples in planes of their own aren't read by tiles")
        factor, across = found[0]["w"] / page["w"], -(-page["w"] // page["tw"])
        base = {k: page[k] for k in ("samples", "planar", "compression", "predictor", "dtype", "th", "tw", "ycc", "tables")}
        for k in range(across * -(-page["h"] // page["th"])):
            y, x = k // across * page["th"], k % across * page["tw"]
            yield {
                "path": path, "level": level, "factor": factor, "scale": side and side * factor, "y0": y, "x0": x, "h": min(page["th"], page["h"] - y), "w": min(page["tw"], page["w"] - x), "plane_h": page["h"], "plane_w": page["w"],
                "dtype": np.dtype(page["dtype"]).newbyteorder("=").name, "spec": json.dumps({**base, "offsets": [page["offsets"][k]], "counts": [page["counts"][k]]}),
            }


def slide_plan(spark: SparkSession, folder: str, on_error: str = "raise") -> DataFrame:
    """A row for each tile of each level of a folder's slides: level 0 is the largest, factor how many of its pixels one is wide, scale a pixel's micrometres."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(ENDS) + "}").load(folder).select("path")
    schema = pa.schema([(c.split()[0], TYPES[c.split()[1]]) for c in PLAN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in itertools.chain.from_iterable(b.column("path").to_pylist() for b in batches):
            try:
                with Ranges(path) as read:
                    rows = tile_rows(path, read)
                    while some := list(itertools.islice(rows, 1024)):
                        yield pa.RecordBatch.from_pylist(some, schema)
            except ERRORS:
                if on_error != "skip":
                    raise

    return files.mapInArrow(run, PLAN)


def load_tiles(plan: DataFrame, on_error: str = "raise") -> DataFrame:
    """A row for each sample of each tile of a plan's rows, dealt anew so that one slide's tiles are spread; a task holds one tile at a time."""
    own = [c.split()[0] for c in TILE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                h, w = row.column("h")[0].as_py(), row.column("w")[0].as_py()
                try:
                    with Ranges(row.column("path")[0].as_py()) as read:
                        pixels = tiff.segment_at(read, json.loads(row.column("spec")[0].as_py()), 0)[:h, :w]
                except ERRORS:
                    if on_error != "skip":
                        raise
                    continue
                for c in range(pixels.shape[2]):
                    yield pa.RecordBatch.from_arrays([*[row.column(n) for n in own], pa.array([c], pa.int32()), lists(pixels[None, :, :, c])], names=[*own, "c", "data"])

    return plan.repartition("path", "level", "y0", "x0").mapInArrow(run, TILES)


def touching(plan: DataFrame, level: int, y: int, x: int, h: int, w: int) -> DataFrame:
    """The tiles of a plan that a region of a level touches."""
    return plan.where((F.col("level") == level) & (F.col("y0") < y + h) & (F.col("y0") + F.col("h") > y) & (F.col("x0") < x + w) & (F.col("x0") + F.col("w") > x))


def load_region(plan: DataFrame, level: int, y: int, x: int, h: int, w: int, on_error: str = "raise") -> DataFrame:
    """(path, level, c, h, w, data): a region of a level of each slide, cut where the level ends. A task holds one region; slides that don't reach it give none."""

    def assemble(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tall, wide = min(h, table.column("plane_h")[0].as_py() - y), min(w, table.column("plane_w")[0].as_py() - x)
        out = np.zeros((tall, wide))
        for k in range(table.num_rows):
            y0, x0, th, tw = (table.column(n)[k].as_py() for n in ("y0", "x0", "h", "w"))
            tile = matrix(table.column("data").slice(k, 1).combine_chunks()).reshape(th, tw)
            top, left, bottom, right = max(y, y0), max(x, x0), min(y + tall, y0 + th), min(x + wide, x0 + tw)
            out[top - y : bottom - y, left - x : right - x] = tile[top - y0 : bottom - y0, left - x0 : right - x0]
        first = [table.column(n).slice(0, 1).combine_chunks() for n in ("path", "level", "c")]
        return pa.table([*first, pa.array([tall], pa.int32()), pa.array([wide], pa.int32()), lists(out[None])], names=[c.split()[0] for c in REGION.split(", ")])

    if y < 0 or x < 0:
        raise ValueError("regions begin inside of a level")
    return load_tiles(touching(plan, level, y, x, h, w), on_error).groupBy("path", "level", "c").applyInArrow(assemble, REGION)


# Writing


def write_levels(out, levels: list[np.ndarray], tile: int, scale: float) -> int:
    """A BigTIFF of deflated tiles, a page for each level (y, x, sample), the first of which states the micrometres of a pixel; the number of tiles."""
    at, tiles = 16, 0
    out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))
    for n, pixels in enumerate(levels):
        h, w, samples = pixels.shape
        parts = []
        for y, x in itertools.product(range(0, h, tile), range(0, w, tile)):
            part = pixels[y : y + tile, x : x + tile]
            parts.append(zlib.compress(np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0))).tobytes()))
        text = f"MPP = {scale}".encode().ljust(16, b" ") + b"\0"
        arrays = [(tiff.DESCRIPTION, 2, len(text), text), (tiff.BITS, 3, samples, struct.pack(f"<{samples}H", *[8 * pixels.itemsize] * samples)), (tiff.FORMAT, 3, samples, struct.pack(f"<{samples}H", *[{"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]] * samples))]
        plain = [(tiff.WIDTH, 4, w), (tiff.HEIGHT, 4, h), (tiff.COMPRESSION, 3, tiff.DEFLATE), (tiff.PHOTOMETRIC, 3, 2 if samples == 3 else 1), (tiff.SAMPLES, 3, samples), (tiff.PLANAR, 3, 1), (tiff.TILE_WIDTH, 4, tile), (tiff.TILE_HEIGHT, 4, tile)]
        after = at + 8 + 20 * (len(plain) + len(arrays) + 2) + 8
        # What doesn't fit its field comes after the table: texts and numbers, places and sizes of tiles, tiles.
        head = sum(len(v) for _, _, _, v in arrays if len(v) > 8)
        first = after + head + (16 * len(parts) if len(parts) > 1 else 0)
        places = list(itertools.accumulate([first, *map(len, parts[:-1])]))
        arrays += [(tiff.TILE_OFFSETS, 16, len(parts), struct.pack(f"<{len(parts)}Q", *places)), (tiff.TILE_COUNTS, 16, len(parts), struct.pack(f"<{len(parts)}Q", *map(len, parts)))]
        fields, body = [(tag, struct.pack("<HHQQ", tag, kind, 1, v)) for tag, kind, v in plain], b""
        for tag, kind, many, v in arrays:
            inside = len(v) <= 8
            fields.append((tag, struct.pack("<HHQ", tag, kind, many) + (v.ljust(8, b"\0") if inside else struct.pack("<Q", after + len(body)))))
            body += b"" if inside else v
        body += b"".join(parts)
        body += b"\0" * (-(after + len(body)) % 8)
        following = after + len(body) if n + 1 < len(levels) else 0
        out.write(struct.pack("<Q", len(fields)) + b"".join(f for _, f in sorted(fields)) + struct.pack("<Q", following) + body)
        at, tiles = after + len(body), tiles + len(parts)
    return tiles


def write_slides(planes: DataFrame, folder: str, name: str = "path", dtype: str = "uint8", tile: int = 256, levels: int = 3, scale: float = 1.0) -> DataFrame:
    """Writes planes (name, c, h, w, data) as `{folder}/{name}.svs`, channels as samples, each level every second pixel of the one before; returns (image, tiles).

    A slide is written by one task, which holds it whole.
    """
    at = F.concat(F.lit(f"{folder.rstrip('/')}/"), F.regexp_replace(F.col(name).cast("string"), r"^.*/|\.[^./]*$", ""), F.lit(".svs"))

    def save(table: pa.Table) -> pa.Table:
        table = table.sort_by("c").combine_chunks()
        h, w = table.column("h")[0].as_py(), table.column("w")[0].as_py()
        pixels = np.ascontiguousarray(matrix(table.column("data").combine_chunks()).reshape(-1, h, w).transpose(1, 2, 0)).astype(np.dtype(dtype).newbyteorder("<"))
        image = table.column("image")[0].as_py()
        with replacing(image) as out:
            n = write_levels(out, [np.ascontiguousarray(pixels[:: 2**k, :: 2**k]) for k in range(levels)], tile, scale)
        return pa.table({"image": [image], "tiles": pa.array([n], pa.int64())})

    return cut(planes.select(at.alias("image"), F.col("c").cast("int").alias("c"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "data").groupBy("image").applyInArrow(save, "image string, tiles long"))
