"""CZI files: scenes of mosaic tiles, found from the file's directory and put in their places.

A file is a chain of segments. The first says where the directory is, which lists every sub-block with its place along each axis and
where it lies in the file; so a plan of tiles is read without a pixel, and a plane needs the bytes of its own tiles only.
Sub-blocks that are stored smaller than they are belong to the levels of a pyramid. Pixels are plain or Zstandard, of
one sample or three; other packings raise.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graph import cut
from ..functions.planes import lists, matrix
from .store import Ranges, replacing

Read = Callable[[int, int], bytes]
#: Pixel types as numpy types and samples, and compressions.
PIXELS = {0: ("<u1", 1), 1: ("<u2", 1), 2: ("<f4", 1), 3: ("<u1", 3), 4: ("<u2", 3), 8: ("<f4", 3), 12: ("<u4", 1)}
PLAIN, ZSTD, ZSTD_BYTES = 0, 5, 6
#: Sizes of a segment's head, of an entry without its axes, of an axis, and of what comes before a sub-block's metadata.
HEAD, ENTRY, AXIS, BEFORE = 32, 32, 20, 256
PLAN = "path string, scene int, t int, c int, z int, factor int, m int, y0 int, x0 int, h int, w int, dtype string, spec string"
PLANES = "path string, scene int, factor int, dtype string, t int, c int, z int, h int, w int, data array<double>"


def segment(read: Read, at: int, name: bytes) -> int:
    """The used bytes of a segment that has this name."""
    head = read(at, HEAD)
    if head[:16].rstrip(b"\0") != name:
        raise ValueError(f"no segment {name.decode()} at byte {at}")
    return struct.unpack_from("<q", head, 24)[0]


def entries(read: Read) -> Iterator[dict]:
    """Of each sub-block its pixel type, place in the file, compression, and start, size and stored size along its axes."""
    segment(read, 0, b"ZISRAWFILE")
    (at,) = struct.unpack("<q", read(HEAD + 52, 8))
    body = read(at + HEAD, segment(read, at, b"ZISRAWDIRECTORY"))
    place = 128
    for _ in range(struct.unpack_from("<i", body)[0]):
        kind, pixels, position, _, compression, _, count = struct.unpack_from("<2siqii6si", body, place)
        if kind != b"DV":
            raise ValueError(f"entries of kind {kind!r} aren't read")
        axes = {}
        for k in range(count):
            name, start, size, _, stored = struct.unpack_from("<4siifi", body, place + ENTRY + AXIS * k)
            axes[name.rstrip(b"\0").decode()] = (start, size, stored)
        yield {"pixels": pixels, "at": position, "compression": compression, "axes": axes}
        place += ENTRY + AXIS * count


def metadata_xml(read: Read) -> str:
    """The file's metadata, of which `sinks.czi_scales` takes the scales."""
    segment(read, 0, b"ZISRAWFILE")
    (at,) = struct.unpack("<q", read(HEAD + 60, 8))
    if not at:
        return ""
    segment(read, at, b"ZISRAWMETADATA")
    (size,) = struct.unpack("<i", read(at + HEAD, 4))
    return read(at + HEAD + BEFORE, size).decode("utf-8", "replace")


def tile_rows(path: str, read: Read) -> Iterator[dict]:
    """A row of a plan for each sample of each sub-block."""
    for e in entries(read):
        if e["pixels"] not in PIXELS:
            raise ValueError(f"{path}: pixel type {e['pixels']} isn't read")
        kind, samples = PIXELS[e["pixels"]]
        axes = e["axes"]
        (x0, w, sw), (y0, h, sh) = ((a, n, s or n) for a, n, s in (axes["X"], axes["Y"]))
        start = lambda a, axes=axes: axes.get(a, (0, 1, 1))[0]
        for k in range(samples):
            spec = {"at": e["at"], "axes": len(axes), "pixels": e["pixels"], "compression": e["compression"], "sample": samples - 1 - k}  # blue comes first
            yield {
                "path": path, "scene": start("S"), "t": start("T"), "c": start("C") * samples + k, "z": start("Z"), "factor": max(1, round(w / sw), round(h / sh)), "m": start("M"), "y0": y0, "x0": x0, "h": sh, "w": sw,
                "dtype": np.dtype(kind).name, "spec": json.dumps(spec),
            }


def czi_plan(spark: SparkSession, folder: str, on_error: str = "raise") -> DataFrame:
    """A row for each tile of the CZI files of a folder: scene, t, c, z, factor of its pyramid level, number m in the mosaic, its place, its stored size.

    With them come plane_h and plane_w, the size of the scene's planes at that level, and ty and tx, the tile's place in them. Take the
    rows that are wanted, then `load_czi`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.czi").load(folder).select("path")
    names = [c.split()[0] for c in PLAN.split(", ")]
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int32()) for c in PLAN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with Ranges(path) as read:
                        rows = list(tile_rows(path, read))
                except (ValueError, struct.error, OSError, KeyError):
                    if on_error != "skip":
                        raise
                    continue
                for lo in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_pylist(rows[lo : lo + 1024], schema)

    tiles = files.mapInArrow(run, PLAN)
    level = ["path", "scene", "factor"]
    low = tiles.groupBy("path", "scene").agg(F.min("y0").alias("__y"), F.min("x0").alias("__x"))  # of all levels, as they show one scene
    place = {f"t{a}": F.floor((F.col(f"{a}0") - F.col(f"__{a}")) / F.col("factor")).cast("int") for a in "yx"}
    tiles = tiles.join(low, ["path", "scene"]).withColumns(place).drop("__y", "__x")
    size = tiles.groupBy(*level).agg(F.max(F.col("ty") + F.col("h")).alias("plane_h"), F.max(F.col("tx") + F.col("w")).alias("plane_w"))
    return tiles.join(size, level).select(*names, "ty", "tx", "plane_h", "plane_w")


def unpacked(data: bytes, compression: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression not in (ZSTD, ZSTD_BYTES):
        raise ValueError(f"sub-blocks of compression {compression} aren't read")
    import zstandard

    head = data[0] if compression == ZSTD_BYTES else 0
    halves = head >= 3 and data[1] == 1 and data[2] & 1
    data = zstandard.ZstdDecompressor().decompressobj().decompress(data[head:])
    if not halves:
        return data
    n = len(data) // 2  # all low bytes, then all high ones
    return np.frombuffer(data, np.uint8).reshape(2, n).T.tobytes()


def read_tile(read: Read, spec: dict, h: int, w: int) -> np.ndarray:
    """One sample of a sub-block."""
    segment(read, spec["at"], b"ZISRAWSUBBLOCK")
    about, _, size = struct.unpack("<iiq", read(spec["at"] + HEAD, 16))
    start = spec["at"] + HEAD + max(BEFORE, 16 + ENTRY + AXIS * spec["axes"]) + about
    kind, samples = PIXELS[spec["pixels"]]
    return np.frombuffer(unpacked(read(start, size), spec["compression"]), kind, h * w * samples).reshape(h, w, samples)[:, :, spec["sample"]]


def load_czi(plan: DataFrame, on_error: str = "raise") -> DataFrame:
    """(path, scene, factor, dtype, t, c, z, h, w, data): the planes that the tiles of a plan make up; of tiles that overlap the last of the mosaic is on top."""
    own = [F.col(n) for n in ("path", "scene", "factor", "dtype", "t", "c", "z", "m", "ty", "tx", "h", "w", "plane_h", "plane_w")]
    loaded = T.StructType([*plan.select(*own).schema, T.StructField("data", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                one = {n: row.column(n)[0].as_py() for n in ("path", "spec", "h", "w")}
                try:
                    with Ranges(one["path"]) as read:
                        data = read_tile(read, json.loads(one["spec"]), one["h"], one["w"])
                except (ValueError, struct.error, OSError):
                    if on_error != "skip":
                        raise
                    continue
                yield pa.RecordBatch.from_arrays([*[row.column(n) for n in loaded.names[:-1]], lists(data.reshape(1, -1))], names=loaded.names)

    def assemble(table: pa.Table) -> pa.Table:
        table = table.sort_by("m").combine_chunks()
        out = np.zeros((table.column("plane_h")[0].as_py(), table.column("plane_w")[0].as_py()))
        for k in range(table.num_rows):
            y, x, h, w = (table.column(n)[k].as_py() for n in ("ty", "tx", "h", "w"))
            out[y : y + h, x : x + w] = matrix(table.column("data").slice(k, 1).combine_chunks()).reshape(h, w)
        names = [c.split()[0] for c in PLANES.split(", ")]
        first = [table.column(n).slice(0, 1).combine_chunks() for n in names[:7]]
        return pa.table([*first, *[pa.array([n], pa.int32()) for n in out.shape], lists(out.reshape(1, -1))], names=names)

    tiles = plan.select(*own, "spec").repartition("path", "scene", "t", "c", "z", "m").mapInArrow(run, loaded)
    return tiles.groupBy("path", "scene", "factor", "t", "c", "z").applyInArrow(assemble, PLANES)


def read_czi(spark: SparkSession, folder: str, on_error: str = "raise") -> DataFrame:
    """The full planes of all scenes of the CZI files of a folder."""
    return load_czi(czi_plan(spark, folder, on_error).where("factor = 1"), on_error)


# Writing


def packed(pixels: np.ndarray, compression: int) -> bytes:
    raw = np.ascontiguousarray(pixels).tobytes()
    if compression == PLAIN:
        return raw
    pack = pa.Codec("zstd").compress
    if compression == ZSTD:
        return pack(raw).to_pybytes()
    halves = pixels.dtype.itemsize == 2
    raw = np.frombuffer(raw, np.uint8).reshape(-1, 2).T.tobytes() if halves else raw
    return (b"\x03\x01\x01" if halves else b"\x01") + pack(raw).to_pybytes()


def write_blocks(out, blocks: Iterator[tuple[dict[str, tuple[int, int, int]], np.ndarray]], compression: int = ZSTD, xml: str = "") -> int:
    """A CZI file of sub-blocks (axes as start, size, stored size; pixels (y, x) or (y, x, sample), blue first), from front to back; their number.

    The first segment says where metadata and directory are before their sizes are known, so sub-blocks are held until the end.
    """

    def whole(name: bytes, body: bytes) -> bytes:
        body += b"\0" * (-len(body) % 32)
        return name.ljust(16, b"\0") + struct.pack("<qq", len(body), len(body)) + body

    codes = {v: k for k, v in PIXELS.items()}
    start = HEAD + 512
    parts, listed, at = [], [], start
    for axes, pixels in blocks:
        kind = codes[np.dtype(pixels.dtype).newbyteorder("<").str.replace("|", "<"), pixels.shape[2] if pixels.ndim == 3 else 1]
        data = packed(pixels, compression)
        entry = struct.pack("<2siqii6si", b"DV", kind, at, 0, compression, b"", len(axes)) + b"".join(struct.pack("<4siifi", n.encode(), a, size, 0.0, stored) for n, (a, size, stored) in axes.items())
        parts.append(whole(b"ZISRAWSUBBLOCK", (struct.pack("<iiq", 0, 0, len(data)) + entry).ljust(BEFORE, b"\0") + data))
        listed.append(entry)
        at += len(parts[-1])
    meta = whole(b"ZISRAWMETADATA", struct.pack("<ii", len(xml.encode()), 0).ljust(BEFORE, b"\0") + xml.encode()) if xml else b""
    head = struct.pack("<iiii32siqqiq", 1, 0, 0, 0, b"", 0, at + len(meta), at if meta else 0, 0, 0).ljust(512, b"\0")
    out.write(b"".join([whole(b"ZISRAWFILE", head), *parts, meta, whole(b"ZISRAWDIRECTORY", struct.pack("<i", len(listed)).ljust(128, b"\0") + b"".join(listed))]))
    return len(listed)


def write_czi(planes: DataFrame, folder: str, name: str = "path", dtype: str = "uint16", tile: int = 512, compression: int = ZSTD, level: bool = False) -> DataFrame:
    """Writes planes (name, scene, t, c, z, h, w, data) as `{folder}/{name}.czi` in mosaics of tiles; returns (image, tiles). A file is written by one task.

    With `level` each tile has one of every second pixel too.
    """
    folder = folder.rstrip("/")
    at = F.concat(F.lit(f"{folder}/"), F.regexp_replace(F.col(name).cast("string"), r"^.*/|\.[^./]*$", ""), F.lit(".czi"))
    rows = planes.select(at.alias("image"), *[F.col(a).cast("int").alias(a) for a in ("scene", "t", "c", "z", "h", "w")], "data")

    def save(table: pa.Table) -> pa.Table:
        table = table.sort_by([(a, "ascending") for a in ("scene", "t", "c", "z")])

        def blocks() -> Iterator[tuple[dict, np.ndarray]]:
            for k in range(table.num_rows):
                s, t, c, z, h, w = (table.column(n)[k].as_py() for n in ("scene", "t", "c", "z", "h", "w"))
                plane = matrix(table.column("data").slice(k, 1).combine_chunks()).reshape(h, w).astype(np.dtype(dtype).newbyteorder("<"))
                corners: Sequence = [(y, x) for y in range(0, h, tile) for x in range(0, w, tile)]
                for m, (y, x) in enumerate(corners):
                    part = plane[y : y + tile, x : x + tile]
                    for step in (1, 2) if level else (1,):
                        own = part[::step, ::step]
                        # Scenes lie side by side on the slide.
                        yield {"X": (x + s * (w + 10), part.shape[1], own.shape[1]), "Y": (y, part.shape[0], own.shape[0]), "C": (c, 1, 1), "Z": (z, 1, 1), "T": (t, 1, 1), "S": (s, 1, 1), "M": (m, 1, 1)}, own

        image = table.column("image")[0].as_py()
        with replacing(image) as out:
            n = write_blocks(out, blocks(), compression)
        return pa.table({"image": [image], "tiles": pa.array([n], pa.int64())})

    return cut(rows.groupBy("image").applyInArrow(save, "image string, tiles long"))
