"""OME-Zarr: chunks as tasks, in and out.

An image is a folder. Its metadata are read as what they are, a few lines of JSON an image; its chunks are read
and written by the tasks that deal with them. Versions 2 and 3 of the format are read and written, also with chunks in
shards, of which single ones are read by their bytes. Compressors: none, Blosc (but for its own packer), zlib, gzip, zstd;
written are zstd, zlib, gzip and none.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graph import cut
from ..functions.planes import lists, matrix, on_planes, spread
from ..operators.enhance import resize_yx
from ..operators.inspection import level_scales
from . import codecs
from .store import Ranges, names_in, read_whole, replacing

AXES = "tczyx"
PLAN = "path string, level string, dtype string, shape array<int>, chunk array<int>, t0 int, c0 int, z0 int, y0 int, x0 int, whole boolean, spec string"
PLANES = "path string, level string, dtype string, t int, c int, z int, h int, w int, data array<double>"
TILES = "path string, level string, dtype string, t int, c int, z int, y0 int, x0 int, h int, w int, plane_h int, plane_w int, data array<double>"


def images_in(folder: str) -> list[str]:
    """The images of a folder: what is named `.zarr`, or the folder itself if it is one."""
    inside = names_in(folder)
    if any(n in inside for n in (".zattrs", ".zarray", "zarr.json")):
        return [folder]
    return [f"{folder.rstrip('/')}/{n}" for n in inside if n.endswith(".zarr")]


def coding(path: str, chain: Sequence[dict]) -> dict:
    """What a chain of codecs of version 3 says: byte order, order of axes, packers, and the chunks of shards."""
    out = {"order": "<", "transpose": None, "codecs": [], "shard": None}
    for c in chain:
        own = c.get("configuration", {})
        if c["name"] == "bytes":
            out["order"] = ">" if own.get("endian", "little") == "big" else "<"
        elif c["name"] == "transpose" and isinstance(own["order"], list):
            out["transpose"] = own["order"]
        elif c["name"] == "sharding_indexed":
            index = [x["name"] for x in own.get("index_codecs", [])]
            if set(index) - {"bytes", "crc32c"} or len(chain) > 1:
                raise ValueError(f"{path}: shards with an index in {index} in other codecs aren't read")
            inner = coding(path, own["codecs"])
            return inner | {"shard": {"chunk": own["chunk_shape"], "end": own.get("index_location", "end") == "end", "checked": "crc32c" in index}}
        elif c["name"] in ("blosc", "zlib", "gzip", "zstd", "crc32c"):
            out["codecs"].append(c["name"])
        else:
            raise ValueError(f"{path}: codec {c['name']} isn't read")
    return out


def attributes_of(path: str) -> dict:
    """The OME metadata of an image, of either version."""
    if (new := read_whole(f"{path.rstrip('/')}/zarr.json")) is not None:
        attributes = json.loads(new).get("attributes", {})
        return attributes.get("ome", attributes)
    return json.loads(read_whole(f"{path.rstrip('/')}/.zattrs") or b"{}")


def described(path: str, level: str | int = 0) -> dict:
    """Shape, chunk, type, axes and coding of one level of an image; `level` is its place in the list of levels or its name."""
    joined = lambda *parts: "/".join([path.rstrip("/"), *[str(p) for p in parts if p != ""]])
    attributes = attributes_of(path)
    scales = (attributes.get("multiscales") or [{}])[0]
    levels = [d["path"] for d in scales.get("datasets", [])]
    if isinstance(level, int) and levels and level >= len(levels):
        raise ValueError(f"{path}: there are {len(levels)} levels, none of number {level}")
    name = (levels[level] if levels else "") if isinstance(level, int) else level
    axes = "".join(a["name"] if isinstance(a, dict) else a for a in scales.get("axes", []))
    if (old := read_whole(joined(name, ".zarray"))) is not None:
        meta = json.loads(old)
        if meta.get("filters") or meta.get("order", "C") not in ("C", "F"):
            raise ValueError(f"{path}: filters aren't read")
        codec = (meta.get("compressor") or {}).get("id", "")
        spec = {"dtype": meta["dtype"], "codecs": [codec] if codec else [], "key": "", "sep": meta.get("dimension_separator", "."), "shard": None}
        spec["transpose"] = list(range(len(meta["shape"])))[::-1] if meta.get("order", "C") == "F" else None
        shape, chunk = meta["shape"], meta["chunks"]
    elif (new := read_whole(joined(name, "zarr.json"))) is not None:
        meta = json.loads(new)
        keys = meta.get("chunk_key_encoding", {"name": "default"})
        default = keys["name"] == "default"
        spec = coding(path, meta["codecs"]) | {"key": "c" if default else "", "sep": keys.get("configuration", {}).get("separator", "/" if default else ".")}
        spec["dtype"] = np.dtype(meta["data_type"]).newbyteorder(spec.pop("order")).str
        shape, chunk = meta["shape"], meta["chunk_grid"]["configuration"]["chunk_shape"]
        if spec["shard"]:
            spec["shard"]["shape"], chunk = chunk, spec["shard"].pop("chunk")
            if any(s % c for s, c in zip(spec["shard"]["shape"], chunk, strict=True)):
                raise ValueError(f"{path}: shards of {spec['shard']['shape']} aren't made of chunks of {chunk}")
    else:
        raise ValueError(f"{path}: no array at level {level!r}")
    axes = (axes or AXES[-len(shape) :]).lower()
    if len(axes) != len(shape) or not {"y", "x"} <= set(axes) <= set(AXES):
        raise ValueError(f"{path}: axes {axes} don't name the {len(shape)} of the array")
    own = next((d for d in scales.get("datasets", []) if d["path"] == name), {}).get("coordinateTransformations", [])
    scale = next((t["scale"] for t in own if t.get("type") == "scale"), [1.0] * len(axes))
    return {"path": path, "level": name, "shape": shape, "chunk": chunk, "axes": axes, "scale": dict(zip(axes, scale, strict=True)), "fill": meta.get("fill_value") or 0, **spec}


def chunk_plan(spark: SparkSession, images: Sequence[str] | DataFrame, level: int = 0) -> DataFrame:
    """A row for each chunk with its first place along each axis, nothing of its pixels read: take what rows are wanted, then `load_tiles` or `load_chunks`.

    images: paths, or a table with a column `path`; metadata are read in tasks. whole: the chunk has whole planes.
    """
    paths = images if isinstance(images, DataFrame) else spark.createDataFrame([(p,) for p in images], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                d = described(path, level)
                size, step = dict(zip(d["axes"], d["shape"], strict=True)), dict(zip(d["axes"], d["chunk"], strict=True))
                places = itertools.product(*[range(0, size.get(a, 1), step.get(a, 1)) for a in AXES])
                spec, whole = json.dumps(d), step["y"] >= size["y"] and step["x"] >= size["x"]
                while rows := list(itertools.islice(places, 4096)):
                    own = [path, d["level"], np.dtype(d["dtype"]).name, d["shape"], d["chunk"]]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, [*own, *r, whole, spec], strict=True)) for r in rows], schema)

    names = [c.split()[0] for c in PLAN.split(", ")]
    kinds = [pa.string()] * 3 + [pa.list_(pa.int32())] * 2 + [pa.int32()] * 5 + [pa.bool_(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    return paths.select("path").mapInArrow(run, PLAN)


def chunk_bytes(d: dict, at: Sequence[int]) -> bytes | None:
    """A chunk as it is stored, or null if it isn't; of a shard its index and the chunk alone are read."""
    grid = [a * c // s for a, c, s in zip(at, d["chunk"], d["shard"]["shape"], strict=True)] if d["shard"] else at
    name = d["sep"].join(map(str, [*([d["key"]] if d["key"] else []), *grid]))
    path = "/".join(p for p in (d["path"].rstrip("/"), d["level"], name) if p)
    if not d["shard"]:
        return read_whole(path)
    per = [s // c for c, s in zip(d["chunk"], d["shard"]["shape"], strict=True)]
    n = 16 * int(np.prod(per)) + 4 * d["shard"]["checked"]
    try:
        with Ranges(path) as read:
            index = codecs.index_of(read(read.size - n if d["shard"]["end"] else 0, n), d["shard"]["checked"])
            start, length = map(int, index[np.ravel_multi_index([a % p for a, p in zip(at, per, strict=True)], per)])
            return None if start == codecs.ABSENT else read(start, length)
    except FileNotFoundError:
        return None


def read_chunk(d: dict, at: Sequence[int]) -> np.ndarray:
    """The chunk at a place of the grid of chunks; one that isn't there has the fill value."""
    raw = chunk_bytes(d, at)
    if raw is None:
        return np.full(d["chunk"], d["fill"], d["dtype"])
    stored = np.frombuffer(codecs.unpacked(raw, d["codecs"]), d["dtype"])
    if not (order := d["transpose"]):
        return stored.reshape(d["chunk"])
    return stored.reshape([d["chunk"][k] for k in order]).transpose(np.argsort(order))


def load_tiles(plan: DataFrame) -> DataFrame:
    """(path, level, dtype, t, c, z, y0, x0, h, w, plane_h, plane_w, data): what each chunk of a plan has of each plane. A task holds one chunk at a time."""
    names = [c.split()[0] for c in TILES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                d, first = json.loads(batch.column("spec")[k].as_py()), {a: batch.column(f"{a}0")[k].as_py() for a in AXES}
                axes, size, step = d["axes"], dict(zip(d["axes"], d["shape"], strict=True)), dict(zip(d["axes"], d["chunk"], strict=True))
                chunk = read_chunk(d, [first[a] // step[a] for a in axes])
                chunk = chunk.transpose([axes.index(a) for a in AXES if a in axes])
                chunk = chunk.reshape([step.get(a, 1) for a in AXES])[tuple(slice(0, size.get(a, 1) - first[a]) for a in AXES)]
                own, (h, w) = [batch.column(n).slice(k, 1) for n in ("path", "level", "dtype")], chunk.shape[-2:]
                for t, c, z in np.ndindex(*chunk.shape[:3]):
                    numbers = (first["t"] + t, first["c"] + c, first["z"] + z, first["y"], first["x"], h, w, size["y"], size["x"])
                    yield pa.RecordBatch.from_arrays([*own, *[pa.array([n], pa.int32()) for n in numbers], lists(chunk[t, c, z][None])], names=names)

    return spread(plan, "path", *[f"{a}0" for a in AXES]).mapInArrow(run, TILES)


def to_plane(table: pa.Table) -> pa.Table:
    """The plane that tiles make up; what no tile covers is 0."""
    out = np.zeros((table.column("plane_h")[0].as_py(), table.column("plane_w")[0].as_py()))
    for k in range(table.num_rows):
        y, x, h, w = (table.column(n)[k].as_py() for n in ("y0", "x0", "h", "w"))
        out[y : y + h, x : x + w] = matrix(table.column("data").slice(k, 1).combine_chunks()).reshape(h, w)
    names = [c.split()[0] for c in PLANES.split(", ")]
    own = [table.column(n).slice(0, 1).combine_chunks() for n in names[:6]]
    return pa.table([*own, *[pa.array([n], pa.int32()) for n in out.shape], lists(out.reshape(1, -1))], names=names)


def load_chunks(plan: DataFrame) -> DataFrame:
    """(path, level, dtype, t, c, z, h, w, data): the planes of the chunks of a plan, those of several chunks put together by a shuffle of their tiles."""
    names = [c.split()[0] for c in PLANES.split(", ")]
    tiles = load_tiles(plan.where("not whole")).groupBy("path", "level", "t", "c", "z").applyInArrow(to_plane, PLANES)
    return load_tiles(plan.where("whole")).select(*names).unionByName(tiles)


def read_zarr(spark: SparkSession, folder: str, level: int = 0) -> DataFrame:
    """The planes of an image or of all images of a folder, at one level."""
    return load_chunks(chunk_plan(spark, images_in(folder), level))


def resize_zarr(spark: SparkSession, image: str, folder: str, scale_factor: float, levels: int = 1, nearest: bool = False, chunk: int = 512) -> DataFrame:
    """An image made smaller or larger in y and x, as a new one of `folder` whose metadata have the new scale; (image, planes).

    Labels take the nearest pixel, others linear weights.
    """
    d = described(image)
    size = dict(zip(d["axes"], d["shape"], strict=True))
    target = {a: max(1, round(size[a] * scale_factor)) for a in "yx"}
    planes = read_zarr(spark, image)
    if nearest:
        at = {a: np.minimum(((np.arange(target[a]) + 0.5) * size[a] / target[a]).astype(int), size[a] - 1) for a in "yx"}
        planes = on_planes(planes, lambda s: s[:, at["y"]][:, :, at["x"]])
    else:
        planes = resize_yx(planes, scale_factor, np.dtype(d["dtype"]).kind in "ui")
    new = level_scales(d["scale"], size, {**size, **target}, 1)[0]
    return write_zarr(planes, folder, dtype=np.dtype(d["dtype"]).name, chunk=chunk, levels=levels, scale=new)


def layout(version: int, kind: np.dtype, axes: str, sizes: dict[str, int], chunk: int, shard: int, codec: str, level: int) -> tuple[str, dict]:
    """Name and content of the metadata of an array of planes in chunks."""
    packer = {"id": codec, "level": level} if codec else None
    shape, squares = [sizes[a] for a in axes], lambda n: [n if a in "yx" else 1 for a in axes]
    if version == 2:
        return ".zarray", {"zarr_format": 2, "shape": shape, "chunks": squares(chunk), "dtype": kind.str, "compressor": packer, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": "/"}
    own = {"zstd": {"level": level, "checksum": False}, "gzip": {"level": level}}
    little = {"name": "bytes", "configuration": {"endian": "little"}} if kind.itemsize > 1 else {"name": "bytes"}
    chain = [little, *([{"name": codec, "configuration": own[codec]}] if codec else [])]
    if shard > chunk:
        index = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
        chain = [{"name": "sharding_indexed", "configuration": {"chunk_shape": squares(chunk), "codecs": chain, "index_codecs": index, "index_location": "end"}}]
    grid = {"name": "regular", "configuration": {"chunk_shape": squares(max(chunk, shard))}}
    return "zarr.json", {
        "zarr_format": 3, "node_type": "array", "shape": shape, "data_type": kind.name, "chunk_grid": grid, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "fill_value": 0, "codecs": chain, "attributes": {}, "dimension_names": list(axes),
    }


def level_scale(scales: Sequence[dict], level: int, axes: str) -> list[float]:
    """A level's scale along each axis: as stated, or that of the last level stated, doubled in y and x for each level after it."""
    known = scales[min(level, len(scales) - 1)] if scales else {}
    more = 2 ** max(0, level - max(0, len(scales) - 1))
    return [(known.get(a) or 1.0) * (more if a in "yx" else 1) for a in axes]


def write_zarr(
    planes: DataFrame, folder: str, name: str = "path", dtype: str = "uint16", chunk: int = 512, levels: int = 1, scale: dict[str, float] | None = None, codec: str = "zstd", level: int = 3, version: int = 2, shard: int = 0,
    axes: str = AXES, like: DataFrame | None = None,
) -> DataFrame:
    """Writes planes (name, t, c, z, h, w, data) as images `{folder}/{name}.zarr` and returns (image, planes) of what was written.

    Each task writes the chunks of its planes, a file each or, with `shard` in version 3, in squares of so many pixels, under
    the names that they have for good, so what is done twice is the same. Chunks and shards of zeros aren't written. Levels are
    every second pixel of the one before, which keeps labels. Version 2 has OME metadata 0.4, version 3 has 0.5.
    Axes may come in any order; those left out have no other place than 0, or it raises. like (name, axes, levels, scales,
    windows), a row an image as `metadata.image_catalog` has them, goes before `axes`, `levels` and `scale` for the images that it names.
    """
    if version not in (2, 3) or (shard and (version == 2 or shard % chunk)) or (version == 3 and codec == "zlib"):
        raise ValueError("versions are 2 and 3, shards of version 3 are made of whole chunks, and version 3 has no zlib")
    if len(set(axes)) != len(axes) or not {"y", "x"} <= set(axes) <= set(AXES):
        raise ValueError(f"{axes} aren't axes of an image")
    codecs.packed(b"", codec, level)
    folder = folder.rstrip("/")
    kind = np.dtype(dtype).newbyteorder("<") if np.dtype(dtype).itemsize > 1 else np.dtype(dtype)
    stem = F.regexp_replace(F.col(name).cast("string"), r"^.*/|\.[^./]*$", "")
    rows = planes.select(stem.alias("stem"), *[F.col(a).cast("int").alias(a) for a in "tcz"], F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "data")
    plain = F.lit(json.dumps({"axes": axes, "levels": levels, "scales": [scale] if scale else []}))
    if like is None:
        rows = rows.withColumn("how", plain)
    else:
        own = like.groupBy(F.col("name").alias("__name")).agg(F.min(F.to_json(F.struct("axes", "levels", "scales", "windows"))).alias("how"))
        rows = rows.join(own, F.col("stem") == F.col("__name"), "left").drop("__name").withColumn("how", F.coalesce("how", plain))
    rows = rows.select(F.concat(F.lit(f"{folder}/"), "stem", F.lit(".zarr")).alias("image"), "t", "c", "z", "h", "w", "how", "data")
    side, key = max(chunk, shard), ["c"] if version == 3 else []

    def stored(part: np.ndarray, turned: bool) -> bytes | None:
        if not part.any():
            return None
        full = np.zeros((chunk, chunk), kind)
        full[: part.shape[0], : part.shape[1]] = part
        return codecs.packed((full.T if turned else full).tobytes(), codec, level)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = batch.select(["image", "t", "c", "z", "h", "w", "how"])
            for k in range(batch.num_rows):
                image, t, c, z, h, w, how = (done.column(n)[k].as_py() for n in range(7))
                how = json.loads(how)
                at, order = {"t": t, "c": c, "z": z}, how["axes"]
                if any(n and a not in order for a, n in at.items()):
                    raise ValueError(f"{image} has planes along an axis that {order} lack")
                turned = order.index("x") < order.index("y")
                plane = matrix(batch.column("data").slice(k, 1)).reshape(h, w).astype(kind)
                for down in range(how["levels"]):
                    for y, x in itertools.product(range(0, plane.shape[0], side), range(0, plane.shape[1], side)):
                        inner = [(a, b) for a in range(y, y + side, chunk) for b in range(x, x + side, chunk)]
                        parts = [stored(plane[a : a + chunk, b : b + chunk], turned) for a, b in (sorted(inner, key=lambda p: p[::-1]) if turned else inner)]
                        if any(p is not None for p in parts):
                            place = at | {"y": y // side, "x": x // side}
                            with replacing("/".join([image, str(down), *key, *[str(place[a]) for a in order]])) as out:
                                out.write(codecs.shard_of(parts) if shard > chunk else parts[0])
                    plane = plane[::2, ::2]
            yield done

    number = T.IntegerType()
    schema = T.StructType([T.StructField("image", T.StringType()), *[T.StructField(n, number) for n in ("t", "c", "z", "h", "w")], T.StructField("how", T.StringType())])
    found = rows.mapInArrow(chunks, schema).groupBy("image").agg(F.count("*").alias("planes"), *[(F.max(a) + 1).alias(a) for a in "tcz"], F.max("h").alias("h"), F.max("w").alias("w"), F.min("how").alias("how"))

    def metadata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                how, datasets, files = json.loads(r["how"]), [], {}
                order = how["axes"]
                for down in range(how["levels"]):
                    sizes = {**{a: r[a] for a in "tcz"}, "y": -(-r["h"] // 2**down), "x": -(-r["w"] // 2**down)}
                    file, content = layout(version, kind, order, sizes, chunk, shard, codec, level)
                    files[f"{down}/{file}"] = content
                    datasets.append({"path": str(down), "coordinateTransformations": [{"type": "scale", "scale": level_scale(how["scales"], down, order)}]})
                kinds = {"t": "time", "c": "channel"}
                ome = {"multiscales": [{"axes": [{"name": a, "type": kinds.get(a, "space")} for a in order], "datasets": datasets}]}
                if how.get("windows"):
                    ome["omero"] = {"channels": [{"window": w} for w in how["windows"]]}
                if version == 2:
                    ome["multiscales"][0] |= {"version": "0.4"}
                    files |= {".zattrs": ome, ".zgroup": {"zarr_format": 2}}
                else:
                    files["zarr.json"] = {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": "0.5", **ome}}}
                for file, content in files.items():
                    with replacing(f"{r['image']}/{file}") as out:
                        out.write(json.dumps(content).encode())
            yield batch.select(["image", "planes"])

    return cut(found.mapInArrow(metadata, "image string, planes long"))
