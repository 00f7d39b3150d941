"""Image files as a Spark data source: `spark.read.format("voxelmill").load(folder)`.

One format for TIFF, NumPy and OME-Zarr, told apart by name. The driver lists names and sizes and reads no file; a partition is a share of
a file's planes, as many shares as it has `split` bytes. Of an OME-Zarr image metadata give the shares. Filters on path, axes, dtype, t,
c, z, h and w are taken from the query: those on the path leave files out before partitions are made, the others leave
planes out before their bytes are read.
"""

from __future__ import annotations

import operator
import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from ..functions.planes import lists
from . import arrays, zarr
from .store import Ranges, place

NAMES = [c.split()[0] for c in arrays.SCHEMA.split(", ")]
KEYS = NAMES[:-1]
COMPARE: dict[type, Callable] = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le}


def test_of(f: D.Filter) -> tuple[str, Callable[[object], bool]] | None:
    """A filter as the column that it is about, one of KEYS, and what it says of a value; null if it isn't one that planes can be told by."""
    if isinstance(f, D.Not):
        inner = test_of(f.child)
        return inner and (inner[0], lambda v: not inner[1](v))
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in KEYS:
        return None
    if type(f) in COMPARE:
        return f.attribute[0], lambda v, c=COMPARE[type(f)]: c(v, f.value)
    if isinstance(f, D.EqualNullSafe):
        return f.attribute[0], lambda v: v == f.value
    if isinstance(f, D.In):
        return f.attribute[0], lambda v: v in f.value
    if isinstance(f, D.IsNotNull | D.IsNull):
        return f.attribute[0], lambda v: isinstance(f, D.IsNotNull)
    text = {D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: str.__contains__}.get(type(f))
    return (f.attribute[0], lambda v: text(v, f.value)) if text else None


@dataclass
class Share(D.InputPartition):
    """The k-th of so many shares of a file's planes or of an image's chunks."""

    path: str
    k: int
    of: int


class ImageReader(D.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options.get("path")
        if not self.folder:
            raise ValueError("load() takes the path of a folder or a file")
        self.axes, self.level = options.get("axes"), int(options.get("level", 0))
        self.split, self.skip = int(options.get("split", 64 << 20)), options.get("on_error", "raise") == "skip"
        self.tests: list[tuple[str, Callable]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:  # noqa: N802
        for f in filters:
            if (found := test_of(f)) is None:
                yield f
            else:
                self.tests.append(found)

    def wanted(self, **known) -> bool:
        return all(test(known[column]) for column, test in self.tests if column in known)

    def files(self) -> Iterator[tuple[str, int]]:
        """Path and size of each image of the folder; of OME-Zarr images the size is that of a share."""
        system, top = place(self.folder)
        lead = self.folder[: len(self.folder) - len(top)] if self.folder.endswith(top) else "file:" if isinstance(system, fs.LocalFileSystem) else ""
        ahead = [top]
        while ahead:
            at = ahead.pop()
            info = system.get_file_info(at)
            for i in [info] if info.type == fs.FileType.File else sorted(system.get_file_info(fs.FileSelector(at)), key=lambda i: i.path):
                if i.type == fs.FileType.Directory and not i.base_name.endswith(".zarr"):
                    ahead.append(i.path)
                elif i.base_name.lower().endswith((*arrays.ENDS, ".zarr")) and not posixpath.basename(i.path).startswith("."):
                    yield lead + i.path, i.size or 0

    def partitions(self) -> list[Share]:
        out = []
        for path, size in [(self.folder, 0)] if self.folder.rstrip("/").endswith(".zarr") else self.files():
            if self.wanted(path=path):
                if path.rstrip("/").endswith(".zarr"):
                    d = zarr.described(path, self.level)
                    size = int(np.prod(d["shape"], dtype=np.int64)) * np.dtype(d["dtype"]).itemsize
                parts = max(1, -(-size // self.split))
                out += [Share(path, k, parts) for k in range(parts)]
        return out

    def read(self, part: Share | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's only partition of a folder without images
            return
        planes = self.of_zarr if part.path.rstrip("/").endswith(".zarr") else self.of_file
        try:
            for known, data in planes(part):
                own = [pa.array([known[n]], pa.string() if n in ("path", "axes", "dtype") else pa.int32()) for n in KEYS]
                yield pa.RecordBatch.from_arrays([*own, lists(data.reshape(1, -1))], names=NAMES)
        except arrays.ERRORS:
            if not self.skip:
                raise

    def of_file(self, part: Share) -> Iterator[tuple[dict, np.ndarray]]:
        with Ranges(part.path) as read:
            found = list((arrays.npy_planes if part.path.lower().endswith(".npy") else arrays.tiff_planes)(read, self.axes))
            for order, kind, at, h, w, spec in found[len(found) * part.k // part.of : len(found) * (part.k + 1) // part.of]:
                known = {"path": part.path, "axes": order, "dtype": kind, **{a: at.get(a.upper(), 0) for a in "tcz"}, "h": h, "w": w}
                if self.wanted(**known):
                    yield known, arrays.one_plane(read, spec, h, w)

    def of_zarr(self, part: Share) -> Iterator[tuple[dict, np.ndarray]]:
        """Planes, each from the chunks that cover it; a share has all planes of its chunks along t, c and z."""
        d = zarr.described(part.path, self.level)
        size, step = dict(zip(d["axes"], d["shape"], strict=True)), dict(zip(d["axes"], d["chunk"], strict=True))
        base = {"path": part.path, "axes": "".join(a for a in d["axes"].upper() if a not in "YX") + "YX", "dtype": np.dtype(d["dtype"]).name, "h": size["y"], "w": size["x"]}
        count = [-(-size.get(a, 1) // step.get(a, 1)) for a in "tcz"]
        n = int(np.prod(count))
        for g in range(n * part.k // part.of, n * (part.k + 1) // part.of):
            first = {a: int(i) * step.get(a, 1) for a, i in zip("tcz", np.unravel_index(g, count), strict=True)}
            inside = [range(first[a], min(first[a] + step.get(a, 1), size.get(a, 1))) for a in "tcz"]
            some = [dict(zip("tcz", p, strict=True)) for p in np.array(np.meshgrid(*inside, indexing="ij")).reshape(3, -1).T.tolist()]
            if some := [p for p in some if self.wanted(**base, **p)]:
                planes = [np.empty((size["y"], size["x"])) for _ in some]
                for y in range(0, size["y"], step["y"]):
                    for x in range(0, size["x"], step["x"]):
                        at = {**first, "y": y, "x": x}
                        chunk = zarr.read_chunk(d, [at[a] // step[a] for a in d["axes"]])
                        chunk = chunk.transpose([d["axes"].index(a) for a in zarr.AXES if a in d["axes"]]).reshape([step.get(a, 1) for a in zarr.AXES])
                        for p, plane in zip(some, planes, strict=True):
                            plane[y : y + step["y"], x : x + step["x"]] = chunk[tuple(p[a] - first[a] for a in "tcz")][: size["y"] - y, : size["x"] - x]
                for p, plane in zip(some, planes, strict=True):
                    yield {**base, **p}, plane


class ImageSource(D.DataSource):
    """Options: path, axes (a hint), level (of OME-Zarr), split (bytes of a partition), on_error (raise or skip)."""

    @classmethod
    def name(cls) -> str:
        return "voxelmill"

    def schema(self) -> str:
        return arrays.SCHEMA

    def reader(self, schema) -> ImageReader:  # noqa: ANN001
        return ImageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets its filters reach the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageSource)
