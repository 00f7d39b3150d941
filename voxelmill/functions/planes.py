"""Kernels on whole planes and volumes in Arrow batches: numpy functions over the last axes of stacks.

Planes of one shape that come in one batch go through a kernel together, up to VALUES values at a time. Volumes are
cut into tiles of all their planes, with a halo as wide as the kernel reaches, so a volume may be larger than
a task: a task holds one tile's depth times its area.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Kernel = Callable[[np.ndarray], np.ndarray]
#: Values of planes that a kernel gets at a time.
VALUES = 1 << 22
DATA = T.ArrayType(T.DoubleType())


def lists(values: np.ndarray) -> pa.ListArray:
    """A row of values for each first index."""
    flat = np.ascontiguousarray(values, np.float64).reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def matrix(column: pa.ListArray) -> np.ndarray:
    """(row, value) of lists of one length; missing values are 0."""
    flat = column.flatten()
    return flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def with_type(schema: T.StructType, **types: T.DataType) -> T.StructType:
    """The schema with columns of the given types, at their places or at the end."""
    own = [T.StructField(f.name, types.pop(f.name), True) if f.name in types else f for f in schema]
    return T.StructType([*own, *[T.StructField(n, t, True) for n, t in types.items()]])


def spread(plan: DataFrame, *keys: str) -> DataFrame:
    """A plan's rows by keys in as many partitions as the session's shuffles have. The number is given as Spark else merges partitions by their bytes, of which a plan has few and what its rows load many."""
    return plan.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def even_stretches(h: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of one shape with up to VALUES values, or one row."""
    lo = 0
    while lo < len(h):
        hi, most = lo + 1, max(1, VALUES // max(1, int(h[lo]) * int(w[lo])))
        while hi < len(h) and hi - lo < most and h[hi] == h[lo] and w[hi] == w[lo]:
            hi += 1
        yield lo, hi
        lo = hi


def on_planes(planes: DataFrame, kernel: Kernel, data: str = "data", out: str = "data") -> DataFrame:
    """`planes` with `out` made of `data` by a kernel of stacks (plane, y, x), which may change height and width."""
    schema = with_type(planes.schema, **{out: DATA, "h": T.IntegerType(), "w": T.IntegerType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = batch.column("h").to_numpy(), batch.column("w").to_numpy()
            for lo, hi in even_stretches(h, w):
                rows = batch.slice(lo, hi - lo)
                made = np.asarray(kernel(matrix(rows.column(data)).reshape(-1, int(h[lo]), int(w[lo]))))
                new = {out: lists(made), "h": pa.array(np.full(len(made), made.shape[1], np.int32)), "w": pa.array(np.full(len(made), made.shape[2], np.int32))}
                yield pa.RecordBatch.from_arrays([new[n] if n in new else rows.column(n) for n in schema.names], names=schema.names)

    return planes.mapInArrow(run, schema)


def to_planes(pixels: DataFrame, block: Sequence[str], h: int, w: int, value: str = "v") -> DataFrame:
    """(block, h, w, data) of dense or sparse pixels; a missing pixel is 0. A plane's rows meet in one task, as columns of numbers."""
    block = list(block)
    kept = pixels.select(*block, "y", "x", pixels[value].cast("double").alias(value))
    schema = T.StructType([*[kept.schema[b] for b in block], T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("data", DATA)])

    def run(table: pa.Table) -> pa.Table:
        data = np.zeros(h * w)
        data[table.column("y").to_numpy().astype(np.int64) * w + table.column("x").to_numpy()] = table.column(value).fill_null(0).to_numpy()
        own = table.select(block).slice(0, 1)
        return pa.table([*own.columns, pa.array([h], pa.int32()), pa.array([w], pa.int32()), lists(data[None])], names=schema.names)

    return kept.groupBy(*block).applyInArrow(run, schema)


def over_volumes(planes: DataFrame, block: Sequence[str], kernel: Kernel, halo: int, tile: int = 256, depth: int | None = None, fill: float = 0.0) -> DataFrame:
    """Planes (block, z, h, w, data) through a kernel of volumes (z, y, x) that looks at most `halo` pixels away in y and x.

    The kernel mirrors or pads at the volume's own edges. Where tiles meet, its results within the halo are left
    to the neighbour. Planes of a volume have one height and width. With `depth` volumes have planes 0 to depth - 1: the kernel
    gets those that are missing filled with `fill`, and no planes come of them; else a volume's planes are taken as they follow each other.
    """
    block = list(block)
    keys = T.StructType([planes.schema[b] for b in [*block, "z"]])
    whole = [T.StructField(n, T.IntegerType()) for n in ("h", "w")]
    place = [T.StructField(n, T.IntegerType()) for n in ("ty", "tx", "y0", "x0", "th", "tw")]
    cut = T.StructType([*keys, *whole, *place, T.StructField("data", DATA)])
    narrow = planes.select(*block, "z", planes["h"].cast("int").alias("h"), planes["w"].cast("int").alias("w"), "data")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                h, w = row.column("h")[0].as_py(), row.column("w")[0].as_py()
                plane = matrix(row.column("data")).reshape(h, w)
                for ty in range(-(-h // tile)):
                    for tx in range(-(-w // tile)):
                        y0, x0 = max(0, ty * tile - halo), max(0, tx * tile - halo)
                        part = plane[y0 : (ty + 1) * tile + halo, x0 : (tx + 1) * tile + halo]
                        numbers = [pa.array([n], pa.int32()) for n in (ty, tx, y0, x0, *part.shape)]
                        yield pa.RecordBatch.from_arrays([*[row.column(n) for n in [*keys.names, "h", "w"]], *numbers, lists(part.reshape(1, -1))], names=cut.names)

    def filtered(table: pa.Table) -> pa.Table:
        table = table.sort_by("z").combine_chunks()
        one = {n: table.column(n)[0].as_py() for n in ("h", "w", "ty", "tx", "y0", "x0", "th", "tw")}
        stack = matrix(table.column("data").combine_chunks()).reshape(-1, one["th"], one["tw"])
        if depth is None:
            stack = kernel(stack)
        else:
            at, whole_stack = table.column("z").to_numpy().astype(np.int64), np.full((depth, *stack.shape[1:]), fill)
            whole_stack[at] = stack
            stack = kernel(whole_stack)[at]
        y, x = one["ty"] * tile - one["y0"], one["tx"] * tile - one["x0"]
        core = stack[:, y : y + min(tile, one["h"] - one["ty"] * tile), x : x + min(tile, one["w"] - one["tx"] * tile)]
        new = {"data": lists(core), **{n: pa.array(np.full(len(core), v, np.int32)) for n, v in (("y0", one["ty"] * tile), ("x0", one["tx"] * tile), ("th", core.shape[1]), ("tw", core.shape[2]))}}
        return pa.table([new[n] if n in new else table.column(n) for n in cut.names], names=cut.names)

    out = T.StructType([*keys, *whole, T.StructField("data", DATA)])

    def joined(table: pa.Table) -> pa.Table:
        plane = np.zeros((table.column("h")[0].as_py(), table.column("w")[0].as_py()))
        for r in range(table.num_rows):
            y, x, h, w = (table.column(n)[r].as_py() for n in ("y0", "x0", "th", "tw"))
            plane[y : y + h, x : x + w] = matrix(table.column("data").slice(r, 1).combine_chunks()).reshape(h, w)
        own = table.select([*keys.names, "h", "w"]).slice(0, 1)
        return pa.table([*own.columns, lists(plane.reshape(1, -1))], names=out.names)

    made = narrow.mapInArrow(tiles, cut).groupBy(*block, "ty", "tx").applyInArrow(filtered, cut).groupBy(*block, "z").applyInArrow(joined, out)
    rest = [c for c in planes.columns if c not in ("h", "w", "data", *block, "z")]
    return made if not rest else planes.drop("h", "w", "data").join(made, [*block, "z"])


# Kernels: the last one, two or three axes of a stack.


def mirrored(stack: np.ndarray, reach: Sequence[int]) -> np.ndarray:
    """The stack with its mirror image, edge values doubled, beyond the edges of its last axes."""
    return np.pad(stack, [(0, 0)] * (stack.ndim - len(reach)) + [(r, r) for r in reach], mode="symmetric")


def median(stack: np.ndarray, size: Sequence[int], missing: bool = False) -> np.ndarray:
    """The median of windows of odd sizes over the last axes; with `missing` of their values that aren't NaN, of an even number the mean of the middle two."""
    wide, axes = mirrored(stack, [s // 2 for s in size]), tuple(range(-len(size), 0))
    windows = np.lib.stride_tricks.sliding_window_view(wide, tuple(size), axes)
    n, out = int(np.prod(size)), np.empty(stack.shape)
    rows, axis = max(1, VALUES // max(1, n * stack[..., :1, :].size)), stack.ndim - 2
    for lo in range(0, stack.shape[-2], rows):
        part = windows[(slice(None),) * axis + (slice(lo, lo + rows),)]
        flat = part.reshape(*part.shape[: stack.ndim], n)
        if missing and np.isnan(flat).any():
            flat, known = np.sort(flat, axis=-1), np.maximum(n - np.isnan(flat).sum(-1, keepdims=True), 1)
            middle = [np.take_along_axis(flat, k, -1)[..., 0] for k in ((known - 1) // 2, known // 2)]
            out[..., lo : lo + rows, :] = (middle[0] + middle[1]) / 2
        else:
            out[..., lo : lo + rows, :] = np.partition(flat, n // 2, axis=-1)[..., n // 2]
    return out


def correlate(stack: np.ndarray, weights: Sequence[float], axis: int) -> np.ndarray:
    """A filter of odd length along one axis, mirrored at the edges."""
    r, moved = len(weights) // 2, np.moveaxis(stack, axis, 0)
    wide = np.pad(moved, [(r, r)] + [(0, 0)] * (stack.ndim - 1), mode="symmetric")
    out = np.zeros(moved.shape)
    for k, w in enumerate(weights):
        out += w * wide[k : k + len(moved)]
    return np.moveaxis(out, 0, axis)


def shifts(reach: Sequence[int]) -> list[tuple[int, ...]]:
    return [tuple(int(d) - r for d, r in zip(o, reach, strict=True)) for o in np.ndindex(*[2 * r + 1 for r in reach])]


def neighbours(stack: np.ndarray, offsets: Sequence[tuple[int, ...]], fill: float = 0.0) -> Iterator[np.ndarray]:
    """For each offset of the last axes the values at it; beyond the edges is `fill`."""
    n = len(offsets[0])
    reach = [max(abs(o[k]) for o in offsets) for k in range(n)]
    wide = np.pad(stack, [(0, 0)] * (stack.ndim - n) + [(r, r) for r in reach], constant_values=fill)
    for o in offsets:
        yield wide[(..., *[slice(r + d, r + d + s) for r, d, s in zip(reach, o, stack.shape[-n:], strict=True)])]
