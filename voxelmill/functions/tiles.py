"""Labelling inside tiles: components of dense arrays by union-find in numpy, and pixels as the tiles they lie in.

A task holds one tile. What crosses its edges is left to a graph of the components that meet there, whose size goes
with the seams' length, not with the image.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pixels along each axis of a tile, by the number of axes.
SIDES = {1: 1 << 16, 2: 512, 3: 64, 4: 24}
#: Cells of the stack of tiles that are labelled at a time.
CELLS = 1 << 21
#: Rows of Arrow batches that are put together, so that many small groups are dealt with at a time.
ROWS = 1 << 17


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of the component of each of n nodes, for edges a - b.

    All edges hook the larger root to the smaller one at once, then paths are halved until they are flat; rounds go
    with the logarithm of the components' width.
    """
    parent = np.arange(n)
    while len(a):
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            onward = parent[parent]
            if np.array_equal(onward, parent):
                break
            parent = onward
    return parent


def steps(axes: int, full: bool) -> list[tuple[int, ...]]:
    """Half of a pixel's neighbours, those after it in scan order: with corners or at faces only."""
    every = [o for o in itertools.product((-1, 0, 1), repeat=axes) if o > (0,) * axes]
    return every if full else [o for o in every if sum(map(abs, o)) == 1]


def shifted(array: np.ndarray, offset: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Two views of an array, cell by cell the pairs of a cell and the one at the offset from it."""
    here = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(offset, array.shape, strict=True))
    there = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(offset, array.shape, strict=True))
    return array[here], array[there]


def label_array(values: np.ndarray, full: bool = True, apart: int = 0) -> np.ndarray:
    """Components of equal nonzero values, numbered from 1 in scan order; 0 elsewhere. Nothing touches along the first `apart` axes.

    Stretches along the last axis are nodes; neighbours on other lines are edges.
    """
    there = values != 0
    begins = there.copy()
    begins[..., 1:] &= ~(there[..., :-1] & (values[..., 1:] == values[..., :-1]))
    node = np.cumsum(begins, dtype=np.int64).reshape(values.shape) * there
    edges = [np.zeros((0, 2), np.int64)]
    for o in steps(values.ndim, full):
        if any(o[:-1]) and not any(o[:apart]):
            (a, b), (v, w) = shifted(node, o), shifted(values, o)
            met = (a > 0) & (b > 0) & (v == w)
            pairs = np.stack([a[met], b[met]], axis=1)
            edges.append(pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]] if len(pairs) else pairs)
    a, b = np.unique(np.concatenate(edges), axis=0).T
    root = roots(int(node.max(initial=0)) + 1, a, b)
    number = np.cumsum(root == np.arange(len(root))) - 1  # of roots, in scan order; node 0 is the background
    return number[root][node]


def label_stack(values: np.ndarray, full: bool = True) -> np.ndarray:
    """`label_array` of each array of a stack, numbered from 1 in each."""
    found = label_array(values, full, apart=1)
    before = np.maximum.accumulate(np.r_[0, found.reshape(len(found), -1).max(axis=1, initial=0)[:-1]]) if len(found) else np.zeros(0, np.int64)
    return np.where(found > 0, found - before.reshape(-1, *[1] * (values.ndim - 1)), 0)


def dense(table: pa.Table, axes: Sequence[str], value: str) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """The values of a tile's pixels in their bounding box, their places in it, and its first corner."""
    at = [table.column(a).to_numpy().astype(np.int64) for a in axes]
    low = np.array([c.min() for c in at])
    place = tuple(c - n for c, n in zip(at, low, strict=True))
    own = table.column(value).fill_null(0).to_numpy(zero_copy_only=False)
    box = np.zeros([int(p.max()) + 1 for p in place], own.dtype)
    box[place] = own
    return box, place, low


def tile_of(axes: Sequence[str], side: int) -> dict:
    """Columns that tell tiles apart, `__t` and the axis."""
    return {f"__t{a}": F.floor(F.col(a) / side).cast("long") for a in axes}


def changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; true for the first row."""
    out = np.ones(table.num_rows, bool)
    same = np.ones(max(0, table.num_rows - 1), bool)
    for k in keys:
        a, b = table.column(k).slice(1), table.column(k).slice(0, max(0, table.num_rows - 1))
        equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        same &= equal.to_numpy(zero_copy_only=False) if isinstance(equal, pa.Array) else equal.to_numpy()
    out[1:] = ~same
    return out


def gathered(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of at least `rows` rows, the last of what is left."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= (rows or ROWS):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by keys, and where each group begins; the last group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.Table.from_batches([*held[-1:], batch])
        before = held[-1].num_rows if held else 0
        at = np.flatnonzero(changes(both, keys)[before:]) if held else np.flatnonzero(changes(both, keys)[1:]) + 1
        if not len(at):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch.slice(0, int(at[-1]))])
        if table.num_rows:
            yield table, np.flatnonzero(changes(table, keys))
        held = [batch.slice(int(at[-1]))]
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.flatnonzero(changes(table, keys))


def stacks(start: np.ndarray, place: Sequence[np.ndarray], most: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """Ranges of groups, and the box that holds each of a range, with up to `most` cells together, or one group."""
    boxes = np.stack([np.maximum.reduceat(p, start) + 1 for p in place], axis=1)
    lo = 0
    while lo < len(start):
        box, hi = boxes[lo], lo + 1
        while hi < len(start) and (hi + 1 - lo) * np.prod(wider := np.maximum(box, boxes[hi])) <= most:
            box, hi = wider, hi + 1
        yield lo, hi, tuple(int(n) for n in box)
        lo = hi


def stacks_of_one_shape(table: pa.Table, start: np.ndarray, axes: Sequence[str], most: int) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...], tuple[int, ...]]]:
    """Groups whose pixels have bounding boxes of one shape, up to `most` cells together, or one group: their rows, the rows' cells (group and axes) and the stack's shape."""
    size = np.diff(np.r_[start, table.num_rows])
    at = [table.column(a).to_numpy().astype(np.int64) for a in axes]
    place = [c - np.repeat(np.minimum.reduceat(c, start), size) for c in at]
    boxes, kind = np.unique(np.stack([np.maximum.reduceat(p, start) + 1 for p in place], axis=1), axis=0, return_inverse=True)
    by_shape = np.split(np.argsort(kind.ravel(), kind="stable"), np.cumsum(np.bincount(kind.ravel()))[:-1])
    for box, own in zip(boxes, by_shape, strict=True):
        each = max(1, most // int(np.prod(box)))
        for lo in range(0, len(own), each):
            groups = own[lo : lo + each]
            n = size[groups]
            rows = np.arange(n.sum()) + np.repeat(start[groups] - np.cumsum(n) + n, n)
            yield rows, (np.repeat(np.arange(len(groups)), n), *[p[rows] for p in place]), (len(groups), *map(int, box))


def tile_components(pixels: DataFrame, block: Sequence[str], axes: Sequence[str], value: str, full: bool, side: int) -> DataFrame:
    """(block, axes, value, root): nonzero pixels with the first pixel of their component within the tile, as a struct of axes.

    Pixels are dealt by tile and sorted, and many small images are labelled as one stack: one shuffle.
    """
    block, axes, tiles = list(block), list(axes), tile_of(axes, side)
    kept = pixels.select(*block, *axes, value).where(F.col(value) != 0)
    schema = T.StructType([*[kept.schema[c] for c in (*block, *axes, value)], T.StructField("root", T.StructType([kept.schema[a] for a in axes]))])
    names = list(tiles)
    keys = [*block, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_groups(batches, keys):
            at = [table.column(a).to_numpy().astype(np.int64) for a in axes]
            origin = [table.column(t).to_numpy() * side for t in names]
            place = [a - o for a, o in zip(at, origin, strict=True)]
            values = table.column(value).to_numpy()
            end = np.r_[start[1:], table.num_rows]
            for lo, hi, box in stacks(start, place, CELLS):
                rows = slice(start[lo], end[hi - 1])
                group = np.repeat(np.arange(hi - lo), end[lo:hi] - start[lo:hi])
                cells = (group, *[p[rows] for p in place])
                stack = np.zeros((hi - lo, *box), np.int8 if values.dtype == bool else values.dtype)
                stack[cells] = values[rows]
                found = label_array(stack, full, apart=1)
                highest = np.maximum.accumulate(found.ravel(), out=np.empty(found.size, np.int64))
                first = np.flatnonzero(np.diff(highest, prepend=0))  # components are numbered as they begin
                corner = np.unravel_index(first[found[cells] - 1], found.shape)[1:]
                own = table.slice(start[lo], end[hi - 1] - start[lo])
                root = [pa.array(c + o[rows]).cast(table.schema.field(a).type) for c, o, a in zip(corner, origin, axes, strict=True)]
                out = own.select([*block, *axes, value]).append_column("root", pa.StructArray.from_arrays(root, names=axes))
                yield from out.combine_chunks().to_batches()

    dealt = kept.withColumns(tiles).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def seam_edges(found: DataFrame, block: Sequence[str], axes: Sequence[str], value: str, full: bool, side: int) -> DataFrame:
    """(a, b): components (block and root as structs) of neighbouring pixels of one value in different tiles.

    Only pixels at the tiles' edges are read and joined.
    """
    block, axes = list(block), list(axes)
    edge = F.lit(False)
    for a in axes:
        edge |= F.pmod(F.col(a), F.lit(side)).isin(0, side - 1)
    node = F.struct(*block, *[F.col(f"root.{a}").alias(a) for a in axes])
    rows = found.where(edge).select(*block, *axes, value, node.alias("a"))
    step = F.explode(F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(axes, o, strict=True)]) for o in steps(len(axes), full)]))
    moved = rows.withColumn("__s", step)
    crosses = F.lit(False)
    for a in axes:
        crosses |= F.floor(F.col(a) / side) != F.floor((F.col(a) + F.col(f"__s.{a}")) / side)
    moved = moved.where(crosses).select(*block, *[(F.col(a) + F.col(f"__s.{a}")).alias(a) for a in axes], value, "a")
    return moved.join(rows.withColumnRenamed("a", "b"), [*block, *axes, value]).select("a", "b").distinct()
