"""Edits of one object at a time: splitting it by seeds and constraining a drawn region.

A single object's plane is what these work on, cut to its bounding box by an aggregate before it is brought
together, so images and movies stay spread over tasks.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import cut
from ..functions.tiles import CELLS, gathered, stacks, stacks_of_one_shape, whole_groups


def lower_envelope(line: np.ndarray) -> np.ndarray:
    """(line, i): the least of f(j) + (i - j)**2 over all j, of lines of values f; infinite where all are.

    The parabolas that are lowest somewhere are kept from left to right with where each one begins, all lines at once.
    """
    lines, n = line.shape
    row = np.arange(lines)
    base, begin, count = np.zeros((lines, n), np.int64), np.zeros((lines, n)), np.zeros(lines, np.int64)
    for q in range(n):
        new = np.flatnonzero(np.isfinite(line[:, q]))
        open_ = new[count[new] > 0]
        while len(open_):
            last = base[open_, count[open_] - 1]
            cross = (line[open_, q] + q * q - line[open_, last] - last * last) / (2 * (q - last))
            hidden = cross <= begin[open_, count[open_] - 1]
            begin[open_[~hidden], np.minimum(count[open_[~hidden]], n - 1)] = cross[~hidden]
            count[open_[hidden]] -= 1
            open_ = open_[hidden]
            first = open_[count[open_] == 0]
            open_ = open_[count[open_] > 0]
            begin[first, 0] = -np.inf
        begin[new[count[new] == 0], 0] = -np.inf
        base[new, count[new]] = q
        count[new] += 1
    out, at = np.full(line.shape, np.inf), np.zeros(lines, np.int64)
    some = row[count > 0]
    for q in range(n):
        ahead = some[(at[some] + 1 < count[some])]
        while len(ahead := ahead[begin[ahead, at[ahead] + 1] < q]):
            at[ahead] += 1
            ahead = ahead[at[ahead] + 1 < count[ahead]]
        own = base[some, at[some]]
        out[some, q] = line[some, own] + (q - own) ** 2
    return out


def squared_distance(mask: np.ndarray, apart: int = 0) -> np.ndarray:
    """Of each pixel the squared distance to the nearest pixel that isn't in the mask, axis by axis; infinite without one. The first `apart` axes tell arrays apart."""
    out = np.where(mask, np.inf, 0.0)
    for axis in range(apart, mask.ndim):
        turned = np.moveaxis(out, axis, -1)
        out = np.moveaxis(lower_envelope(turned.reshape(-1, turned.shape[-1])).reshape(turned.shape), -1, axis)
    return out


def flood(height: np.ndarray, mask: np.ndarray, seeds: list[tuple[int, ...]], apart: int = 0) -> np.ndarray:
    """Basins 1.. of the seeds: pixels of the mask by rising height, each to the basin that reaches it first through a face.

    Pixels wait in one queue for each height, so what is sorted are heights, not pixels. The first `apart` axes tell
    arrays apart: no basin goes along them, so each array's pixels take their turns as if it were alone.
    """
    wide = [(int(k >= apart),) * 2 for k in range(mask.ndim)]
    inner = np.pad(mask, wide)  # no step leaves the array
    out, tall = np.where(inner, 0, -1).ravel().tolist(), np.pad(height, wide).ravel().tolist()
    widths = [int(np.prod(inner.shape[k + 1 :])) for k in range(apart, mask.ndim)]
    steps = [d for n in reversed(widths) for d in (n, -n)]
    queues: dict[float, deque[int]] = {}
    levels: list[float] = []

    def wait(p: int) -> None:
        queue = queues.get(tall[p])
        if queue is None:
            queues[tall[p]] = deque((p,))
            heapq.heappush(levels, tall[p])
        else:
            queue.append(p)

    for k, s in enumerate(seeds, 1):
        p = int(np.ravel_multi_index([n + w for n, (w, _) in zip(s, wide, strict=True)], inner.shape))
        if mask[s]:
            out[p] = k
            wait(p)
    while levels:
        now = levels[0]
        queue = queues[now]
        while queue and levels[0] == now:
            p = queue.popleft()
            own = out[p]
            for d in steps:
                if not out[p + d]:
                    out[p + d] = own
                    wait(p + d)
        if levels[0] == now:
            heapq.heappop(levels)
            del queues[now]
    return np.maximum(out, 0).reshape(inner.shape)[tuple(slice(w, n - w) for n, (w, _) in zip(inner.shape, wide, strict=True))]


def split_by_seeds(labels: DataFrame, seeds: DataFrame, block: Sequence[str], label: str = "label", axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """Labels of planes or volumes with two or more seeds (block, label, axes, seed) in several: the first seed's part keeps the id.

    Others get ids after the block's largest, by label and seed. Parts are basins of the distance to the
    object's edge. Objects without two seeds are left alone. A task holds the boxes of some small objects or of one.
    """
    block, axes = list(block), list(axes)
    keys = [*block, label]
    there = labels.where(F.col(label) != 0).select(*block, *axes, F.col(label).cast("long").alias(label))
    points = seeds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seed", *axes))).alias("__seeds")).where(F.size("__seeds") > 1)
    asked = there.join(points, keys).repartition(*keys).sortWithinPartitions(*keys)
    schema = there.withColumn("part", F.lit(1)).schema

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_groups(gathered(batches), keys):
            size = np.diff(np.r_[start, table.num_rows])
            at = [table.column(a).to_numpy().astype(np.int64) for a in axes]
            low = [np.minimum.reduceat(c, start) - 1 for c in at]
            place = [c - np.repeat(n, size) for c, n in zip(at, low, strict=True)]
            beyond = [p + 1 for p in place]  # boxes have a margin on either side
            own = table.column("__seeds").take(pa.array(start)).combine_chunks()
            owner, each = np.repeat(np.arange(len(start)), own.value_lengths().to_numpy()), own.flatten()
            point = [each.field(a).to_numpy(zero_copy_only=False).astype(np.int64) - n[owner] for a, n in zip(axes, low, strict=True)]
            inside = np.logical_and.reduce([(p >= 0) & (p <= np.maximum.reduceat(b, start)[owner]) for p, b in zip(point, beyond, strict=True)])
            owner, point = owner[inside], [p[inside] for p in point]
            number = np.arange(len(owner)) - np.searchsorted(owner, owner) + 1  # a seed's, in its object
            part = np.ones(table.num_rows, np.int32)
            for lo, hi, box in stacks(start, beyond, CELLS):
                rows, some = slice(start[lo], start[lo] + size[lo:hi].sum()), slice(*np.searchsorted(owner, [lo, hi]))
                cells = (np.repeat(np.arange(hi - lo), size[lo:hi]), *[p[rows] for p in place])
                mask = np.zeros((hi - lo, *box), bool)
                mask[cells] = True
                begin = list(zip((owner[some] - lo).tolist(), *[p[some].tolist() for p in point], strict=True))
                part[rows] = np.r_[1, number[some]][flood(-squared_distance(mask, apart=1), mask, begin, apart=1)[cells]]
            out = table.select([*block, *axes, label]).append_column("part", pa.array(part))
            yield from out.combine_chunks().to_batches()

    parts = cut(asked.mapInArrow(split, schema))
    top = there.groupBy(*block).agg(F.max(label).alias("__top"))
    fresh = parts.where("part > 1").select(*block, label, "part").distinct()
    numbered = fresh.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct(label, "part"))).alias("__a")).join(top, block)
    numbered = numbered.select(*block, "__top", F.posexplode("__a").alias("__k", "__s")).select(*block, F.col(f"__s.{label}").alias(label), F.col("__s.part").alias("part"), (F.col("__top") + F.col("__k") + 1).alias("__new"))
    renamed = parts.join(numbered, [*block, label, "part"], "left").select(*block, *axes, F.coalesce("__new", label).alias(label))
    return there.join(points.select(*block, label), [*block, label], "left_anti").select(*block, *axes, label).unionByName(renamed)


def grown(mask: np.ndarray, rounds: int, edge: bool = False) -> np.ndarray:
    """Planes, the last two axes, with the neighbours of what is in them, round by round."""
    for _ in range(rounds):
        wide = np.pad(mask, [(0, 0)] * (mask.ndim - 2) + [(1, 1)] * 2, constant_values=edge)
        mask = wide[..., 1:-1, 1:-1] | wide[..., :-2, 1:-1] | wide[..., 2:, 1:-1] | wide[..., 1:-1, :-2] | wide[..., 1:-1, 2:]
    return mask


def reached(start: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """What of the mask hangs together, by faces in its plane, with the start. Planes of a stack that grow no more are left out of further rounds."""
    shape = mask.shape
    mask = mask if mask.ndim > 2 else mask[None]
    now, open_ = start & mask, np.arange(len(mask))
    while len(open_):
        before = now[open_]
        new = grown(before, 1) & mask[open_]
        now[open_] = new
        open_ = open_[(new != before).any(axis=(-2, -1))]
    return now.reshape(shape)


def constrained(region: np.ndarray, seed: np.ndarray, free: np.ndarray, most: float, smooth: float) -> np.ndarray:
    """Regions of planes, or of a stack of planes, that only grow the seed: inside what is free, near enough, smoothed, without holes or islands."""
    region = (region | seed) & free
    if most > 0:
        region &= squared_distance(~seed, apart=seed.ndim - 2) <= most * most
    if smooth > 0:
        n = round(smooth)
        region = grown(region, n)
        region = ~grown(~region, 2 * n)
        region = (grown(region, n) | seed) & free
    outside = np.zeros_like(region)
    outside[..., [0, -1], :] = outside[..., [0, -1]] = True
    region = ~reached(outside, ~region) & free
    return np.where((seed & region).any(axis=(-2, -1), keepdims=True), reached(seed, region), seed)


def constrain_regions(drawn: DataFrame, block: Sequence[str], max_px: float = 0, smooth_px: float = 0) -> DataFrame:
    """(block, y, x) of the constrained region of each block of (block, y, x, region, seed, free).

    A task gets what lies in the box of a block's region and seed, with a margin that smoothing can reach; boxes of one shape are dealt with together.
    """
    block = list(block)
    schema = drawn.select(*block, "y", "x").schema
    margin = 2 * round(max(0, smooth_px)) + 1
    ends = {f"__{f}{a}": getattr(F, f)(a) for f in ("min", "max") for a in "yx"}
    box = drawn.where("region OR seed").groupBy(*block).agg(*[c.alias(n) for n, c in ends.items()])
    near = F.lit(True)
    for a in "yx":
        near = near & F.col(a).between(F.col(f"__min{a}") - margin, F.col(f"__max{a}") + margin)
    drawn = drawn.join(box, block).where(near).select(drawn.columns)

    def constrain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_groups(gathered(batches), block):
            flags = [table.column(c).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False) for c in ("region", "seed", "free")]
            kept = np.zeros(table.num_rows, bool)
            for rows, cells, full in stacks_of_one_shape(table, start, ["y", "x"], CELLS):
                planes = []
                for flag in flags:
                    p = np.zeros(full, bool)
                    p[cells] = flag[rows]
                    planes.append(p)
                kept[rows] = constrained(*planes, max_px, smooth_px)[cells]
            yield from table.select([*block, "y", "x"]).filter(pa.array(kept)).combine_chunks().to_batches()

    return drawn.repartition(*block).sortWithinPartitions(*block).mapInArrow(constrain, schema)
