"""Projections, slice ranges, mirrors, intersections and nearest-neighbour resizing of grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import register


@register("Max Z Projection", "_max_z")
def max_projection(pixels: DataFrame, axis: str = "z", value: str = "v") -> DataFrame:
    """The maximum along one axis, the first of the image's unless another is named."""
    return pixels.groupBy(*[c for c in pixels.columns if c not in (axis, value)]).agg(F.max(value).alias(value))


@register("Max Z Projection (TZYX)", "_maxZ_tzyx")
def max_projection_tzyx(pixels: DataFrame, value: str = "v") -> DataFrame:
    """The maximum along z of each frame."""
    if missing := {"t", "z", "y", "x"} - set(pixels.columns):
        raise ValueError(f"a TZYX image has {sorted(missing)} too")
    return max_projection(pixels.select(*[c for c in ("image_id",) if c in pixels.columns], "t", "z", "y", "x", value), "z", value)


def slice_areas(labels: DataFrame, block: Sequence[str], axis: str, size: int, label: str) -> DataFrame:
    """(block, axis, area): labelled pixels of every slice, also of slices without any."""
    counted = labels.groupBy(*block, axis).agg(F.count_if(F.col(label) != 0).alias("area"))
    grid = counted.select(*block).distinct().withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return grid.join(counted, [*block, axis], "left").select(*block, axis, F.coalesce("area", F.lit(0)).alias("area"))


@register("Keep Slice Range by Area", "_area_range")
def keep_slice_range_by_area(labels: DataFrame, block: Sequence[str], axis: str, size: int, label: str = "label") -> DataFrame:
    """Slices from the first of least to the first of most labelled pixels, whichever comes first; all if all are equal."""
    area = slice_areas(labels, block, axis, size, label)
    at = area.groupBy(*block).agg(F.min_by(axis, F.struct("area", axis)).alias("__a"), F.max_by(axis, F.struct("area", -F.col(axis))).alias("__b"), (F.min("area") == F.max("area")).alias("__even"))
    kept = F.col("__even") | F.col(axis).between(F.least("__a", "__b"), F.greatest("__a", "__b"))
    return labels.join(at, list(block)).where(kept).drop("__a", "__b", "__even")


@register("Mirror Labels", "_mirrored")
def mirror_labels(labels: DataFrame, block: Sequence[str], axis: str, size: int, label: str = "label") -> DataFrame:
    """Labels mirrored at the first slice of most labelled pixels, ids moved beyond the largest; background is left out."""
    area = slice_areas(labels, block, axis, size, label)
    pivot = area.groupBy(*block).agg(F.max_by(axis, F.struct("area", -F.col(axis))).alias("__m"))
    top = labels.groupBy(*block).agg(F.max(label).alias("__top"))
    there = labels.where(F.col(label) != 0).join(pivot, list(block)).join(top, list(block))
    moved = there.withColumns({axis: 2 * F.col("__m") - F.col(axis), label: F.col(label) + F.col("__top")})
    return moved.where(F.col(axis).between(0, size - 1)).drop("__m", "__top")


def half_even(x: Column) -> Column:
    return F.rint(x).cast("int")


@register("Intersect Label Images", "_intersected")
def intersect_labels(primary: DataFrame, secondary: DataFrame, block: Sequence[str], axes: Sequence[str], shape: dict[str, int], other_shape: dict[str, int], label: str = "label") -> DataFrame:
    """Primary ids where the secondary has a label too.

    If the shapes differ the secondary is first moved so that the centres of the bounding boxes agree, the
    shift rounded half to even; a part that leaves either grid is cut off.
    """
    own, other = primary.where(F.col(label) != 0), secondary.where(F.col(label) != 0)
    if shape != other_shape:
        box = lambda df, tag: df.groupBy(*block).agg(*[((F.min(a) + F.max(a) + 1) / 2).alias(f"__{tag}_{a}") for a in axes])
        moved = other.join(box(own, "p").join(box(other, "s"), list(block)), list(block))
        shifted = {a: F.col(a) + half_even(F.col(f"__p_{a}") - F.col(f"__s_{a}")) for a in axes}
        other = moved.withColumns(shifted).where(" AND ".join(f"{a} BETWEEN 0 AND {shape[a] - 1}" for a in axes))
    return own.join(other.select(*block, *axes).distinct(), [*block, *axes], "left_semi")


def zoom_map(n: int, scale: float) -> list[tuple[int, int]]:
    """(source, target) indices of an axis of n that is scaled to the nearest and centred in n again."""
    new = round(n * scale)
    offset = int((n - new) / 2)
    out = []
    for target in range(n):
        j = target - offset
        if 0 <= j < new:
            out.append((min(n - 1, int((j + 0.5) * n / new)), target))
    return out


def zoomed_to(source: Column, n: Column, scale: float) -> Column:
    """`zoom_map` where the length of the axis is a column: the targets of one source index."""
    new = F.rint(n * scale)
    offset = ((n - new) / 2).cast("int")
    first, last = F.floor(source * new / n) - 1, F.ceil((source + 1) * new / n) + 1
    own = lambda j: (j >= 0) & (j < new) & (F.least(n - 1, F.floor((j + 0.5) * n / new)) == source) & (j + offset >= 0) & (j + offset < n)
    return F.transform(F.filter(F.sequence(first.cast("int"), last.cast("int")), own), lambda j: (j + offset).cast("int"))


@register("Resize Labels (Nearest)", "_scaled")
def resize_labels(labels: DataFrame, axes: dict[str, int | str], scale_factor: float = 1.0, label: str = "label") -> DataFrame:
    """Objects scaled about the centre of the grid, which keeps its size; background is left out.

    axes: the length of each, or the column that has it. Every axis has a map from source to target indices; a row meets
    it by itself, so no rows are shuffled and a source pixel becomes as many targets as the map says.
    """
    out = labels.where(F.col(label) != 0)
    if scale_factor == 1.0:
        return out
    for axis, n in axes.items():
        if isinstance(n, str):
            out = out.withColumn(axis, F.explode(zoomed_to(F.col(axis), F.col(n), scale_factor)))
            continue
        targets: list[list[int]] = [[] for _ in range(n)]
        for source, target in zoom_map(n, scale_factor):
            targets[source].append(target)
        table = F.array(*[F.array(*[F.lit(t) for t in ts]).cast("array<int>") for ts in targets])
        out = out.withColumn(axis, F.explode(F.get(table, F.col(axis).cast("int"))))
    return out


@register("Subdivide Labels into 3 Layers", "_layers")
def subdivide_labels(labels: DataFrame, block: Sequence[str], axes: dict[str, int], is_half_body: bool = False, cut_axis: str | None = None, label: str = "label") -> DataFrame:
    """Inner, middle and outer layers: ids, ids + max, ids + 2 * max; where scaled objects overlap the outer one wins.

    A half body is completed by its mirror image along `cut_axis` first, at the end with the larger slice, and
    cut again afterwards.
    """
    block = list(block)
    there = labels.where(F.col(label) != 0).select(*block, *axes, label)
    top = there.groupBy(*block).agg(F.max(label).alias("__top"))
    sizes = dict(axes)
    if is_half_body:
        cut_axis = cut_axis or next(iter(axes))
        area = there.groupBy(*block, cut_axis).agg(F.count("*").alias("__n"))
        ends = area.groupBy(*block).agg(F.min(cut_axis).alias("__lo"), F.max(cut_axis).alias("__hi"), F.min_by("__n", cut_axis).alias("__first"), F.max_by("__n", cut_axis).alias("__last"))
        ends = ends.withColumn("__start", F.col("__first") >= F.col("__last")).withColumn("__n", F.col("__hi") - F.col("__lo") + 1)
        placed = there.join(ends, block)
        i, n, start = F.col(cut_axis) - F.col("__lo"), F.col("__n"), F.col("__start")
        own, other = F.when(start, n + i).otherwise(i), F.when(start, n - 1 - i).otherwise(2 * n - 1 - i)
        whole = placed.withColumn(cut_axis, F.explode(F.array(own, other))).select(*block, *axes, label, (2 * n).alias("__length"))
        out = layered(whole, block, sizes | {cut_axis: "__length"}, top, label)
        back = out.join(ends.select(*block, "__lo", "__n", "__start"), block)
        kept = back.where(F.when(F.col("__start"), F.col(cut_axis) >= F.col("__n")).otherwise(F.col(cut_axis) < F.col("__n")))
        return kept.withColumn(cut_axis, F.col(cut_axis) - F.when(F.col("__start"), F.col("__n")).otherwise(0) + F.col("__lo")).select(*block, *axes, label)
    return layered(there, block, sizes, top, label)


def layered(there: DataFrame, block: list[str], axes: dict[str, int], top: DataFrame, label: str) -> DataFrame:
    keys = [*block, *axes]
    part = lambda scale, name: resize_labels(there, axes, scale, label).select(*keys, F.col(label).alias(name))
    inner, middle = part(0.33, "__inner"), part(0.67, "__middle")
    joined = there.select(*keys, F.col(label).alias("__full")).join(middle, keys, "full").join(inner, keys, "full").join(top, block)
    none = lambda c: F.col(c).isNull()
    out = F.when(~none("__full") & none("__middle"), F.col("__full") + 2 * F.col("__top")).when(~none("__middle") & none("__inner"), F.col("__middle") + F.col("__top")).otherwise(F.col("__inner"))
    return joined.select(*keys, out.alias(label)).where(F.col(label).isNotNull())


def nearest_resample(pixels: DataFrame, axes: dict[str, tuple[int, int]]) -> DataFrame:
    """Axes of (source size, target size) by the nearest index: min(floor((i + 0.5) * source / target), source - 1)."""
    out = pixels
    for axis, (source, target) in axes.items():
        back: list[list[int]] = [[] for _ in range(source)]
        for i in range(target):
            back[min(int((i + 0.5) * source / target), source - 1)].append(i)
        table = F.array(*[F.array(*[F.lit(t) for t in ts]).cast("array<int>") for ts in back])
        out = out.withColumn(axis, F.explode(F.get(table, F.col(axis).cast("int"))))
    return out


def expand_labels(labels: DataFrame, axis: str, size: int) -> DataFrame:
    """One slice of labels copied to every index of an axis."""
    return labels.drop(axis).withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))


def spread_mask(mask: DataFrame, frames: int, labels: DataFrame, axes: Sequence[str], object_id: int) -> DataFrame:
    """A mask of one frame copied to all frames, written only where there is no label yet: (t, axes, label)."""
    everywhere = expand_labels(mask.select(*axes), "t", frames).select("t", *axes)
    free = everywhere.join(labels.where("label <> 0").select("t", *axes), ["t", *axes], "left_anti")
    return free.withColumn("label", F.lit(object_id))


def stacked_view(pixels: DataFrame, depth: int) -> DataFrame:
    """Frames and slices folded to one axis, s = t * depth + z."""
    return pixels.withColumn("s", F.col("t") * depth + F.col("z")).drop("t", "z")
