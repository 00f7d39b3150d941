"""Neighbourhoods in planes and volumes: rank and Gaussian filters, local thresholds, dilation, boundaries, contours.

Those of planes work on `planes`, one row for a YX plane, and shuffle nothing, whatever the radius. Those of volumes
meet in tiles of all planes (`over_volumes`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.planes import correlate, median, neighbours, on_planes, over_volumes, shifts
from ..plans.registry import register

FACES = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]


@register("Median Filter", "_median")
def median_filter(planes: DataFrame, size: int = 3) -> DataFrame:
    """The median of a square of odd `size`, mirrored at the edges."""
    return on_planes(planes, lambda s: median(s, (size, size)))


def median_volume(planes: DataFrame, block: Sequence[str], size: int = 3, depth: int | None = None) -> DataFrame:
    """The median of a cube of odd `size` of planes (block, z, h, w, data) of one volume each, mirrored at the edges.

    With `depth` volumes have planes 0 to depth - 1, and those that are missing have no part in any median.
    """
    return over_volumes(planes, block, lambda v: median(v, (size, size, size), depth is not None), size // 2, depth=depth, fill=math.nan)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def separable(stack: np.ndarray, weights: Sequence[float], axes: Sequence[int]) -> np.ndarray:
    for axis in axes:
        stack = correlate(stack, weights, axis)
    return stack


@register("Gaussian Blur", "_blurred")
def gaussian_blur(planes: DataFrame, sigma: float = 1.0, volume: Sequence[str] | None = None, depth: int | None = None) -> DataFrame:
    """A Gaussian cut off at four sigma, mirrored at the edges: of each plane, or with `volume`, the columns that tell volumes (volume, z, h, w, data) apart, along z too.

    With `depth` volumes have planes 0 to depth - 1, and those that are missing count as zeros.
    """
    if sigma <= 0:
        return planes
    weights = gaussian_weights(sigma)
    if volume is None:
        return on_planes(planes, lambda s: separable(s, weights, (-2, -1)))
    return over_volumes(planes, volume, lambda v: separable(v, weights, (0, 1, 2)), len(weights) // 2, depth=depth)


@register("Adaptive Threshold (Bright Bias)", "_adaptive_bright")
def adaptive_threshold(planes: DataFrame, block_size: int = 35, offset: float = -10) -> DataFrame:
    """255 above the Gaussian mean of a square minus the offset, else 0; an even square size counts as the next odd one."""
    size = block_size + (block_size % 2 == 0)
    weights = gaussian_weights((size - 1) / 6)
    return on_planes(planes, lambda s: np.where(s > separable(s, weights, (-2, -1)) - offset, 255.0, 0.0))


def binary_dilation(planes: DataFrame, full: bool = True, iterations: int = 1) -> DataFrame:
    """1 where a pixel or one around it (with diagonals or faces only) isn't 0."""
    offsets = shifts((1, 1)) if full else FACES

    def grow(s: np.ndarray) -> np.ndarray:
        for _ in range(iterations):
            s = np.any([n != 0 for n in neighbours(s, offsets)], 0).astype(float)
        return s

    return on_planes(planes, grow)


def binary_erosion(planes: DataFrame, full: bool = True, iterations: int = 1, border: float = 0.0) -> DataFrame:
    """1 where a pixel and all around it aren't 0; beyond the edges is `border`."""
    offsets = shifts((1, 1)) if full else FACES

    def shrink(s: np.ndarray) -> np.ndarray:
        for _ in range(iterations):
            s = np.all([n != 0 for n in neighbours(s, offsets, border)], 0).astype(float)
        return s

    return on_planes(planes, shrink)


def label_boundaries(planes: DataFrame, out: str = "data") -> DataFrame:
    """1 on labelled pixels with a different value around them; beyond the edges is background."""
    offsets = [o for o in shifts((1, 1)) if any(o)]
    return on_planes(planes, lambda s: ((s > 0) & np.any([n != s for n in neighbours(s, offsets)], 0)).astype(float), out=out)


@register("Label Contours", "_contours")
def contour_ensemble(planes: DataFrame, block: Sequence[str], source: str, sigma: float | None = None) -> DataFrame:
    """(block, h, w, foreground, data) of several label images (`source` tells them apart) of one scene.

    foreground: 1 where any has a label; data: the mean of their boundaries, blurred and divided by its maximum
    if there is a sigma. Images meet as sums of arrays' elements, one row a pixel.
    """
    own = label_boundaries(planes, "__edge").select(*block, "h", "w", source, F.posexplode(F.arrays_zip("data", "__edge")).alias("p", "s"))
    count = planes.groupBy(*block).agg(F.count_distinct(source).alias("__n"))
    sums = own.groupBy(*block, "h", "w", "p").agg(F.max(F.col("s.data") > 0).cast("double").alias("f"), F.sum("s.__edge").alias("e"))
    plane = sums.join(count, list(block)).groupBy(*block, "h", "w").agg(F.array_sort(F.collect_list(F.struct("p", "f", (F.col("e") / F.col("__n")).alias("e")))).alias("s"))
    out = plane.select(*block, "h", "w", F.transform("s", lambda s: s["f"]).alias("foreground"), F.transform("s", lambda s: s["e"]).alias("data"))
    if not sigma:
        return out
    blurred = gaussian_blur(out, sigma)
    return blurred.withColumn("data", F.when(F.array_max("data") > 0, F.transform("data", lambda v: v / F.array_max("data"))).otherwise(F.col("data")))


def z_walk(areas: DataFrame, block: Sequence[str], axis: str = "z", first: str = "area0", least: float = 0.1, jump: float = 3.0, contrast: float = 0.3) -> DataFrame:
    """Slices of a walk (block, z, area, area0, contrast) up to where it stops: area below a share of the first, above a multiple of the one before, or contrast too low."""
    w = W.partitionBy(*block).orderBy(axis)
    stop = (F.col("area") < least * F.col(first)) | (F.col("area") > jump * F.lag("area").over(w)) | (F.col("contrast") < contrast)
    marked = areas.withColumn("__stop", F.coalesce(stop, F.lit(False)).cast("int"))
    return marked.withColumn("__gone", F.sum("__stop").over(w.rowsBetween(W.unboundedPreceding, 0))).where("__gone = 0").drop("__stop", "__gone")
