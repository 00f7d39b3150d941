"""Region properties and their summaries, as one aggregation over labelled pixels."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import exact_percentiles, many_values
from ..plans.registry import register

#: What each code of a border pixel and its neighbours adds to a perimeter.
PERIMETER = {1.0: (5, 7, 15, 17, 25, 27), 2**0.5: (21, 33), (1 + 2**0.5) / 2: (13, 23)}


@register("Extract Regionprops to CSV", "_regionprops", kind="table")
def regionprops(labels: DataFrame, block: Sequence[str] = ("image_id",), axes: Sequence[str] = ("y", "x"), value: str | None = "v", label: str = "label", size: bool = True, centroid: bool = True, bbox: bool = True, extent: bool = False, moments: bool = False,
                mean: bool = True, median: bool = True, std: bool = True, maximum: bool = False, minimum: bool = False) -> DataFrame:
    """(block, label, ...) of every label above 0 of a block: size, centroid, bounding box, extent, axes of its ellipse, intensities."""
    out: dict[str, Column] = {}
    n = F.count("*")
    if size:
        out["size"] = n
    if centroid:
        out |= {f"centroid_{a}": F.avg(a) for a in axes}
    if bbox:
        out |= {f"bbox_min_{a}": F.min(a) for a in axes} | {f"bbox_max_{a}": F.max(a) + 1 for a in axes}
    if extent:
        box = F.lit(1)
        for a in axes:
            box = box * (F.max(a) - F.min(a) + 1)
        out["extent"] = n / box
    if moments:
        if len(axes) != 2:
            raise ValueError("the ellipse of a region has two axes")
        out |= ellipse(*[F.var_pop(a) + 1 / 12 for a in axes], F.covar_pop(*axes))
    if value:
        stats = {"mean_int": (mean, F.avg), "median_int": (median, F.median), "std_int": (std, F.stddev_pop), "max_int": (maximum, F.max), "min_int": (minimum, F.min)}
        out |= {k: f(value) for k, (wanted, f) in stats.items() if wanted}
    there = labels.where(F.col(label) > 0)
    if not value or not median or not many_values(labels, value):
        return there.groupBy(*block, F.col(label).alias("label")).agg(*[c.alias(k) for k, c in out.items()])
    # Medians of floating-point images don't bring a region's values together.
    keys = [*block, "label"]
    del out["median_int"]
    middle = exact_percentiles(there.select(*block, F.col(label).alias("label"), value), keys, value, {"median_int": 0.5})
    return there.groupBy(*block, F.col(label).alias("label")).agg(*[c.alias(k) for k, c in out.items()]).join(middle, keys, "left")


def ellipse(yy: Column, xx: Column, yx: Column) -> dict[str, Column]:
    """Axis lengths, eccentricity and orientation of the ellipse with these second moments."""
    root = F.sqrt(F.pow((yy - xx) / 2, F.lit(2)) + yx * yx)
    large, small = (yy + xx) / 2 + root, F.greatest((yy + xx) / 2 - root, F.lit(0.0))
    turned = F.when(yy == xx, F.when(yx > 0, np.pi / 4).otherwise(-np.pi / 4)).otherwise(0.5 * F.atan2(2 * yx, yy - xx))
    return {"major_axis": 4 * F.sqrt(large), "minor_axis": 4 * F.sqrt(small), "eccentricity": F.sqrt(1 - small / large), "orientation": turned}


@register("Regionprops Summary Statistics", "_regionprops_summary", kind="table")
def regionprops_summary(regions: DataFrame, group: Sequence[str] = ("image_id",), columns: Sequence[str] = ("size", "mean_int", "median_int", "std_int")) -> DataFrame:
    """(group, label_count, {column}_{sum,mean,median,std}) over regions; the deviation of one region is null."""
    stats = {"sum": F.sum, "mean": F.avg, "median": F.median, "std": F.stddev_samp}
    return regions.groupBy(*group).agg(F.count("*").alias("label_count"), *[f(c).alias(f"{c}_{k}") for c in columns for k, f in stats.items()])


def perimeter(labels: DataFrame, block: Sequence[str], label: str = "label") -> DataFrame:
    """(block, label, perimeter) in the plane: border pixels weighed by the border pixels around them.

    A border pixel is one with a face neighbour outside its region; codes count 2 for each border pixel
    beside it and 10 for each diagonal one.
    """
    keys = [*block, label]
    there = labels.where(F.col(label) > 0).select(*keys, "y", "x")
    sent = lambda df, steps: df.withColumn("__s", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for dy, dx, w in steps]))).select(*keys, (F.col("y") + F.col("__s.dy")).alias("y"), (F.col("x") + F.col("__s.dx")).alias("x"), F.col("__s.w").alias("w"))
    faces = [(0, 1, 1), (0, -1, 1), (1, 0, 1), (-1, 0, 1)]
    full = sent(there, faces).groupBy(*keys, "y", "x").agg(F.sum("w").alias("n")).where("n = 4").drop("n")
    border = there.join(full, [*keys, "y", "x"], "left_anti")
    code = sent(border, [(0, 0, 1), *[(a, b, 2) for a, b, _ in faces], *[(a, b, 10) for a in (1, -1) for b in (1, -1)]]).groupBy(*keys, "y", "x").agg(F.sum("w").alias("code"))
    weight = F.lit(0.0)
    for w, codes in PERIMETER.items():
        weight = F.when(F.col("code").isin(*codes), F.lit(w)).otherwise(weight)
    sums = code.groupBy(*keys).agg(F.sum(weight).alias("perimeter"))
    return sums.select(*block, F.col(label).alias("label"), "perimeter")


def hull_pixels(ys: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
    """Pixels whose centre is in the hull of the mid-edge points of rows of pixels low..high at ys."""
    points = {(y + dy, x + dx) for y, a, b in zip(ys, low, high, strict=True) for x in (a, b) for dy, dx in ((-0.5, 0), (0.5, 0), (0, -0.5), (0, 0.5))}
    chains = []
    for order in (sorted(points), sorted(points, reverse=True)):
        chain: list[tuple[float, float]] = []
        for p in order:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        chains.append(chain)
    hull = np.array(chains[0][:-1] + chains[1][:-1])
    step = np.roll(hull, -1, 0) - hull
    # Of each row the stretch that all edges leave: an edge with its pixels on the right bounds it from the left, and so on.
    y = np.arange(ys.min(), ys.max() + 1)[:, None]
    rising, falling = step[:, 0] > 0, step[:, 0] < 0
    bound = lambda k: hull[k, 1] + (step[k, 1] * (y - hull[k, 0]) - 1e-9) / step[k, 0]
    return int(np.maximum(0, np.floor(bound(falling).min(1)) - np.ceil(bound(rising).max(1)) + 1).sum())


def solidity(labels: DataFrame, block: Sequence[str], label: str = "label") -> DataFrame:
    """(block, label, area, convex_area, solidity) in the plane; a region comes to its task as the ends of its rows, in one row, and a batch of regions is dealt with at a time."""
    rows = labels.where(F.col(label) > 0).groupBy(*block, F.col(label).alias("label"), "y").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
    keys = [*block, "label"]
    whole = rows.groupBy(*keys).agg(F.sum("n").alias("area"), F.collect_list(F.struct("y", "low", "high")).alias("ends"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes) + ", area long, convex_area long, solidity double"

    def hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ends")
            ends, at = column.flatten(), np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
            y, low, high = (ends.field(n).to_numpy() for n in ("y", "low", "high"))
            convex = np.array([hull_pixels(y[a:b], low[a:b], high[a:b]) for a, b in itertools.pairwise(at)], np.int64)
            area = batch.column("area").to_numpy()
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("area"), pa.array(convex), pa.array(area / convex)], names=[*keys, "area", "convex_area", "solidity"])

    return whole.mapInArrow(hulls, schema)
