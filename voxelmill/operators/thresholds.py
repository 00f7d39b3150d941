"""Thresholds from an image's own values: percentiles, Otsu's, and the brightness of tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import beside
from ..functions.ranks import exact_percentiles, many_values
from ..plans.registry import register


@register("Percentile Threshold", "_percentile")
def percentile_threshold(pixels: DataFrame, block: Sequence[str] = ("image_id",), percentile: float = 90, output_type: str = "original", value: str = "v") -> DataFrame:
    """What is above the image's percentile (linear between values): the value itself, or 255, and 0 for the rest."""
    if many_values(pixels, value):
        wide = pixels.join(exact_percentiles(pixels, block, value, {"__p": percentile / 100}), list(block))
    else:
        wide = beside(pixels, list(block), __p=F.percentile(value, percentile / 100))
    kept = F.col(value) if output_type == "original" else F.lit(255)
    return wide.withColumn(value, F.when(F.col(value) > F.col("__p"), kept).otherwise(0)).drop("__p")


def otsu(pixels: DataFrame, block: Sequence[str] = ("image_id",), value: str = "v", bins: int = 256, digits: int | None = None) -> DataFrame:
    """(block, threshold): the value that parts an image in two classes of most variance between, the first of ties.

    With `digits` variances that agree to so many decimals are ties, so sums of floating-point values, whose last bits depend on their order, don't decide.

    Works on the histogram: one row for each value of an integer image, one for each of `bins` even bins of the range, by
    its middle, of a floating-point one. So the cumulative sums are over few rows. An image of one value has that value.
    """
    if pixels.schema[value].dataType.typeName() in ("float", "double"):
        wide = beside(pixels.where(F.col(value).isNotNull() & ~F.isnan(value)), list(block), __lo=F.min(value), __hi=F.max(value))
        lo, step = F.col("__lo").cast("double"), (F.col("__hi").cast("double") - F.col("__lo")) / bins
        middle = lo + (F.least(F.floor((F.col(value) - lo) / step), F.lit(bins - 1)) + 0.5) * step
        pixels = wide.withColumn(value, F.when(step > 0, middle).otherwise(lo)).drop("__lo", "__hi")
    hist = pixels.groupBy(*block, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    up, whole = W.partitionBy(*block).orderBy("v"), W.partitionBy(*block)
    run = lambda c: F.sum(c).over(up.rowsBetween(W.unboundedPreceding, 0))
    sums = hist.select(*block, "v", run(F.col("n")).alias("n1"), run(F.col("n") * F.col("v")).alias("s1"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s"))
    n2, s2 = F.col("n") - F.col("n1"), F.col("s") - F.col("s1")
    apart = F.col("s1") / F.col("n1") - s2 / F.nullif(n2, F.lit(0))
    between = F.coalesce(F.col("n1").cast("double") * n2 * apart * apart, F.lit(-1.0))
    between = between if digits is None else F.round(between, digits)
    return sums.groupBy(*block).agg(F.max_by("v", F.struct(between.alias("b"), -F.col("v"))).alias("threshold"))


@register("Otsu Thresholding (semantic)", "_otsu_semantic")
def otsu_semantic(pixels: DataFrame, block: Sequence[str] = ("image_id",), value: str = "v") -> DataFrame:
    """1 above Otsu's threshold of its block, else 0. For most dimension orders a block is one plane."""
    found = pixels.join(otsu(pixels, block, value), list(block))
    return found.withColumn(value, (F.col(value) > F.col("threshold")).cast("int")).drop("threshold")


def track_brightness(movie: DataFrame, percentile: float = 50.0, block: Sequence[str] = (), label: str = "label", value: str = "v") -> DataFrame:
    """(block, label, brightness): a percentile, by nearest rank, of the values of a label over all frames, as a share of the movie's range."""
    block = list(block)
    extent = movie.groupBy(*block).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    hist = movie.where(F.col(label) != 0).groupBy(*block, label, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = W.partitionBy(*block, label)
    ranked = hist.withColumn("upto", F.sum("n").over(w.orderBy("v").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    at = ranked.where(F.col("upto") >= percentile / 100.0 * F.col("total")).groupBy(*block, label).agg(F.min("v").alias("at"))
    if block:
        wide = at.join(extent, block)
    else:
        row = extent.first()
        wide = at.withColumns({"lo": F.lit(row["lo"]), "hi": F.lit(row["hi"])})
    share = F.when(F.col("hi") > F.col("lo"), (F.col("at") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return wide.select(*block, label, share.alias("brightness"))


def delete_low_intensity_tracks(movie: DataFrame, threshold: float, percentile: float = 50.0, block: Sequence[str] = (), label: str = "label", value: str = "v") -> DataFrame:
    """Labels less bright than the threshold become 0 in all frames; a threshold of 0 or less deletes nothing."""
    if threshold <= 0:
        return movie
    dark = track_brightness(movie, percentile, block, label, value).where(F.col("brightness") < threshold).select(*block, label).withColumn("__gone", F.lit(True))
    return movie.join(dark, [*block, label], "left").withColumn(label, F.when(F.col("__gone"), 0).otherwise(F.col(label))).drop("__gone")
