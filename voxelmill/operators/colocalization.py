"""Colocalization of two or three channels on one grid, per region of the first channel.

The channels are columns of one relation (block, coordinates, c1, c2, c3); `on_grid` makes it from separate
images. Everything is one or two aggregations by block and c1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_grid(first: DataFrame, others: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Images (keys, value) side by side where the first has a row; what the others lack is 0."""
    out = first
    for name, df in others.items():
        out = out.join(df, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def stats(value: Column, where: Column, prefix: str) -> list[Column]:
    """Mean, median, population deviation and maximum where a condition holds, 0 if it never does."""
    v = F.when(where, value)
    each = {"mean": F.avg(v), "median": F.median(v), "std": F.stddev_pop(v), "max": F.max(v)}
    return [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"{prefix}_{k}") for k, c in each.items()]


def distinct_where(value: Column, where: Column) -> Column:
    return F.count_distinct(F.when(where & (value != 0), value))


def coloc_counts(grid: DataFrame, block: Sequence[str], c1: str = "c1", c2: str = "c2") -> DataFrame:
    """Distinct objects of c2 in each region of c1."""
    return grid.where(F.col(c1) != 0).groupBy(*block, c1).agg(distinct_where(F.col(c2), F.lit(True)).alias("ch2_in_ch1_count"))


def coloc_sizes(grid: DataFrame, block: Sequence[str], c1: str = "c1", c2: str = "c2", c3: str = "c3") -> DataFrame:
    """Sizes of regions and of what is in them of the others."""
    in2, in3 = F.col(c2) != 0, F.col(c3) != 0
    return grid.where(F.col(c1) != 0).groupBy(*block, c1).agg(
        F.count("*").alias("ch1_size"), F.count_if(in2).alias("ch2_in_ch1_size"), F.count_if(in2 & in3).alias("ch3_in_ch2_in_ch1_size"), F.count_if(~in2 & in3).alias("ch3_not_in_ch2_but_in_ch1_size")
    )


def coloc_intensity(grid: DataFrame, block: Sequence[str], c1: str = "c1", value: str = "v") -> DataFrame:
    """Intensities of another channel in each region of c1."""
    return grid.where(F.col(c1) != 0).groupBy(*block, c1).agg(*stats(F.col(value), F.lit(True), "ch2_in_ch1"))


def coloc_three_channel(grid: DataFrame, block: Sequence[str], c1: str = "c1", c2: str = "c2", c3: str = "c3", value: str | None = None) -> DataFrame:
    """Objects of c3, or intensities, inside and outside of c2 within each region of c1."""
    in2, there = F.col(c2) != 0, grid.where(F.col(c1) != 0)
    if value:
        out = [*stats(F.col(value), in2, "ch3_in_ch2_in_ch1"), *stats(F.col(value), ~in2, "ch3_not_in_ch2_but_in_ch1")]
    else:
        there = there.select(*block, c1, c2, c3).distinct()  # voxels by their labels, before three distinct counts multiply them
        out = [distinct_where(F.col(c3), in2).alias("ch3_in_ch2_in_ch1_count"), distinct_where(F.col(c3), ~in2).alias("ch3_not_in_ch2_but_in_ch1_count")]
    return there.groupBy(*block, c1).agg(distinct_where(F.col(c2), F.lit(True)).alias("ch2_in_ch1_count"), *out)


def coloc_intensity_third(grid: DataFrame, block: Sequence[str], c1: str = "c1", c2_value: str = "v", c3: str | None = None, c3_value: str | None = None) -> DataFrame:
    """Intensities of the second channel in each region of c1, with the objects of c3 there and their size, or its intensities."""
    if (c3 is None) == (c3_value is None):
        raise ValueError("the third channel is labels or intensities")
    third = stats(F.col(c3_value), F.lit(True), "ch3_in_ch1") if c3_value else [distinct_where(F.col(c3), F.lit(True)).alias("ch3_in_ch1_count"), F.count_if(F.col(c3) != 0).alias("ch3_in_ch1_size")]
    return grid.where(F.col(c1) != 0).groupBy(*block, c1).agg(*stats(F.col(c2_value), F.lit(True), "ch2_in_ch1"), *third)


def shares(positive: Column) -> list[Column]:
    n, total = F.count_if(positive), F.count("*")
    return [total.alias("total_c2_objects"), n.alias("positive_c2_objects"), (total - n).alias("negative_c2_objects"), (n / total * 100).alias("percent_positive")]


def coloc_positive_labels(grid: DataFrame, block: Sequence[str], c1: str = "c1", c2: str = "c2", c3: str = "c3") -> DataFrame:
    """Objects of c2 with and without any pixel of c3, in each region of c1 that has objects of c2."""
    objects = grid.where((F.col(c1) != 0) & (F.col(c2) != 0)).groupBy(*block, c1, c2).agg(F.max(F.col(c3) != 0).alias("hit"))
    return objects.groupBy(*block, c1).agg(*shares(F.col("hit")))


def coloc_positive_intensity(grid: DataFrame, block: Sequence[str], c1: str = "c1", c2: str = "c2", value: str = "v", threshold_method: str = "percentile", threshold_value: float = 75.0) -> DataFrame:
    """Objects of c2 whose mean reaches a percentile of the values over all c2 pixels of the region, or an absolute value."""
    there = grid.where((F.col(c1) != 0) & (F.col(c2) != 0))
    objects = there.groupBy(*block, c1, c2).agg(F.avg(value).alias("mean"))
    if threshold_method == "percentile":
        limit = there.groupBy(*block, c1).agg(F.percentile(value, threshold_value / 100).alias("threshold_used"))
        objects = objects.join(limit, [*block, c1])
    else:
        objects = objects.withColumn("threshold_used", F.lit(float(threshold_value)))
    return objects.groupBy(*block, c1).agg(*shares(F.col("mean") >= F.col("threshold_used")), F.first("threshold_used").alias("threshold_used"))


def coloc_individual(grid: DataFrame, block: Sequence[str], c1: str = "c1", c2: str = "c2", c3: str = "c3", value: str | None = None) -> DataFrame:
    """A row for each object of c2 in each region of c1: both sizes, and objects and pixels of c3 or intensities."""
    there = grid.where(F.col(c1) != 0)
    sizes = there.groupBy(*block, c1).agg(F.count("*").alias("ch1_size"))
    v = F.lit(True)
    more = [F.avg(value).alias("ch3_mean"), F.median(value).alias("ch3_median"), F.stddev_pop(value).alias("ch3_std")] if value else [distinct_where(F.col(c3), v).alias("ch3_count"), F.count_if(F.col(c3) != 0).alias("ch3_size")]
    objects = there.where(F.col(c2) != 0).groupBy(*block, c1, c2).agg(F.count("*").alias("ch2_size"), *more)
    return objects.join(sizes, [*block, c1])


def coloc_overlap_image(grid: DataFrame, c1: str = "c1", c2: str = "c2", c3: str = "c3") -> DataFrame:
    """The region ids, those where c2 is, and those where c3 is, as three channels."""
    kept = lambda c: F.when(F.col(c) != 0, F.col(c1)).otherwise(0)
    return grid.where(F.col(c1) != 0).withColumns({"overlap1": F.col(c1), "overlap2": kept(c2), "overlap3": kept(c3)})
