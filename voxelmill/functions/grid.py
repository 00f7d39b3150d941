"""Pixels, labels and planes.

`pixels` and `labels` are rows of coordinates and a value; a label image leaves its background out. `planes`
hold one YX plane a row, its values in one array in row order, and are what neighbourhoods work on: see
`functions.planes`. Operators take the loop axes as `block` columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YX = ["y", "x"]
ZYX = ["z", "y", "x"]


def to_pixels(planes: DataFrame, block: Sequence[str], value: str = "v") -> DataFrame:
    out = planes.select(*block, "w", F.posexplode("data").alias("p", value))
    return out.select(*block, F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).alias("x"), value)


def beside(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """`df` with statistics of each key's rows: partial sums and a join, so no key's rows meet in one task."""
    if not keys:
        row = df.agg(*[c.alias(k) for k, c in stats.items()]).first()
        return df.withColumns({k: F.lit(row[k]) for k in stats})
    found = df.groupBy(*keys).agg(*[c.alias(k) for k, c in stats.items()])
    return df.join(found, list(keys))


def dense(df: DataFrame, keys: Sequence[str], sizes: dict[str, int], values: Sequence[str]) -> DataFrame:
    """A row for every coordinate of each key's grid of the given sizes; values that are missing are 0."""
    grid = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    for axis, n in sizes.items():
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = grid.select(*keys, *sizes).join(df, [*keys, *sizes], "left")
    return out.select(*keys, *sizes, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])
