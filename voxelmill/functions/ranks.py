"""Exact order statistics of groups of any size, by narrowing: no task ever holds the values of a group.

Of each group and rank a range of values is known that holds the value of that rank. A round cuts the range into even bins, counts
what lies in each, and goes on with the bin where the rank falls, drawn in to its own least and largest value, until
that is one value. A round moves one row a bin, and most data take two or three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import Scratch

BINS = 1024
#: Types with so few values that a group's distinct ones fit into a task.
FEW_VALUES = ("boolean", "tinyint", "smallint", "int")
LARGEST = 1.7976931348623157e308


def many_values(df: DataFrame, value: str) -> bool:
    """Whether a column can have more distinct values in a group than a task should hold: wide integers and floating-point numbers."""
    return df.schema[value].dataType.simpleString() not in FEW_VALUES


def beside_ranges(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], on: Column, how: str = "inner") -> DataFrame:
    """A join by keys that may be null; columns of `ranges` have names of their own, but for the keys, which it gives up."""
    other = ranges.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return rows.join(other, on, how).drop(*[f"__r_{k}" for k in keys])


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """(keys, a column for each of `shares`): percentiles, linear between values, of each group's values.

    Nulls and NaN are no values; a group without values has none. Infinite values count as the largest finite ones. Keys may be null.
    """
    if not shares or any(not 0 <= s <= 1 for s in shares.values()):
        raise ValueError("shares are between 0 and 1")
    keys, scratch = list(keys), Scratch(df.sparkSession)
    finite = F.greatest(F.least(F.col(value).cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, finite.alias("__v"))
    groups = rows.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("share")) for n, s in shares.items()]))
    state = groups.withColumn("__s", wanted).select(*keys, "__lo", "__hi", F.col("__s.name").alias("__name"), ((F.col("__n") - 1) * F.col("__s.share")).alias("__at"), F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__many"))
    state = scratch.cut(state.withColumn("__rank", F.floor("__at").cast("long")))
    while not state.where("__lo < __hi").isEmpty():
        # Ranges of one group that are alike are counted once.
        ranges = state.where("__lo < __hi").select(*keys, F.col("__lo").alias("__a"), F.col("__hi").alias("__z")).distinct()
        inside = beside_ranges(rows, ranges, keys, F.col("__v").between(F.col("__a"), F.col("__z")))
        # Halves first, so that ranges wider than the largest double don't overflow; ranges too narrow to halve part at their least value.
        half = F.col("__z") / 2 - F.col("__a") / 2
        place = F.when(half > 0, F.floor((F.col("__v") / 2 - F.col("__a") / 2) / half * bins)).when(F.col("__v") > F.col("__a"), bins).otherwise(0)
        counted = inside.groupBy(*keys, "__a", "__z", F.least(place, F.lit(bins - 1)).alias("__bin")).agg(F.count("*").alias("__c"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
        line = W.partitionBy(*keys, "__a", "__z").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
        counted = counted.withColumn("__before", F.coalesce(F.sum("__c").over(line), F.lit(0)))
        upto = F.col("__below") + F.col("__before")
        falls = (F.col("__lo") == F.col("__a")) & (F.col("__hi") == F.col("__z")) & (F.col("__rank") >= upto) & (F.col("__rank") < upto + F.col("__c"))
        new = beside_ranges(state.where("__lo < __hi"), counted, keys, falls)
        new = new.select(*keys, F.col("__min").alias("__lo"), F.col("__max").alias("__hi"), "__name", "__at", "__rank", upto.alias("__below"), F.col("__c").alias("__many"))
        before, state = state, scratch.cut(state.where("__lo = __hi").unionByName(new))
        scratch.drop(before)
    # The value after the rank's own: the same one where it is there often enough, else the next larger one.
    alone = (F.col("__below") + F.col("__many") == F.col("__rank") + 1) & (F.col("__at") > F.col("__rank"))
    ends = state.where(alone).select(*keys, F.col("__lo").alias("__a")).distinct()
    after = beside_ranges(rows, ends, keys, F.col("__v") > F.col("__a")).groupBy(*keys, "__a").agg(F.min("__v").alias("__next"))
    found = beside_ranges(state, after, keys, (F.col("__lo") == F.col("__a")) & alone, "left")
    share, high = F.col("__at") - F.col("__rank"), F.coalesce("__next", "__lo")
    exact = found.select(*keys, "__name", F.when(share > 0, F.col("__lo") + (high - F.col("__lo")) * share).otherwise(F.col("__lo")).alias("__p"))
    return exact.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == n, F.col("__p"))).alias(n) for n in shares])
