"""The relational parts of tracking: candidate edges between frames, tracks applied to labels, a greedy baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.graph import connected, cut
from ..functions.ranking import global_rank
from ..plans.registry import register
from .labels import apply_lookup


@register("Candidate Edges", "_edges")
def candidate_edges(regions: DataFrame, block: Sequence[str] = (), max_dt: int = 3, max_distance: float = 300.0, neighbors: int = 5) -> DataFrame:
    """(block, t1, label1, t2, label2, distance) from each region (t, label, cy, cx) to the nearest ones of the next frames.

    Of all frames within `max_dt` together a region keeps the `neighbors` nearest, ties by frame and label.
    Regions meet over a grid of cells as wide as the distance, so only near ones are compared.
    """
    block = list(block)
    cell = lambda c: F.floor(F.col(c) / max_distance).cast("long")
    later = regions.select(*block, F.col("t").alias("t2"), F.col("label").alias("label2"), F.col("cy").alias("y2"), F.col("cx").alias("x2"), cell("cy").alias("__gy"), cell("cx").alias("__gx"))
    around = F.array(*[F.struct(F.lit(dt).alias("t"), F.lit(dy).alias("y"), F.lit(dx).alias("x")) for dt in range(1, max_dt + 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    early = regions.withColumn("__o", F.explode(around)).select(
        *block, F.col("t").alias("t1"), F.col("label").alias("label1"), F.col("cy").alias("y1"), F.col("cx").alias("x1"),
        (F.col("t") + F.col("__o.t")).alias("t2"), (cell("cy") + F.col("__o.y")).alias("__gy"), (cell("cx") + F.col("__o.x")).alias("__gx"),
    )
    distance = F.sqrt((F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")) + (F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")))
    met = early.join(later, [*block, "t2", "__gy", "__gx"]).withColumn("distance", distance).where(F.col("distance") <= max_distance)
    near = met.withColumn("__r", F.row_number().over(W.partitionBy(*block, "t1", "label1").orderBy("distance", "t2", "label2"))).where(F.col("__r") <= neighbors)
    return near.select(*block, "t1", "label1", "t2", "label2", "distance")


@register("Greedy Links", "_links")
def greedy_link(edges: DataFrame, block: Sequence[str] = ()) -> DataFrame:
    """Edges of a one-to-one assignment, shortest first (ties by labels): a baseline of ours, not a tracker's result.

    An edge that is the shortest at both its ends is what going through all edges in order would take, so
    each round takes all of those and drops the edges that share an end with them.
    """
    block = list(block)
    order = F.struct("distance", "t1", "label1", "t2", "label2")
    out_end, in_end = [*block, "t1", "label1"], [*block, "t2", "label2"]
    left, taken = cut(edges), None
    while not left.isEmpty():
        best = lambda end: F.min(order).over(W.partitionBy(*end))
        won = cut(left.withColumn("__a", best(out_end)).withColumn("__b", best(in_end)).withColumn("__own", order).where("__own = __a AND __own = __b").drop("__a", "__b", "__own"))
        taken = won if taken is None else taken.unionByName(won)
        left = cut(left.join(won.select(*out_end), out_end, "left_anti").join(won.select(*in_end), in_end, "left_anti"))
    return taken if taken is not None else left


def tracks_of(links: DataFrame, regions: DataFrame) -> DataFrame:
    """(t, label, track_id): chains of links as tracks, numbered from 1 in the order of their first region."""
    node = lambda t, c: F.struct(F.col(t).alias("t"), F.col(c).alias("label"))
    own = regions.select(node("t", "label").alias("a"), node("t", "label").alias("b"))
    labels = connected(links.select(node("t1", "label1").alias("a"), node("t2", "label2").alias("b")).union(own))
    firsts = labels.select("label").distinct()
    ranked = global_rank(firsts, "label")
    return labels.join(ranked, "label").select(F.col("node.t").alias("t"), F.col("node.label").alias("label"), (F.col("rank") + 1).alias("track_id"))


@register("Track Cells", "_tracked")
def apply_track_map(labels: DataFrame, tracks: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """Labels replaced by the track ids of their frames; what isn't tracked becomes 0."""
    return apply_lookup(labels, tracks, list(keys), "track_id")


@register("Spot Labels", "_spot_labels")
def spots_to_labels(spots: DataFrame, shape: dict[str, int], radius: int = 2, block: Sequence[str] = ("image_id",)) -> DataFrame:
    """(block, axes, label) of spots (block, spot_id, axes): a disk of points nearer than the radius, in volumes a ball up to it.

    The label is spot_id + 1; where spots overlap the later one is seen. Spots outside of the image are left out.
    """
    axes = list(shape)
    r = range(-radius, radius + 1)
    points = [(0, dy, dx) for dy in r for dx in r if dy * dy + dx * dx < radius * radius] if len(axes) == 2 else [(dz, dy, dx) for dz in r for dy in r for dx in r if dz * dz + dy * dy + dx * dx <= radius * radius]
    steps = F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(axes, p[-len(axes) :], strict=True)]) for p in points])
    centre = {a: F.floor(F.col(a)).cast("int") for a in axes}
    inside = lambda df: df.where(" AND ".join(f"{a} BETWEEN 0 AND {n - 1}" for a, n in shape.items()))
    drawn = inside(spots.withColumns(centre)).withColumn("__s", F.explode(steps))
    placed = inside(drawn.select(*block, "spot_id", *[(F.col(a) + F.col(f"__s.{a}")).alias(a) for a in axes]))
    return placed.groupBy(*block, *axes).agg((F.max("spot_id") + 1).alias("label"))


def confident_spots(spots: DataFrame, block: Sequence[str] = ("image_id",), many: int = 500, least: float = 0.7) -> DataFrame:
    """All spots of images with up to `many`; of others those with a probability above `least`."""
    count = spots.groupBy(*block).agg(F.count("*").alias("__n"))
    return spots.join(count, list(block)).where((F.col("__n") <= many) | (F.col("prob") > least)).drop("__n")
