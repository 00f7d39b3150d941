"""Label statistics and curation: sizes, mean intensities, relabelling, edits, contacts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graph import Scratch, connected
from ..functions.grid import beside
from ..plans.registry import register


@register("Remove Small Labels", "_rm_small")
def remove_small_labels(labels: DataFrame, block: Sequence[str] = ("image_id",), min_size: int = 100, label: str = "label") -> DataFrame:
    """Drops labels of `min_size` pixels or fewer of their block; background is left out."""
    there = labels.where(F.col(label) != 0)
    kept = there.groupBy(*block, label).agg(F.count("*").alias("__n")).where(F.col("__n") > min_size).drop("__n")
    return there.join(kept, [*block, label], "left_semi")


def label_means(labels: DataFrame, block: Sequence[str], value: str = "v", label: str = "label") -> DataFrame:
    """(block, label, mean, size) of every label."""
    return labels.where(F.col(label) != 0).groupBy(*block, label).agg(F.avg(value).alias("mean"), F.count("*").alias("size"))


def medoids_of(values: np.ndarray, weights: np.ndarray, k: int, rounds: int = 300) -> np.ndarray:
    """Medoids of weighted distinct sorted values on a line: evenly spaced seeds, then nearest medoid and weighted median by turns."""
    if len(values) <= k:
        return values
    now = values[np.unique(np.rint(np.linspace(0, len(values) - 1, k)).astype(int))]
    total = np.concatenate([[0], np.cumsum(weights)])
    for _ in range(rounds):
        # Clusters are stretches of the sorted values; one at a boundary belongs to the lower cluster.
        ends = np.concatenate([[0], np.searchsorted(values, (now[:-1] + now[1:]) / 2, "right"), [len(values)]])
        middle = (total[ends[:-1]] + total[ends[1:]]) / 2
        at = np.minimum(np.searchsorted(total, middle, "left") - 1, len(values) - 1)
        new = np.unique(np.where(ends[1:] > ends[:-1], values[np.maximum(at, ends[:-1])], now))
        if np.array_equal(new, now):
            break
        now = new
    return now


def kmedoids_threshold(means: DataFrame, block: Sequence[str], n_clusters: int = 2) -> DataFrame:
    """(block, medoids, threshold): the middle between the two lowest medoids of a block's means; null if all are equal.

    Means are reduced to distinct ones with their numbers first, so a task gets one row for each.
    """
    distinct = means.groupBy(*block, "mean").agg(F.count("*").alias("n"))
    sorted_means = distinct.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("mean", "n"))).alias("__m"))

    @F.pandas_udf("array<double>")
    def medoids(values: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([medoids_of(np.asarray(v), np.asarray(w), n_clusters).tolist() for v, w in zip(values, weights, strict=True)])

    found = sorted_means.select(*block, medoids(F.col("__m.mean"), F.col("__m.n")).alias("medoids"))
    return found.withColumn("threshold", (F.get("medoids", F.lit(0)) + F.get("medoids", F.lit(1))) / 2)


@register("Filter Labels by Intensity (K-medoids)", "_intensity_filtered")
def intensity_label_filter(labels: DataFrame, block: Sequence[str] = ("image_id",), n_clusters: int = 2, value: str = "v", label: str = "label", strict: bool = False) -> DataFrame:
    """Drops labels whose mean is below their block's threshold. Blocks with one distinct mean stay, or with `strict` raise."""
    means = label_means(labels, block, value, label)
    found = kmedoids_threshold(means, block, n_clusters)
    if strict and not found.where("threshold IS NULL").isEmpty():
        raise ValueError("cannot tell clusters apart: all labels of an image share the same mean intensity")
    low = means.join(found, list(block)).where(F.col("mean") < F.col("threshold")).select(*block, label)
    return labels.where(F.col(label) != 0).join(low, [*block, label], "left_anti")


def clustering_stats(labels: DataFrame, block: Sequence[str] = ("image_id",), n_clusters: int = 2, value: str = "v", label: str = "label") -> DataFrame:
    """(block, label, mean, size, cluster, kept): what the filter saw of each label; cluster 0 is the lowest."""
    means = label_means(labels, block, value, label)
    wide = means.join(kmedoids_threshold(means, block, n_clusters), list(block))
    m = F.col("medoids")
    bounds = F.transform(F.sequence(F.lit(1), F.greatest(F.size(m) - 1, F.lit(1))), lambda k: F.when(F.size(m) > k, (m[k - 1] + F.get(m, k)) / 2))
    cluster = F.size(F.filter(bounds, lambda b: b < F.col("mean")))
    return wide.select(*block, label, "mean", "size", cluster.alias("cluster"), (F.col("threshold").isNull() | (F.col("mean") >= F.col("threshold"))).alias("kept"))


#: Replacements up to which a map is written into the plan.
LITERAL = 100


def relabel(labels: DataFrame, mapping: dict[int, int], t: int | None = None, label: str = "label") -> DataFrame:
    """All replacements of a map at once, in all frames or in one; 0 deletes."""
    if not mapping:
        return labels
    if len(mapping) > LITERAL:  # a long log of edits is a table; it came from the driver, so it is small enough to be sent to all
        rows = labels.sparkSession.createDataFrame(list(mapping.items()), "__old long, __new long")
        met = labels.join(F.broadcast(rows), (F.col(label) == F.col("__old")) & (F.lit(True) if t is None else F.col("t") == t), "left")
        return met.withColumn(label, F.coalesce(F.col("__new").cast(labels.schema[label].dataType), F.col(label))).drop("__old", "__new")
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    new = F.coalesce(table[F.col(label)], F.col(label))
    return labels.withColumn(label, new if t is None else F.when(F.col("t") == t, new).otherwise(F.col(label)))


def delete_labels(labels: DataFrame, ids: Iterable[int], t: int | None = None, label: str = "label") -> DataFrame:
    return relabel(labels, dict.fromkeys(ids, 0), t, label)


def compose(edits: Sequence[dict[int, int]]) -> dict[int, int]:
    """One map that does what the edits do one after another; ids that come back to themselves are left out."""
    whole: dict[int, int] = {}
    for edit in edits:
        whole = {k: edit.get(v, v) for k, v in whole.items()} | {k: v for k, v in edit.items() if k not in whole}
    return {k: v for k, v in whole.items() if k != v}


def apply_edits(labels: DataFrame, edits: Sequence[dict[int, int]], undone: int = 0, label: str = "label") -> DataFrame:
    """Edits in order, without the last `undone`, as one replacement."""
    return relabel(labels, compose(edits[: len(edits) - undone]), label=label)


def apply_lookup(labels: DataFrame, lookup: DataFrame, keys: Sequence[str], new: str, label: str = "label") -> DataFrame:
    """Labels by a table (keys, label, new); what the table lacks becomes 0."""
    return labels.join(lookup.select(*keys, label, F.col(new).alias("__new")), [*keys, label], "left").withColumn(label, F.coalesce("__new", F.lit(0))).drop("__new")


def around(labels: DataFrame, block: Sequence[str], axes: Sequence[str], label: str = "label") -> DataFrame:
    """(block, axes, label, other): for each labelled pixel the other labels that it touches, diagonals included.

    A pixel is sent to each of its neighbours' places and meets what is there.
    """
    there = labels.where(F.col(label) != 0).select(*block, *axes, label)
    steps = F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(axes, o, strict=True)]) for o in np.ndindex(*[3] * len(axes)) if any(d != 1 for d in o)])
    sent = there.withColumn("__o", F.explode(steps)).select(*block, *[(F.col(a) + F.col(f"__o.{a}") - 1).alias(a) for a in axes], F.col(label).alias("other"))
    return there.join(sent, [*block, *axes]).where(F.col(label) != F.col("other"))


def contact_counts(labels: DataFrame, block: Sequence[str], axes: Sequence[str], label: str = "label") -> DataFrame:
    """(block, label, other, contact): pixels of `other` in the ring of one pixel around `label`, each counted once."""
    touched = around(labels, block, axes, label)
    pairs = touched.select(*block, *axes, F.col("other").alias("label"), F.col(label).alias("__in")).distinct()
    return pairs.groupBy(*block, "label", F.col("__in").alias("other")).agg(F.count("*").alias("contact"))


def touching_neighbors(labels: DataFrame, block: Sequence[str], axes: Sequence[str], label: str = "label") -> DataFrame:
    """(block, label, other): labels that touch."""
    return around(labels, block, axes, label).select(*block, F.col(label).alias("label"), "other").distinct()


def merge_neighbors(labels: DataFrame, target: int, block: Sequence[str], axes: Sequence[str], label: str = "label") -> DataFrame:
    """What touches the target in a block becomes the target there."""
    near = touching_neighbors(labels, block, axes, label).where(F.col("label") == target).select(*block, F.col("other").alias(label)).withColumn("__near", F.lit(True))
    return labels.join(near, [*block, label], "left").withColumn(label, F.when(F.col("__near"), target).otherwise(F.col(label))).drop("__near")


def touching_lists(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pixels `at` touch each one, with corners: where each one's list begins, and the lists end to end."""
    low = at.min(0) - 1
    code = np.ravel_multi_index(tuple((at - low).T), at.max(0) - low + 2)
    order = np.argsort(code)
    steps = np.array([o for o in np.ndindex(*[3] * at.shape[1]) if any(k != 1 for k in o)]) - 1
    scale = np.r_[np.cumprod((at.max(0) - low + 2)[:0:-1])[::-1], 1]
    here, there = [], []
    for jump in (steps * scale).sum(1):
        place = np.searchsorted(code[order], code + jump)
        hit = (place < len(code)) & (code[order[np.minimum(place, len(code) - 1)]] == code + jump)
        here.append(np.flatnonzero(hit))
        there.append(order[place[hit]])
    here, there = np.concatenate(here), np.concatenate(there)
    return np.r_[0, np.cumsum(np.bincount(here, minlength=len(at)))], there[np.argsort(here, kind="stable")]


class Cluster:
    """Labelled pixels as a graph of those that touch, and which pixels each label has."""

    def __init__(self, at: np.ndarray, ids: np.ndarray) -> None:
        self.at, self.label = at, ids.copy()
        self.start, self.near = touching_lists(at)
        order = np.argsort(ids, kind="stable")
        cuts = np.flatnonzero(np.diff(ids[order])) + 1
        self.pixels = {int(ids[own[0]]): own for own in np.split(order, cuts)}

    def votes(self, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> Counter:
        """How many pixels between two corners each other label has that touch those pixels."""
        counts = self.start[own + 1] - self.start[own]
        upto = np.cumsum(counts)
        touched = self.near[np.repeat(self.start[own] - upto + counts, counts) + np.arange(counts.sum())]
        touched = np.setdiff1d(touched, own)
        return Counter(self.label[touched[self.between(touched, low, high)]].tolist())

    def between(self, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return ((self.at[own] >= low) & (self.at[own] <= high)).all(1)

    def give(self, name: int, own: np.ndarray, to: int) -> None:
        self.label[own] = to
        self.pixels[name] = np.setdiff1d(self.pixels[name], own)
        if to:
            self.pixels[to] = np.concatenate([self.pixels[to], own])


def merge_cluster(at: np.ndarray, ids: np.ndarray, small: np.ndarray, min_size: int, passes: int = 50) -> np.ndarray:
    """New ids of labelled pixels `at`, of which those with `small` belong to labels that may move.

    A pass takes labels that are small at its beginning in order of their ids, with the boxes that they have then, one pixel
    wider. One moves what it has in its box to the label of which most pixels in the box touch that, if it can to one that is not
    small; of equals to the smallest id; without any to 0.
    """
    cluster, movable = Cluster(at, ids), set(ids[small].tolist())
    for _ in range(passes):
        tiny = {n for n in movable if 0 < len(cluster.pixels[n]) < min_size}
        boxes = {n: (at[cluster.pixels[n]].min(0) - 1, at[cluster.pixels[n]].max(0) + 1) for n in tiny}
        for name in sorted(tiny):
            own = cluster.pixels[name]
            own = own[cluster.between(own, *boxes[name])]
            votes = cluster.votes(own, *boxes[name])
            votes.pop(0, None)
            able = {n: k for n, k in votes.items() if n not in tiny} or votes
            cluster.give(name, own, min(able, key=lambda n: (-able[n], n), default=0))
        if not tiny:
            break
    return cluster.label


@register("Merge Small Labels to Neighbors", "_merged")
def merge_small_labels(labels: DataFrame, block: Sequence[str] = ("image_id",), axes: Sequence[str] = ("y", "x"), min_size: int = 100, label: str = "label") -> DataFrame:
    """Labels of fewer than `min_size` pixels become the neighbour they touch most, large ones first; without neighbours, 0.

    What a small label becomes depends on the order of the small labels that hang together with it, and on the pixels
    around those. So each such cluster and its ring go to a task, not their image; all other pixels stay where they are.
    """
    block, axes = list(block), list(axes)
    scratch = Scratch(labels.sparkSession)
    there = labels.where(F.col(label) != 0).select(*block, *axes, F.col(label).cast("long").alias(label))
    sizes = there.groupBy(*block, label).agg(F.count("*").alias("__n"))
    marked = scratch.cut(there.join(sizes, [*block, label]).withColumn("__small", F.col("__n") < min_size).drop("__n"))
    small = marked.where("__small").drop("__small")
    # Pixels that touch small ones: small ones link their labels, large ones are the ring.
    steps = F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(axes, o, strict=True)]) for o in np.ndindex(*[3] * len(axes))])
    sent = small.withColumn("__o", F.explode(steps)).select(*block, *[(F.col(a) + F.col(f"__o.{a}") - 1).alias(a) for a in axes], F.col(label).alias("__from")).distinct()
    met = scratch.cut(marked.join(sent, [*block, *axes]))
    node = lambda c: F.struct(*block, F.col(c).alias("__label"))
    clusters = connected(met.where("__small").select(node("__from").alias("a"), node(label).alias("b")))
    cluster = clusters.select(*[F.col(f"node.{b}").alias(b) for b in block], F.col("node.__label").alias("__from"), F.col("label.__label").alias("__cluster"))
    own = met.join(cluster, [*block, "__from"]).select(*block, *axes, label, "__small", "__cluster").distinct()
    schema = T.StructType([*[there.schema[c] for c in [*block, *axes]], T.StructField(label, T.LongType())])

    def merge(table: pa.Table) -> pa.Table:
        is_small = table.column("__small").to_numpy()
        at = np.stack([table.column(a).to_numpy().astype(np.int64) for a in axes], 1)
        new = merge_cluster(at, table.column(label).to_numpy(), is_small, min_size)
        kept = table.filter(pa.array(is_small)).select([*block, *axes])
        return kept.append_column(label, pa.array(new[is_small])).filter(pa.array(new[is_small] != 0))

    merged = own.groupBy(*block, "__cluster").applyInArrow(merge, schema)
    return marked.where("NOT __small").select(*block, *axes, label).unionByName(merged)


def small_component_filter(components: DataFrame, block: Sequence[str], fraction: float, label: str = "label") -> DataFrame:
    """Drops components of fewer than max(8, ceil(median size * fraction)) pixels of their block."""
    sizes = components.where(F.col(label) != 0).groupBy(*block, label).agg(F.count("*").alias("__n"))
    kept = beside(sizes, block, __median=F.median("__n")).where(F.col("__n") >= F.greatest(F.lit(8), F.ceil(F.col("__median") * fraction)))
    return components.where(F.col(label) != 0).join(kept.select(*block, label), [*block, label], "left_semi")
