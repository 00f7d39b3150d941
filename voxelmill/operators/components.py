"""Connected components of equal pixels, with diagonals, in images of any number of axes.

Pixels are dealt into tiles and labelled there by union-find; components that go over a tile's edge are nodes of
a graph of the seams, whose components name them anew. So pixels move once, what is joined are pixels at the tiles'
edges, and the graph grows with the seams' length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graph import connected, cut
from ..functions.tiles import SIDES, roots, seam_edges, tile_components
from ..plans.registry import register
from .thresholds import otsu_semantic

#: Edges of seams that the driver connects by itself; more are connected by joins.
FEW_EDGES = 1 << 16


def joined_at_seams(rows: DataFrame, edges: DataFrame, node: str, few: int | None = None) -> DataFrame:
    """`rows` with the smallest node of its component in place of each node (a struct) that `edges` (a, b) connect.

    Up to `few` edges are connected by the driver, which gets no more than these; more by joins.
    """
    few = FEW_EDGES if few is None else few
    pairs = [(r["a"], r["b"]) for r in edges.limit(few + 1).collect()]
    if not pairs:
        return rows
    if len(pairs) > few:
        named = connected(edges).toDF("__n", "__l")
    else:
        nodes = sorted({n for pair in pairs for n in pair})
        number = {n: k for k, n in enumerate(nodes)}
        root = roots(len(nodes), *(np.array([number[pair[k]] for pair in pairs], np.int64) for k in (0, 1)))
        kind = edges.schema["a"].dataType
        named = edges.sparkSession.createDataFrame([(n, nodes[r]) for n, r in zip(nodes, root.tolist(), strict=True)], T.StructType([T.StructField("__n", kind), T.StructField("__l", kind)]))
    return rows.join(named, F.col(node) == F.col("__n"), "left").withColumn(node, F.coalesce("__l", node)).drop("__n", "__l")


def components(pixels: DataFrame, block: Sequence[str], axes: Sequence[str], value: str = "v", full: bool = True, side: int | None = None) -> DataFrame:
    """(block, axes, value, first): for each nonzero pixel the first pixel of its component, as coordinates in scan order.

    With `full` pixels touch at corners too, else at faces. `side` is that of the tiles.
    """
    block, axes = list(block), list(axes)
    side = side or SIDES.get(len(axes), 16)
    found = cut(tile_components(pixels, block, axes, value, full, side))
    edges = seam_edges(found, block, axes, value, full, side)
    node = F.struct(*block, *[F.col(f"root.{a}").alias(a) for a in axes])
    out = joined_at_seams(found.withColumn("__node", node), edges, "__node")
    return out.select(*block, *axes, value, F.struct(*[F.col(f"__node.{a}").alias(a) for a in axes]).alias("first"))


def numbered(found: DataFrame, block: Sequence[str], axes: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Components (first) numbered from 1 in each block, by `order`: one row a component is ranked, not one a pixel."""
    each = found.select(*block, *[c for c in order if c != "first"], "first").distinct()
    ids = each.withColumn("label", F.row_number().over(W.partitionBy(*block).orderBy(*order)))
    on = [*block, *[c for c in order if c != "first"], "first"]
    return found.join(ids, on).select(*block, *axes, "label")


@register("Binary to Labels", "_labels")
def binary_to_labels(pixels: DataFrame, block: Sequence[str] = ("image_id",), axes: Sequence[str] = ("y", "x"), value: str = "v") -> DataFrame:
    """(block, axes, label): components of equal values, numbered in scan order; background is left out."""
    return numbered(components(pixels, block, axes, value), block, axes, ["first"])


@register("Semantic to Instance", "_instance")
def semantic_to_instance(pixels: DataFrame, block: Sequence[str] = ("image_id",), axes: Sequence[str] = ("y", "x"), value: str = "v") -> DataFrame:
    """(block, axes, label): components of each class, numbered class by class, so no class shares an id with another."""
    return numbered(components(pixels, block, axes, value), block, axes, [value, "first"])


@register("Otsu Thresholding (instance)", "_otsu_labels")
def otsu_instance(pixels: DataFrame, block: Sequence[str] = ("image_id",), axes: Sequence[str] = ("y", "x"), value: str = "v") -> DataFrame:
    """(block, axes, label): components of what is above Otsu's threshold of a block."""
    return binary_to_labels(otsu_semantic(pixels, block, value), block, axes, value)


def fuse_labels(labels: DataFrame, block: Sequence[str], axes: Sequence[str], label: str = "label") -> DataFrame:
    """Components of all that is labelled, ids ignored, so touching objects become one."""
    return binary_to_labels(labels.select(*block, *axes, (F.col(label) != 0).cast("int").alias("v")), block, axes)
