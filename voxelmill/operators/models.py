"""Steps with a model: any callable on planes, volumes in batches, and what is done before and after it.

Weights are not ours; a user gives a function that Spark ships to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.planes import DATA, lists, matrix, on_planes, with_type
from ..plans.registry import register
from .components import semantic_to_instance
from .enhance import resize_weights
from .inspection import clip_to_mask, model_input


def in_tiles(plane: np.ndarray, model: Callable[[np.ndarray], np.ndarray], tile: int, overlap: int) -> np.ndarray:
    """A plane by tiles that overlap their neighbours; of an overlap each tile gives its own half."""
    (h, w), step = plane.shape, tile - overlap
    starts = [[0] if n <= tile else [*range(0, n - tile, step), n - tile] for n in (h, w)]
    edges = [[0, *[(a + tile + b) // 2 for a, b in zip(s, s[1:], strict=False)], n] for s, n in zip(starts, (h, w), strict=True)]
    out = np.empty(plane.shape)
    for y, y0, y1 in zip(starts[0], edges[0], edges[0][1:], strict=False):
        for x, x0, x1 in zip(starts[1], edges[1], edges[1][1:], strict=False):
            made = model(plane[y : y + tile, x : x + tile])
            out[y0:y1, x0:x1] = made[y0 - y : y1 - y, x0 - x : x1 - x]
    return out


@register("Denoise with a Model", "_denoised")
def predict_planes(planes: DataFrame, model: Callable[[np.ndarray], np.ndarray], tile: int = 0, overlap: int = 48) -> DataFrame:
    """Each plane through a model that returns a plane of any size, or with `tile` through one of tiles that keep theirs."""
    return on_planes(planes, lambda s: np.stack([in_tiles(p, model, tile, min(overlap, tile - 1)) if tile else model(p) for p in s]))


def in_colour(plane: np.ndarray, megapixels: float = 2.0) -> np.ndarray:
    """(y, x, 3) of 0..1 as models of photographs take it: made smaller beyond so many megapixels, bytes as shares, grey three times."""
    h, w = plane.shape
    factor = model_input(w, h, megapixels)
    small = plane if factor == 1 else resize_weights(h, factor) @ plane @ resize_weights(w, factor).T
    return np.repeat((small / 255 if small.max(initial=0) > 1 else small)[:, :, None], 3, 2)


@register("Segment with a Colour Model", "_mask")
def predict_in_colour(planes: DataFrame, model: Callable[[np.ndarray], np.ndarray], megapixels: float = 2.0) -> DataFrame:
    """Each plane through a model that takes (y, x, 3) of 0..1 and gives a mask of that height and width; masks of smaller planes take the nearest pixel."""

    def segmented(plane: np.ndarray) -> np.ndarray:
        mask = np.asarray(model(in_colour(plane, megapixels)))
        y, x = (np.minimum(((np.arange(n) + 0.5) * m / n).astype(int), m - 1) for n, m in zip(plane.shape, mask.shape, strict=True))
        return mask[y][:, x]

    return on_planes(planes, lambda s: np.stack([segmented(p) for p in s]))


@register("Virtual Staining with a Model", "_virtual_stain")
def predict_stacks(planes: DataFrame, block: Sequence[str], model: Callable[[np.ndarray], np.ndarray], depth: int = 15) -> DataFrame:
    """Planes (block, z, h, w, data), z from 0, in batches of `depth` along z through a model of volumes.

    The last batch begins early enough to be as deep as the others; of its planes those that the batch before has are
    dropped. Volumes of fewer planes than `depth` are refused.
    """
    block = list(block)
    deep = planes.groupBy(*block).agg(F.count("*").cast("int").alias("__n"))
    if not deep.where(F.col("__n") < depth).isEmpty():
        raise ValueError(f"the model takes volumes of {depth} planes or more")
    out_schema, names = with_type(planes.schema, data=DATA), planes.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("z").combine_chunks()
        h, w, first = (table.column(n)[0].as_py() for n in ("h", "w", "__batch"))
        made = lists(np.asarray(model(matrix(table.column("data").combine_chunks()).reshape(-1, h, w))))
        own = table.select(names).set_column(names.index("data"), "data", made)
        return own.filter(pc.greater_equal(own.column("z"), first * depth))

    n, z = F.col("__n"), F.col("z")
    last = F.floor((n - 1) / depth)
    # A plane is in its own batch and, near the end, in the last one, which begins at n - depth.
    batches = F.when((F.floor(z / depth) < last) & (z >= n - depth), F.array(F.floor(z / depth), last)).otherwise(F.array(F.floor(z / depth)))
    batched = planes.join(deep, block).withColumn("__batch", F.explode(batches)).select(*planes.columns, "__batch")
    return batched.groupBy(*block, "__batch").applyInArrow(run, out_schema)


def axis_is_time(depth: int, most: int) -> bool:
    """Whether the first axis of a 3-D stack counts as time: in denoisers up to `most` slices, in pixel classifiers from `most` on."""
    return depth <= most


@register("Pixel Classes to Objects", "_class_labels")
def pixel_classes_to_objects(classes: DataFrame, block: Sequence[str], axes: Sequence[str], background_label: int = 1, value: str = "v") -> DataFrame:
    """Predicted classes with the background's id as 0, as separate objects."""
    return semantic_to_instance(classes.withColumn(value, F.when(F.col(value) == background_label, 0).otherwise(F.col(value))), block, axes, value)


@register("Segment with a Model", "_labels")
def segment_inside(planes: DataFrame, mask: DataFrame, block: Sequence[str], model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(block, y, x, label): a model's labels where the mask is."""
    out = predict_planes(planes, model).select(*block, "w", F.posexplode("data").alias("p", "label"))
    placed = out.select(*block, F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).alias("x"), F.col("label").cast("long").alias("label")).where("label <> 0")
    return clip_to_mask(placed, mask, [*block, "y", "x"])

