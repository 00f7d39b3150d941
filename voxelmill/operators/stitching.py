"""Segmentation of images that are larger than a model takes: overlapping blocks, and their labels joined at the seams.

Blocks of one size begin a stride apart, the size less the overlap, so neighbours share a band. A model labels each block by itself.
Two labels of neighbouring blocks are one object if they share enough of what either has in the band where both blocks
look; objects are the components of the graph of such pairs. Each pixel is labelled by the block that it lies deepest in.
What is compared are the bands, and what is connected are pairs of labels, never pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graph import Scratch
from ..functions.tiles import CELLS, gathered, stacks_of_one_shape, whole_groups
from ..plans.registry import register
from .components import joined_at_seams

SIZE, OVERLAP, SHARE = 256, 60, 0.5


def stride_of(size: int, overlap: int) -> int:
    """How far apart blocks begin; the overlap is at most the size less one."""
    if size < 1 or overlap < 0:
        raise ValueError("blocks have a size of 1 or more and an overlap of 0 or more")
    return size - min(overlap, size - 1)


def block_count(length: int, size: int, overlap: int = OVERLAP) -> int:
    """Blocks of a size, a stride apart, that cover a length."""
    return 1 if length <= size else -(-(length - size) // stride_of(size, overlap)) + 1


def lengths(pixels: DataFrame, axes: Sequence[str]) -> dict[str, int]:
    """How long the axes of the longest image are, by its last pixels."""
    ends = pixels.agg(*[F.max(a).alias(a) for a in axes]).first()
    return {a: 1 + (ends[a] or 0) for a in axes}


def with_blocks(pixels: DataFrame, shape: dict[str, int], size: int, overlap: int) -> DataFrame:
    """`pixels`, coordinates from 0, once for each block that holds them, with the block's number along each axis (b and the axis)."""
    for a, n in shape.items():
        pixels = pixels.withColumn(f"b{a}", F.explode(held_by(a, n, size, overlap)))
    return pixels


def held_by(axis: str, length: int, size: int, overlap: int) -> Column:
    """The numbers of the blocks along an axis that hold a coordinate."""
    stride, last = stride_of(size, overlap), block_count(length, size, overlap) - 1
    first = F.greatest(F.ceil((F.col(axis) - size + 1) / stride), F.lit(0))
    return F.sequence(first.cast("long"), F.least(F.floor(F.col(axis) / stride), F.lit(last)).cast("long"))


def deepest(axis: str, length: int, size: int, overlap: int) -> Column:
    """The number of the block along an axis that a coordinate lies deepest in, the first of several; the image's own edges count for none."""
    stride, last, at = stride_of(size, overlap), block_count(length, size, overlap) - 1, F.col(axis)

    def far(b: Column) -> Column:
        before = F.when(b > 0, at - b * stride).otherwise(F.lit(size))
        after = F.when(b < last, b * stride + size - 1 - at).otherwise(F.lit(size))
        return F.struct((-F.least(before, after)).alias("d"), b.alias("b"))

    return F.array_min(F.transform(held_by(axis, length, size, overlap), far))["b"]


def active_blocks(mask: DataFrame, block: Sequence[str], shape: dict[str, int], size: int = SIZE, overlap: int = OVERLAP, margin: int = 0, spread: Sequence[str] = ("y", "x"), value: str = "v") -> DataFrame:
    """(block, b and the axis): blocks with something of the mask in them, and those at most `margin` blocks from one along the axes of `spread`."""
    found = with_blocks(mask.where(F.col(value) != 0), shape, size, overlap).select(*block, *[f"b{a}" for a in shape]).distinct()
    for a in spread if margin else ():
        last = block_count(shape[a], size, overlap) - 1
        found = found.withColumn(f"b{a}", F.explode(F.sequence(F.greatest(F.col(f"b{a}") - margin, F.lit(0)), F.least(F.col(f"b{a}") + margin, F.lit(last)))))
    return found.distinct()


def segment_blocks(
    pixels: DataFrame, block: Sequence[str], shape: dict[str, int], model: Callable[[np.ndarray], np.ndarray], size: int = SIZE, overlap: int = OVERLAP, value: str = "v", only: DataFrame | None = None,
    stacked: bool = False,
) -> DataFrame:
    """(block, b and each axis, axes, label): what a model of arrays labels in each block, background left out; with `only` in those blocks.

    `shape` names the axes and how long they are. The model gets the bounding box of the pixels that a block has and
    returns whole numbers of the same shape; with `stacked` it gets blocks of one shape together, as a stack along a first axis.
    """
    block, axes = list(block), list(shape)
    places = [f"b{a}" for a in axes]
    keys = [*block, *places]
    rows = with_blocks(pixels.select(*block, *axes, value), shape, size, overlap)
    if only is not None:
        rows = rows.join(only, [*block, *places], "left_semi")
    schema = T.StructType([*[rows.schema[c] for c in (*block, *places, *axes)], T.StructField("label", T.LongType())])

    def labelled(stack: np.ndarray) -> np.ndarray:
        if stacked:
            made = np.asarray(model(stack))
            if made.shape != stack.shape:
                raise ValueError(f"the model made {made.shape} of a stack of {stack.shape}")
            return made
        each = [np.asarray(model(box)) for box in stack]
        for made in each:
            if made.shape != stack.shape[1:]:
                raise ValueError(f"the model made {made.shape} of a block of {stack.shape[1:]}")
        return np.stack(each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_groups(gathered(batches), keys):
            values = table.column(value).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
            own = np.zeros(table.num_rows, np.int64)
            for rows, cells, full in stacks_of_one_shape(table, start, axes, CELLS):
                stack = np.zeros(full, values.dtype)
                stack[cells] = values[rows]
                own[rows] = labelled(stack)[cells].astype(np.int64)
            out = table.select([*keys, *axes]).append_column("label", pa.array(own)).filter(pa.array(own != 0))
            yield from out.combine_chunks().to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def stitch_blocks(found: DataFrame, block: Sequence[str], shape: dict[str, int], size: int = SIZE, overlap: int = OVERLAP, share: float = SHARE) -> DataFrame:
    """(block, axes, label) of labels (block, b and each axis, axes, label) of blocks: objects numbered in scan order of their first pixels.

    Two labels of two blocks are one object if the pixels that both label are `share` or more of those that the smaller of the two has where
    the blocks overlap. Pixels come from the block they lie deepest in, of several from the first; what that block leaves as
    background stays background.
    """
    block, axes = list(block), list(shape)
    places = [f"b{a}" for a in axes]
    scratch = Scratch(found.sparkSession)
    own = scratch.cut(found.select(*block, *places, *axes, "label"))
    node = F.struct(*block, *places, "label")
    many = F.lit(False)
    for a, n in shape.items():
        many |= F.size(held_by(a, n, size, overlap)) > 1
    band = own.where(many).select(*block, *axes, F.struct(*places).alias("at"), node.alias("node"))
    one, two = (band.select(*block, *axes, F.col("node").alias(n), F.col("at").alias(f"p{n}")) for n in "ab")
    both = one.join(two, [*block, *axes]).where("pa < pb").groupBy("a", "b", "pa", "pb").agg(F.count("*").alias("both"))
    # What a label has where another block looks too, whatever that says of it.
    seen = with_blocks(band.select(*block, *axes, "node", "at"), shape, size, overlap).withColumn("other", F.struct(*places)).where("other <> at")
    inside = scratch.cut(seen.groupBy("node", "other").agg(F.count("*").alias("n")))
    pairs = both.join(inside.select(F.col("node").alias("a"), F.col("other").alias("pb"), F.col("n").alias("na")), ["a", "pb"])
    pairs = pairs.join(inside.select(F.col("node").alias("b"), F.col("other").alias("pa"), F.col("n").alias("nb")), ["b", "pa"])
    edges = scratch.cut(pairs.where(F.col("both") >= share * F.least("na", "nb")).select("a", "b"))
    chosen = own
    for a, n in shape.items():
        chosen = chosen.where(F.col(f"b{a}") == deepest(a, n, size, overlap))
    labelled = joined_at_seams(chosen.select(*block, *axes, node.alias("node")), edges, "node")
    scratch.keep(own)
    ids = labelled.groupBy(*block, "node").agg(F.min(F.struct(*axes)).alias("first"))
    ids = ids.withColumn("label", F.row_number().over(W.partitionBy(*block).orderBy("first", "node"))).drop("first")
    return labelled.join(ids, [*block, "node"]).select(*block, *axes, "label")


@register("Segment by Blocks", "_labels")
def segment_stitched(
    pixels: DataFrame, block: Sequence[str], axes: Sequence[str], model: Callable[[np.ndarray], np.ndarray], size: int = SIZE, overlap: int = OVERLAP, share: float = SHARE, value: str = "v", mask: DataFrame | None = None,
    margin: int = 1, stacked: bool = False,
) -> DataFrame:
    """(block, axes, label): an image of any size through a model of blocks, or with `stacked` of stacks of blocks, stitched; with a mask only its blocks and those around them."""
    shape = lengths(pixels, axes)
    only = active_blocks(mask, block, shape, size, overlap, margin, [a for a in axes if a in "yx"]) if mask is not None else None
    return stitch_blocks(segment_blocks(pixels, block, shape, model, size, overlap, value, only, stacked), block, shape, size, overlap, share)
