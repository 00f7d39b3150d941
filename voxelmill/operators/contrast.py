"""Contrast-limited equalisation of images of any number of axes, as tables of tiles.

Histograms of the tiles are an aggregate, what they map values to a table of one row a tile, and pixels meet the tiles whose middles are
around them: all pixels between the same middles need the same tiles. So no image passes a task whole: a task holds the pixels of one
such cell, a tile's worth, and the look-up tables of its corners.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graph import Scratch
from ..functions.planes import lists, matrix
from ..plans.registry import register
from .enhance import tile_size


def look_up_tables(levels: DataFrame, block: Sequence[str], places: Sequence[str], clip_limit: float, bins: int) -> DataFrame:
    """(block, places, lut): of each tile the share of its values up to each level, after what a level has above the limit is spread over all."""
    hist = levels.groupBy(*block, *places, "__level").agg(F.count("*").alias("__c"))
    tile = W.partitionBy(*block, *places)
    limit = F.greatest(F.lit(1.0), clip_limit * F.sum("__c").over(tile))
    cut = hist.select(*block, *places, "__level", F.sum("__c").over(tile).alias("__n"), F.least(F.col("__c"), limit).alias("__kept"), F.sum(F.greatest(F.col("__c") - limit, F.lit(0.0))).over(tile).alias("__over"))
    each = cut.groupBy(*block, *places).agg(F.max("__n").alias("__n"), F.max("__over").alias("__over"), F.array_sort(F.collect_list(F.struct("__level", "__kept"))).alias("__h"))  # at most `bins` of a tile
    schema = T.StructType([*[each.schema[c] for c in (*block, *places)], T.StructField("lut", T.ArrayType(T.DoubleType()))])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("__h")
                flat = rows.flatten()
                kept = np.zeros((batch.num_rows, bins))
                kept[np.repeat(np.arange(batch.num_rows), np.diff(rows.offsets.to_numpy())), flat.field("__level").to_numpy()] = flat.field("__kept").to_numpy()
                n, over = batch.column("__n").to_numpy()[:, None], batch.column("__over").to_numpy()[:, None]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*block, *places)], lists((np.cumsum(kept, 1) + np.arange(1, bins + 1) * over / bins) / n)], names=schema.names)

    return each.mapInArrow(run, schema)


@register("CLAHE of Volumes", "_clahe")
def clahe_volume(
    pixels: DataFrame, sizes: dict[str, int], block: Sequence[str] = ("image_id",), clip_limit: float = 0.01, kernel_size: int = 0, value: str = "v", top: int = 255, bins: int = 256,
) -> DataFrame:
    """(block, axes, value) of dense images whose axes have these sizes, equalised by tiles of one side along all axes, truncated to 0..top.

    A pixel gets the mean of what the tiles around it map its level to, weighed by nearness along every axis. Images of one value have level 0 only.
    """
    block, axes, scratch = list(block), list(sizes), Scratch(pixels.sparkSession)
    k = tile_size(sizes["y"], sizes["x"], kernel_size)
    count = {a: -(-n // k) for a, n in sizes.items()}
    kept = pixels.select(*block, *axes, value)
    extent = kept.groupBy(*block).agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    share = F.when(F.col("__hi") > F.col("__lo"), (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0)
    levels = kept.join(extent, block).select(*block, *axes, F.floor(share * (bins - 1)).cast("int").alias("__level"))
    tiles = [f"__t{a}" for a in axes]
    luts = scratch.cut(look_up_tables(levels.withColumns({f"__t{a}": F.floor(F.col(a) / k).cast("int") for a in axes}), block, tiles, clip_limit, bins))
    # Where a pixel lies between middles of tiles, and the first of the two along each axis, which names its cell.
    at = {f"__f{a}": F.greatest(F.lit(0.0), F.least(F.lit(float(count[a] - 1)), (F.col(a) - (k - 1) / 2) / k)) for a in axes}
    cells = [f"__c{a}" for a in axes]
    placed = levels.withColumns(at).withColumns({f"__c{a}": F.floor(f"__f{a}").cast("int") for a in axes})
    # Each tile is a corner of the cells before and after its middle.
    corners = luts
    for a in axes:
        corners = corners.withColumn(f"__c{a}", F.explode(F.array(F.col(f"__t{a}") - 1, F.col(f"__t{a}")))).where(F.col(f"__c{a}") >= 0)
    schema = T.StructType([*[kept.schema[c] for c in (*block, *axes)], T.StructField(value, T.IntegerType())])

    def mapped(own: pa.Table, around: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema_arrow.empty_table()
        known = {tuple(row[t] for t in tiles): n for n, row in enumerate(around.select(tiles).to_pylist())}
        table = matrix(around.column("lut").combine_chunks())
        level, first = own.column("__level").to_numpy(), [own.column(c)[0].as_py() for c in cells]
        ahead = [own.column(f"__f{a}").to_numpy() - c for a, c in zip(axes, first, strict=True)]
        out = np.zeros(own.num_rows)
        for corner in itertools.product((0, 1), repeat=len(axes)):
            weight = np.prod([f if up else 1 - f for f, up in zip(ahead, corner, strict=True)], axis=0)
            place = tuple(min(c + up, count[a] - 1) for a, c, up in zip(axes, first, corner, strict=True))
            if weight.any():
                out += weight * table[known[place], level]
        new = np.floor(np.minimum(1.0, out) * top + 1e-9).astype(np.int32)
        return own.select([*block, *axes]).append_column(value, pa.array(new))

    from pyspark.sql.pandas.types import to_arrow_schema

    schema_arrow = to_arrow_schema(schema)
    return placed.groupBy(*block, *cells).cogroup(corners.groupBy(*block, *cells)).applyInArrow(mapped, schema)
