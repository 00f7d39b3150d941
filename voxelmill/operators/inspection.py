"""Quality control: overlays, mosaics, display windows, and the grid of blocks with anything in them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import beside
from ..functions.planes import matrix
from ..functions.ranking import global_rank
from ..plans.registry import register


def overlay_blend(pixels: DataFrame, block: Sequence[str] = ("image_id",), opacity: float = 0.6, value: str = "v", label: str = "label") -> DataFrame:
    """(block, y, x, r, g, b): grey values by the image's range, under labels with a hue each, by rank of id."""
    block = list(block)
    wide = beside(pixels, block, __lo=F.min(value), __hi=F.max(value))
    ids = pixels.where(F.col(label) > 0).select(*block, label).distinct()
    ranks = ids.withColumn("__k", F.row_number().over(W.partitionBy(*block).orderBy(label)) - 1)
    grey = F.when((F.col("__hi") > 0) & (F.col("__hi") > F.col("__lo")), (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.0))
    sixth = F.col("__k") * F.lit(137.5) % 360 / 60
    part = sixth - F.floor(sixth)
    # A channel falls, is off, rises or is full by sixths of the circle; green and blue follow red a third later.
    wave = [1 - part, 0.0, 0.0, part, 1.0, 1.0]
    out = {}
    for name, turn in (("r", 5), ("g", 3), ("b", 1)):
        colour = F.lit(0.0)
        for s in range(6):
            level = wave[(s + turn) % 6]
            colour = F.when(F.floor(sixth) == s, level if not isinstance(level, float) else F.lit(level)).otherwise(colour)
        mixed = F.when(F.col("__k").isNull(), grey).otherwise((1 - opacity) * grey + opacity * colour)
        out[name] = F.floor(mixed * 255).cast("int")
    joined = wide.join(ranks, [*block, label], "left")
    return joined.select(*block, "y", "x", *[c.alias(n) for n, c in out.items()])


def grid_place(images: DataFrame, key: str = "image_id", columns: int | None = None) -> DataFrame:
    """(key, row, column) of each image in a mosaic that is as wide as high unless `columns` says otherwise."""
    ranked = global_rank(images.select(key).distinct(), key)
    columns = columns or max(1, math.ceil(math.sqrt(ranked.count())))
    return ranked.select(key, F.floor(F.col("rank") / columns).cast("int").alias("row"), (F.col("rank") % columns).cast("int").alias("column"))


def grid_mosaic(pixels: DataFrame, h: int, w: int, key: str = "image_id", columns: int | None = None) -> DataFrame:
    """Images of h x w, their coordinates moved to their places in the mosaic; other columns stay."""
    placed = pixels.join(grid_place(pixels, key, columns), key)
    return placed.withColumns({"y": F.col("row") * h + F.col("y"), "x": F.col("column") * w + F.col("x")}).drop("row", "column", key)


@register("Grid View: Intensity + Labels Overlay", "_grid_overlay")
def grid_overlay(pixels: DataFrame, h: int, w: int, key: str = "image_id", most: int = 512, opacity: float = 0.6, columns: int | None = None, value: str = "v", label: str = "label") -> DataFrame:
    """(y, x, r, g, b) of one mosaic: the images of h x w, projected along z if they have it, made smaller, and overlaid with their labels.

    Images beyond `most` pixels a side keep every n-th pixel; the projection takes the largest value and label.
    """
    flat = pixels.groupBy(key, "y", "x").agg(F.max(value).alias(value), F.max(label).alias(label)) if "z" in pixels.columns else pixels.select(key, "y", "x", value, label)
    n = max(1, -(-max(h, w) // most))
    small = flat.where((F.col("y") % n == 0) & (F.col("x") % n == 0)).withColumns({a: F.floor(F.col(a) / n).cast("int") for a in "yx"})
    return grid_mosaic(overlay_blend(small, [key], opacity, value, label), -(-h // n), -(-w // n), key, columns)


def blended(values: np.ndarray, labels: np.ndarray, opacity: float) -> np.ndarray:
    """(3, y, x) of 0..255: what `overlay_blend` makes of one plane."""
    lo, hi = values.min(), values.max()
    grey = (values - lo) / (hi - lo) if hi > 0 and hi > lo else np.zeros(values.shape)
    inside = labels > 0
    ids, rank = np.unique(labels[inside], return_inverse=True)
    sixth = np.arange(len(ids)) * 137.5 % 360 / 60
    # Each channel rises for a sixth of the circle, is full for two, falls for one and is off for two.
    colour = np.stack([np.clip(2 - np.abs((sixth - peak + 3) % 6 - 3), 0, 1) for peak in (0, 2, 4)])
    out = np.repeat(grey[None], 3, 0)
    out[:, inside] = (1 - opacity) * grey[inside] + opacity * colour[:, rank]
    return np.floor(out * 255)


def overlay_tiles(planes: DataFrame, key: str = "image_id", most: int = 512, opacity: float = 0.6, columns: int | None = None) -> DataFrame:
    """(key, row, column, h, w, r, g, b) of planes (key, h, w, data, labels): `grid_overlay`'s mosaic as a row an image, in arrays.

    Planes are made smaller and blended where they are, and no pixel is a row. Those with z are made smaller first and meet by
    key; the task then holds the largest values so far of one image, whatever its depth. Null values are 0.
    """
    deep = "z" in planes.columns
    parts = [(n, T.ArrayType(T.DoubleType())) for n in ("data", "labels")]
    small = T.StructType([planes.schema[key], T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), *[T.StructField(n, t) for n, t in parts]])
    final = T.StructType([*small.fields[:3], *[T.StructField(n, T.ArrayType(T.ShortType())) for n in "rgb"]])

    def shrunk(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
        for k in range(batch.num_rows):
            h, w = batch.column("h")[k].as_py(), batch.column("w")[k].as_py()
            n = max(1, -(-max(h, w) // most))
            yield batch.column(key).slice(k, 1), [matrix(batch.column(c).slice(k, 1)).reshape(h, w)[::n, ::n] for c, _ in parts]

    def row(own: pa.Array, arrays: Sequence[np.ndarray], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        sizes = [pa.array([n], pa.int32()) for n in arrays[0].shape]
        return pa.RecordBatch.from_arrays([own, *sizes, *[pa.array([a.ravel()], pa.list_(kind)) for a in arrays]], names=names)

    def coloured(own: pa.Array, pair: Sequence[np.ndarray]) -> pa.RecordBatch:
        return row(own, blended(*pair, opacity).astype(np.int16), pa.int16(), final.names)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, pair in shrunk(batch):
                yield coloured(own, pair)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, pair in shrunk(batch):
                yield row(own, pair, pa.float64(), small.names)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, most_so_far = None, []
        for batch in batches:
            for own, pair in shrunk(batch):
                if before is not None and own.equals(before):
                    most_so_far = [np.maximum(a, b) for a, b in zip(most_so_far, pair, strict=True)]
                    continue
                if before is not None:
                    yield coloured(before, most_so_far)
                before, most_so_far = own, pair
        if before is not None:
            yield coloured(before, most_so_far)

    rows = planes.select(key, F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "data", "labels")
    made = rows.mapInArrow(first, small).repartition(F.xxhash64(key)).sortWithinPartitions(key).mapInArrow(projected, final) if deep else rows.mapInArrow(alone, final)
    return made.join(grid_place(planes, key, columns), key).select(key, "row", "column", "h", "w", *"rgb")


def display_window(pixels: DataFrame, block: Sequence[str] = ("image_id",), value: str = "v") -> DataFrame:
    """(block, min, max, start, end): start at the 0.5th percentile, end at the maximum but at most ten times the 99th."""
    stats = pixels.groupBy(*block).agg(F.min(value).cast("long").alias("min"), F.max(value).cast("long").alias("max"), F.floor(F.percentile(value, 0.005)).cast("long").alias("start"), F.floor(F.percentile(value, 0.99)).cast("long").alias("__p"))
    return stats.select(*block, "min", "max", "start", F.when((F.col("__p") > 0) & (F.col("max") > 10 * F.col("__p")), 10 * F.col("__p")).otherwise(F.col("max")).alias("end"))


def level_scales(scale: dict[str, float], source: dict[str, int], target: dict[str, int], levels: int) -> list[dict[str, float]]:
    """The scale of each level of a pyramid after resizing: source scale * source size / target size, doubled in y and x per level."""
    return [{a: s * source[a] / target[a] * (2**n if a in "yx" else 1) for a, s in scale.items()} for n in range(levels)]


def active_blocks(mask: DataFrame, block: Sequence[str], axes: Sequence[str], size: int, margin: int = 0) -> DataFrame:
    """(block, block_{axis}): blocks of the grid with a mask pixel, and with a margin those beside them in y and x."""
    active = mask.select(*block, *[F.floor(F.col(a) / size).cast("int").alias(f"block_{a}") for a in axes]).distinct()
    for a in ("y", "x") if margin else ():
        active = active.withColumn(f"block_{a}", F.explode(F.sequence(F.col(f"block_{a}") - margin, F.col(f"block_{a}") + margin)))
    return active.where(" AND ".join(f"block_{a} >= 0" for a in axes)).distinct() if margin else active


def clip_to_mask(labels: DataFrame, mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels where the mask is, and no others."""
    return labels.join(mask.select(*keys).distinct(), list(keys), "left_semi")


def frames_to_bytes(pixels: DataFrame, block: Sequence[str] = ("image_id", "t"), value: str = "v") -> DataFrame:
    """Each frame's range to 0..255, truncated, for video; a constant frame becomes 128."""
    wide = beside(pixels, list(block), __lo=F.min(value), __hi=F.max(value))
    share = (F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0)) * 255
    return wide.withColumn(value, F.coalesce(F.floor(share), F.lit(128)).cast("int")).drop("__lo", "__hi")


def model_input(width: int, height: int, megapixels: float = 2.0) -> float:
    """The factor by which an image is made smaller for a model that takes up to so many megapixels."""
    return min(1.0, math.sqrt(megapixels * 1e6 / (width * height)))


@register("Compress with Zstandard", "_compressed")
def compress(df: DataFrame, path: str, compression_level: int = 3) -> DataFrame:
    """Writes Parquet with Zstandard and returns what was written."""
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(compression_level)).mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
