"""Time points, channels and file names: merging, splitting, natural order, pairs by suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import global_rank
from ..plans.registry import register


def natural_key(path: Column, digits: int = 20) -> Column:
    """A text that sorts as names do when their numbers count as numbers and letters as lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(path), r"(\d+)", "0" * digits + "$1"), rf"0*(\d{{{digits}}})(?!\d)", "$1")


def natural_order(files: DataFrame, path: str = "path", folder: Sequence[str] = ()) -> DataFrame:
    """`files` with `rank`, the place of each in its folder by natural order, from 0; ties go by the name itself.

    Without a folder all files are one.
    """
    key = natural_key(F.col(path))
    if folder:
        return files.withColumn("rank", F.row_number().over(W.partitionBy(*folder).orderBy(key, path)) - 1)
    return global_rank(files.withColumn("__key", key), "__key", path).drop("__key")


def strided(df: DataFrame, axis: str, start: int = 0, step: int = 1, most: int | None = None) -> DataFrame:
    """Indices from `start`, every `step`-th, at most `most` of them, numbered anew from 0."""
    i = F.col(axis) - start
    kept = df.where((i >= 0) & (F.pmod(i, F.lit(step)) == 0)).withColumn(axis, F.floor(i / step).cast("long"))
    return kept.where(F.col(axis) < most) if most else kept


def inclusive_range(df: DataFrame, axis: str, start: int = 0, end: int = -1, step: int = 1) -> DataFrame:
    """Indices of start..end with the end among them (below 0: to the last one), numbered anew from 0."""
    return strided(df if end < 0 else df.where(F.col(axis) <= end), axis, start, step)


def frames_before(files: DataFrame, folder: Sequence[str] = (), each: int = 4096) -> DataFrame:
    """`files` (rank, __n) with `__before`, the frames of all files before each one: summed in stretches of so many files, then over the stretches."""
    earlier = lambda *keys, order: F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = files.withColumn("__cell", F.floor(F.col("rank") / each))
    cells = files.groupBy(*folder, "__cell").agg(F.sum("__n").alias("__n")).select(*folder, "__cell", earlier(*folder, order="__cell").alias("__cells"))
    return files.withColumn("__before", earlier(*folder, "__cell", order="rank")).join(cells, [*folder, "__cell"]).withColumn("__before", F.col("__before") + F.col("__cells")).drop("__cell", "__cells")


@register("Merge Timepoints", "_merge_timeseries")
def merge_timepoints(pixels: DataFrame, path: str = "path", folder: Sequence[str] = (), start_timepoint: int = 0, subsample_factor: int = 1, max_timepoints: int | None = None, shape: Sequence[str] = ()) -> DataFrame:
    """Images of one file each as frames of an axis t, in natural order of the names, then start, step and count.

    Files that have frames (a column t, from 0) follow each other along t. With `shape`, axes of dense images, files whose
    sizes along them differ raise.
    """
    frames = "t" in pixels.columns
    files = pixels.groupBy(path, *folder).agg((F.max("t") + 1 if frames else F.lit(1)).cast("long").alias("__n"), F.struct(*[F.max(a).alias(a) for a in shape], F.lit(0).alias("_")).alias("__shape"))
    if shape and files.select("__shape").distinct().count() > 1:
        raise ValueError("images of different sizes can't be frames of one movie")
    names = natural_order(files, path, folder)
    placed = (frames_before(names, folder) if frames else names.withColumn("__before", F.col("rank"))).select(path, *folder, "__before")
    moved = pixels.join(placed, [path, *folder]).withColumn("t", F.col("__before") + (F.col("t") if frames else 0))
    return strided(moved, "t", start_timepoint, subsample_factor, max_timepoints).drop(path, "__before")


@register("Split TZYX into ZYX TIFs", "_split", loads=False)
def split_timepoints(pixels: DataFrame, basename: str = "image", axis: str = "t") -> DataFrame:
    """Every frame's rows under a name of its own, `{basename}_t{frame, three digits}`; write it partitioned by `file`."""
    return pixels.withColumn("file", F.concat(F.lit(f"{basename}_t"), F.lpad(F.col(axis).cast("string"), 3, "0"))).drop(axis)


def channel_axis(shape: Sequence[int], num_channels: int = 3, axes: str | None = None) -> int | None:
    """The place of the channel axis: what metadata name so, else the first axis of `num_channels`, those before the last two first; null without one."""
    if axes and len(axes) == len(shape) and "C" in axes.upper():
        return axes.upper().index("C")
    outer = range(len(shape) - 2)
    return next((k for k in [*outer, *range(max(0, len(shape) - 2), len(shape))] if shape[k] == num_channels), None)


@register("Split Color Channels", "_split", loads=False)
def split_channels(pixels: DataFrame, axis: str = "c", basename: str = "image", output_format: str = "python", sort_by_timepoints: Sequence[str] = ()) -> DataFrame:
    """Every channel's rows under a name of its own, `{basename}_channel_{c}`, without the axis; write it partitioned by `file`.

    The format "fiji" has the columns t, z, y, x in this order before the others. With `sort_by_timepoints`, the columns that
    tell images apart, names are in folders by the number of an image's frames: `T10/`.
    """
    if output_format not in ("python", "fiji"):
        raise ValueError("the format is python or fiji")
    name = F.concat(F.lit(f"{basename}_channel_"), F.col(axis).cast("string"))
    if sort_by_timepoints:
        keys = list(sort_by_timepoints)
        pixels = pixels.join(pixels.groupBy(*keys).agg(F.count_distinct("t").alias("__frames")), keys)
        name = F.concat(F.lit("T"), F.col("__frames").cast("string"), F.lit("/"), name)
    out = pixels.withColumn("file", name).drop(axis, "__frames")
    first = [a for a in "tzyx" if a in out.columns] if output_format == "fiji" else []
    return out.select(*first, *[c for c in out.columns if c not in first])


def with_channel_number(files: DataFrame, channel_substring: str = "_channel_") -> DataFrame:
    """The files whose names have a number after `channel_substring`."""
    return files.where(F.col("path").rlike(rf"\Q{channel_substring}\E\d{{1,2}}"))


@register("Merge Color Channels", "_merged_colors", wanted=with_channel_number, loads=False)
def merge_channels(pixels: DataFrame, path: str = "path", channel_substring: str = "_channel_") -> DataFrame:
    """Files that differ in the number after `channel_substring` only as channels of one image, in order of the numbers.

    Files without such a number are left out. `path` becomes that of the file with the lowest number.
    """
    pattern = rf"^(.*)\Q{channel_substring}\E(\d{{1,2}})(.*)$"
    part = lambda k: F.regexp_extract(path, pattern, k)
    names = pixels.select(path).distinct().where(F.col(path).rlike(pattern))
    names = names.select(path, part(1).alias("__prefix"), part(2).cast("int").alias("__n"), part(3).alias("__end"))
    w = W.partitionBy("__prefix", "__end")
    ranked = names.withColumn("c", F.dense_rank().over(w.orderBy("__n")) - 1).withColumn("__first", F.min_by(path, "__n").over(w))
    return pixels.drop("c").join(ranked.select(path, "c", F.col("__first").alias("__path")), path).withColumn(path, F.col("__path")).drop("__path")


def pair_by_suffix(files: DataFrame, suffixes: Sequence[str], path: str = "path", image_end: str = ".tif", strict: bool = False) -> DataFrame:
    """(image, partner): images and their label files, which have a suffix in place of the image's end; earlier suffixes win.

    Label files are no images. Images without a partner have a null one, or with `strict` raise.
    """
    f = F.col(path)
    which = F.coalesce(*[F.when(f.endswith(s), F.lit(k)) for k, s in enumerate(suffixes)])
    known = files.select(f.alias("path"), which.alias("k"))
    ends = F.array(*[F.lit(s) for s in suffixes])
    stem = F.expr("substring(path, 1, length(path) - length(end))")
    partners = known.where("k IS NOT NULL").withColumn("end", F.element_at(ends, F.col("k") + 1)).select(stem.alias("stem"), "path", "k")
    best = partners.groupBy("stem").agg(F.min_by("path", F.struct("k", "path")).alias("partner"))
    images = known.where(F.col("k").isNull() & F.col("path").endswith(image_end)).withColumn("end", F.lit(image_end)).select(F.col("path").alias("image"), stem.alias("stem"))
    out = images.join(best, "stem", "left").select("image", "partner")
    if strict and (lone := out.where("partner IS NULL").first()):
        raise ValueError(f"{lone['image']} has no partner that ends with any of {list(suffixes)}")
    return out


def parts_of(name: Column) -> Column:
    """Every stretch of a name, with its start and length."""
    stretch = lambda i, n: F.struct(F.substring(name, i, n).alias("part"), i.alias("at"), n.alias("n"))
    size = F.length(name)
    return F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: stretch(i, n))))


def group_by_common_name(folders: Sequence[DataFrame], path: str = "path") -> DataFrame:
    """(name, file_0, file_1, ...): files of two or three channels that share the longest stretch of their names.

    For each file of the first channel that of the next one with the longest common stretch is taken, of several the first
    by name; then that stretch looks for its file of the third. Files that end with the same stretch
    are one group, that of the last by name; files without any are left out. The stretches of a channel's names are
    reduced to the first file of each before they are met, so no pairs of files are tried.
    """
    base = lambda c: F.regexp_replace(c, "^.*/", "")
    found = folders[0].select(F.col(path).alias("file_0"), base(F.col(path)).alias("name")).where(F.length("name") > 0)
    for k, other in enumerate(folders[1:], 1):
        own = other.select(F.col(path).alias("file"), F.explode(parts_of(base(F.col(path)))).alias("s")).groupBy(F.col("s.part").alias("part")).agg(F.min("file").alias("file"))
        asked = found.withColumn("s", F.explode(parts_of(F.col("name")))).select(*found.columns, "s.*").join(own, "part")
        best = asked.groupBy(*[f"file_{j}" for j in range(k)]).agg(F.min(F.struct((-F.col("n")).alias("n"), "file", "at", "part")).alias("best"))
        found = best.select(*[f"file_{j}" for j in range(k)], F.col("best.file").alias(f"file_{k}"), F.col("best.part").alias("name"))
    names = [f"file_{k}" for k in range(len(folders))]
    return found.groupBy("name").agg(F.max(F.struct(*names)).alias("f")).select("name", *[f"f.{c}" for c in names])
