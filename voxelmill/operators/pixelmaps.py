"""Maps of single pixels: label masks, intensity transforms, thresholds at a given value, crops.

All are column expressions, so Spark fuses them with what stands before and after. Where an image's own
extremes are needed they come from an aggregate that is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import beside
from ..plans.registry import register

#: The largest value of each pixel type.
MAXIMUM = {"uint8": 255, "uint16": 65535, "uint32": 4294967295, "int8": 127, "int16": 32767, "int32": 2147483647, "float32": 1.0, "float64": 1.0}


@register("Labels to Binary", "_binary")
def labels_to_binary(labels: DataFrame, label: str = "label") -> DataFrame:
    """255 where there is a label, else 0."""
    return labels.withColumn(label, F.when(F.col(label) != 0, 255).otherwise(0))


@register("Invert Binary Labels", "_inverted")
def invert_binary_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """255 where there is no label, else 0; needs a dense grid."""
    return labels.withColumn(label, F.when(F.col(label) == 0, 255).otherwise(0))


@register("Filter Label by ID", "_filtered")
def filter_label_by_id(labels: DataFrame, label_id: int = 1, label: str = "label") -> DataFrame:
    """Keeps one label, all others become 0."""
    return labels.withColumn(label, F.when(F.col(label) == label_id, F.col(label)).otherwise(0))


@register("RGB to Labels", "_labels")
def rgb_to_labels(rgb: DataFrame, blue: int = 1, green: int = 2, red: int = 3) -> DataFrame:
    """(r, g, b) of pure blue, green or red to label ids, other colours to 0."""
    is_ = lambda r, g, b: (F.col("r") == r) & (F.col("g") == g) & (F.col("b") == b)
    label = F.when(is_(0, 0, 255), blue).when(is_(0, 255, 0), green).when(is_(255, 0, 0), red).otherwise(0)
    return rgb.withColumn("label", label).drop("r", "g", "b")


@register("Gamma Correction", "_gamma")
def gamma_correction(pixels: DataFrame, gamma: float = 1.0, dtype: str = "uint8", value: str = "v") -> DataFrame:
    """(v / max) ** gamma * max within 0..max, truncated for integer types."""
    top = MAXIMUM[dtype]
    out = F.least(F.lit(float(top)), F.greatest(F.lit(0.0), F.pow(F.col(value) / top, F.lit(gamma)) * top))
    return pixels.withColumn(value, out if dtype.startswith("float") else F.floor(out).cast("long"))


@register("Invert Image", "_inverted")
def invert_image(pixels: DataFrame, dtype: str = "uint8", value: str = "v") -> DataFrame:
    """The complement: max - v for unsigned types and floats, -1 - v for signed ones, not v for bool."""
    v = F.col(value)
    return pixels.withColumn(value, ~v if dtype == "bool" else -1 - v if dtype.startswith("int") else F.lit(MAXIMUM[dtype]) - v)


def scaled_to_bytes(pixels: DataFrame, block: Sequence[str], value: str) -> DataFrame:
    wide = beside(pixels, block, __low=F.min(value), __high=F.max(value))
    v, low, high = F.col(value), F.col("__low"), F.col("__high")
    out = F.when(high > low, F.rint((v - low) / (high - low) * 255)).otherwise(F.when(high <= 0, 0).otherwise(255))
    return wide.withColumn(value, out.cast("int")).drop("__low", "__high")


@register("Convert to 8-bit (uint8)", "_uint8")
def convert_to_uint8(pixels: DataFrame, block: Sequence[str] = ("image_id",), value: str = "v") -> DataFrame:
    """An image's range to 0..255, halves to the even number; a constant image to 0 or, if above 0, 255."""
    return scaled_to_bytes(pixels, list(block), value)


@register("Manual Thresholding (8-bit)", "_thresh")
def manual_threshold(pixels: DataFrame, threshold: int = 128, value: str = "v") -> DataFrame:
    """1 where an 8-bit value is above the threshold, else 0."""
    return pixels.withColumn(value, (F.col(value) > threshold).cast("int"))


def float_threshold(pixels: DataFrame, threshold: float = 0.5, invert: bool = False, dtype: str = "uint8", value: str = "v") -> DataFrame:
    """Whether a value as a share of its type's maximum is above the threshold, or not above it."""
    above = F.col(value) / MAXIMUM[dtype] > threshold
    return pixels.withColumn(value, ~above if invert else above)


@register("Label-Based Cropping", "_cropped")
def label_crop(pixels: DataFrame, labels: DataFrame, on: Sequence[str], value: str = "v") -> DataFrame:
    """0 outside of labels above 0. `on` are the coordinates that both have; others broadcast the labels along them."""
    mask = labels.where(F.col("label") > 0).select(*on).distinct().withColumn("__in", F.lit(True))
    return pixels.join(mask, list(on), "left").withColumn(value, F.when(F.col("__in"), F.col(value)).otherwise(0)).drop("__in")


def crop_by_ids(pixels: DataFrame, ids: Sequence[int], value: str = "v", label: str = "label") -> DataFrame:
    """Values and labels outside of the chosen ids become 0."""
    chosen = F.col(label).isin(*ids)
    return pixels.withColumns({value: F.when(chosen, F.col(value)).otherwise(0), label: F.when(chosen, F.col(label)).otherwise(0)})


def write_object(labels: DataFrame, drawn: Column, new_id: int, label: str = "label") -> DataFrame:
    """A new object only where there is none, so earlier objects win."""
    return labels.withColumn(label, F.when((F.col(label) == 0) & drawn, new_id).otherwise(F.col(label)))


def channel_select(pixels: DataFrame, channel: int, axis: str = "c") -> DataFrame:
    """One channel, without its axis."""
    return pixels.where(F.col(axis) == channel).drop(axis)


def frame_removal(pixels: DataFrame, frames: Sequence[int], n_frames: int, axis: str = "t") -> DataFrame:
    """Without the marked frames; later ones move up. At least two frames come in and one goes out."""
    gone = sorted(set(frames) & set(range(n_frames)))
    if n_frames < 2 or len(gone) >= n_frames:
        raise ValueError("frame removal takes two frames or more and keeps at least one")
    before = F.size(F.filter(F.array(*[F.lit(g) for g in gone]), lambda g: g < F.col(axis))) if gone else F.lit(0)
    return pixels.where(~F.col(axis).isin(*gone)).withColumn(axis, F.col(axis) - before) if gone else pixels


def percentile_scale(pixels: DataFrame, block: Sequence[str], low: float = 1.0, high: float = 99.8, value: str = "v") -> DataFrame:
    """An image's range between two percentiles to 0..1, clipped; the form detectors are given."""
    wide = beside(pixels, block, __low=F.percentile(value, low / 100), __high=F.percentile(value, high / 100))
    share = (F.col(value) - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0))
    return wide.withColumn(value, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))).drop("__low", "__high")
