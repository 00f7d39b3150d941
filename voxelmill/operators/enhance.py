"""Contrast, background and size of planes.

These follow published formulas of a library that isn't at hand here, so their last digits are ours and not
compared with it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import to_pixels
from ..functions.planes import neighbours, on_planes, over_volumes, to_planes
from ..plans.registry import register


def tile_size(h: int, w: int, kernel_size: int = 0) -> int:
    """The side of a tile: as given or an eighth of the shorter side within 16..128, made odd."""
    k = kernel_size or min(128, max(16, min(h, w) // 8))
    return k + (k % 2 == 0)


def equalised(plane: np.ndarray, k: int, clip_limit: float, top: int, bins: int) -> np.ndarray:
    """One plane by tiles of side k; see `clahe`."""
    (h, w), low, high = plane.shape, plane.min(), plane.max()
    ny, nx = -(-h // k), -(-w // k)
    level = np.floor((plane - low) / (high - low) * (bins - 1)).astype(np.int64) if high > low else np.zeros(plane.shape, np.int64)
    ty, tx = np.arange(h) // k, np.arange(w) // k
    hist = np.bincount(((ty[:, None] * nx + tx) * bins + level).ravel(), minlength=ny * nx * bins).reshape(ny, nx, bins)
    total = hist.sum(-1, keepdims=True)
    limit = np.maximum(1.0, clip_limit * total)
    over = np.maximum(hist - limit, 0).sum(-1, keepdims=True)
    below = (np.cumsum(np.minimum(hist, limit), -1) + np.arange(1, bins + 1) * over / bins) / total
    fy, fx = (np.clip((np.arange(n) - (k - 1) / 2) / k, 0, m - 1) for n, m in ((h, ny), (w, nx)))
    out = np.zeros(plane.shape)
    for a in (0, 1):
        for b in (0, 1):
            cy, cx = np.floor(fy).astype(int), np.floor(fx).astype(int)
            share = np.outer(fy - cy if a else 1 - (fy - cy), fx - cx if b else 1 - (fx - cx))
            out += share * below[np.minimum(cy + a, ny - 1)[:, None], np.minimum(cx + b, nx - 1), level]
    return np.floor(np.minimum(1.0, out) * top + 1e-9)


def clahe_planes(planes: DataFrame, clip_limit: float = 0.01, kernel_size: int = 0, top: int = 255, bins: int = 256) -> DataFrame:
    """`clahe` of `planes`; a task holds a plane and the histograms of its tiles."""
    return on_planes(planes, lambda s: np.stack([equalised(p, tile_size(*p.shape, kernel_size), clip_limit, top, bins) for p in s]))


@register("CLAHE (Adaptive Histogram Equalization)", "_clahe")
def clahe(pixels: DataFrame, h: int, w: int, block: Sequence[str] = ("image_id",), clip_limit: float = 0.01, kernel_size: int = 0, value: str = "v", top: int = 255, bins: int = 256) -> DataFrame:
    """Contrast-limited equalisation of dense planes by tiles, truncated to 0..top.

    A tile's histogram is cut at the limit and what is over is spread evenly; a pixel gets the mean of the
    cumulative histograms of the four tiles around it, weighed by nearness.
    """
    out = to_pixels(clahe_planes(to_planes(pixels, block, h, w, value), clip_limit, kernel_size, top, bins), block, value)
    return out.withColumn(value, F.col(value).cast("int"))


#: Rows that the ball is rolled over at a time, so that they stay in a core's cache.
STRIP = 16


def roll(under: np.ndarray, plane: np.ndarray, square: tuple[int, int]) -> None:
    """Lowers `under` to the least of the plane's values around each pixel plus how far a ball's surface is below its top.

    square: of the radius, and of that of the plane's cut through the ball. `plane` is wider than `under` by the radius on every side. Values left
    and right, above and below of a pixel are at one height of the ball, so the least of them is taken before it is added.
    """
    h, w = under.shape
    r = (plane.shape[0] - h) // 2
    radius, high = np.sqrt(square[0]), square[1]
    for lo in range(0, h, STRIP):
        out = under[lo : lo + STRIP]
        best = np.empty(out.shape)
        for dy in range(r + 1):
            if dy * dy > high:
                break
            rows = np.minimum(plane[lo + r - dy :][: len(out)], plane[lo + r + dy :][: len(out)])
            for dx in range(r + 1):
                if dy * dy + dx * dx > high:
                    break
                np.minimum(rows[:, r - dx :][:, :w], rows[:, r + dx :][:, :w], out=best)
                best += radius - np.sqrt(high - dy * dy - dx * dx)
                np.minimum(out, best, out=out)


def above_ball(stack: np.ndarray, radius: int, axes: int) -> np.ndarray:
    """Values minus the background that a ball of `axes` axes reaches from below, at least 0; beyond the edges is nothing."""
    square, under = radius * radius, np.full(stack.shape, np.inf)
    if axes == 2:
        for own, low in zip(np.pad(stack, [(0, 0), (radius, radius), (radius, radius)], constant_values=np.inf), under, strict=True):
            roll(low, own, (square, square))
        return np.maximum(stack - under, 0)
    wide = np.pad(stack, [(radius, radius)] * 3, constant_values=np.inf)
    for z in range(len(stack)):
        for dz in range(radius + 1):
            if z >= dz or z + dz < len(stack):
                roll(under[z], np.minimum(wide[z + radius - dz], wide[z + radius + dz]), (square, square - dz * dz))
    return np.maximum(stack - under, 0)


@register("Rolling Ball Background Subtraction", "_rollingball")
def rolling_ball(planes: DataFrame, radius: int = 50, volume: Sequence[str] | None = None) -> DataFrame:
    """v minus the background that a ball rolled below the surface reaches, at least 0: of planes, or with `volume`, the columns that tell volumes apart, a ball of three axes."""
    if volume is None:
        return on_planes(planes, lambda s: above_ball(s, radius, 2))
    return over_volumes(planes, volume, lambda v: above_ball(v, radius, 3), radius)


@lru_cache(maxsize=64)
def resize_weights(n: int, scale: float) -> np.ndarray:
    """(target, source) weights of linear resizing of an axis, after a Gaussian if it shrinks; mirrored at the edge pixels."""
    new = max(1, round(n * scale))
    factor = n / new
    fold = lambda i: n - 1 - abs(n - 1 - abs(i) % (2 * n - 2)) if n > 1 else 0
    smooth = np.eye(n)
    if factor > 1 and n > 1:
        sigma = (factor - 1) / 2
        r = int(4 * sigma + 0.5)
        taps = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        smooth = np.zeros((n, n))
        for i in range(n):
            for o, t in zip(range(-r, r + 1), taps / taps.sum(), strict=True):
                smooth[i, fold(i + o)] += t
    linear = np.zeros((new, n))
    for i in range(new):
        c = (i + 0.5) * factor - 0.5
        low = int(np.floor(c))
        linear[i, fold(low)] += 1 - (c - low)
        linear[i, fold(low + 1)] += c - low
    return linear @ smooth


@register("Resize Image by YX Scale", "_yx_resized")
def resize_yx(planes: DataFrame, scale_factor: float = 0.5, integer: bool = True) -> DataFrame:
    """Planes made smaller or larger in y and x by linear weights; integer types are truncated."""
    if scale_factor <= 0:
        raise ValueError("a scale factor is above 0")

    def resize(s: np.ndarray) -> np.ndarray:
        out = resize_weights(s.shape[1], scale_factor) @ s @ resize_weights(s.shape[2], scale_factor).T
        return np.trunc(out + np.copysign(1e-9, out)) if integer else out

    return on_planes(planes, resize)
