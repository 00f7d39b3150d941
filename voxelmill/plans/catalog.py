"""What is known of images beside their pixels: axes from hints, metadata or shape, and output types."""

from __future__ import annotations

from collections.abc import Sequence

#: The axes that an image of so many dimensions has where nothing names them.
BY_DIMENSIONS = {2: "YX", 3: "ZYX", 4: "TZYX", 5: "TCZYX"}


def resolve_axes(shape: Sequence[int], hint: str | None = None, metadata: str | None = None, strict: bool = False) -> str:
    """The axes of an image: from a hint, else its file's metadata, else its number of dimensions.

    A hint that still names a channel axis that is gone loses it. One that names other axes than there are is passed
    over, or with `strict`, for operators that need to know an image's blocks, raises.
    """
    for named in (hint, metadata):
        named = (named or "").upper().replace("S", "C")
        if len(named) == len(shape) + 1 and "C" in named:
            named = named.replace("C", "")
        if len(named) == len(shape) and len(set(named)) == len(named) and {"Y", "X"} <= set(named) <= set("TCZYX"):
            return named
        if named and strict:
            raise ValueError(f"{named} doesn't name the axes of an image of sizes {tuple(shape)}")
    if len(shape) not in BY_DIMENSIONS:
        raise ValueError(f"no axes are known for {len(shape)} dimensions")
    return BY_DIMENSIONS[len(shape)]


def loop_axes(axes: str, spatial: int = 3) -> tuple[list[str], list[str]]:
    """Axes that blocks are told apart by, and the up to `spatial` axes of a block: t and c always loop."""
    names = [a.lower() for a in axes]
    space = [a for a in names if a in "zyx"][-spatial:]
    return [a for a in names if a not in space], space


def label_type(largest: int, source: str) -> str:
    """The narrowest unsigned type of labels; types up to uint32 stay as they are if they can hold them."""
    width = {"uint8": 8, "uint16": 16, "uint32": 32}
    if source in width and largest < 2 ** width[source]:
        return source
    return next((t for t, n in width.items() if largest < 2**n), "uint64")
