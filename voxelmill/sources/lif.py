"""LIF files: a tree of images in XML, then blocks of memory that the tree refers to by name.

Each image of the tree is a series. Its dimensions say how many bytes apart neighbours are, so a plane is a range of its block and
lines of it steps of that range. Planes that a block is too short for, or that have no block, aren't stored; they are read as zeros.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import numpy as np

Read = Callable[[int, int], bytes]
#: What blocks and their fields begin with, and the numbers of dimensions.
BLOCK, FIELD = 0x70, 0x2A
X, Y, Z, T, MOSAIC = 1, 2, 3, 4, 10


def tree(read: Read) -> tuple[ElementTree.Element, int]:
    """The tree of images, and where the blocks begin."""
    head = read(0, 13)
    if len(head) < 13 or struct.unpack_from("<i", head)[0] != BLOCK or head[8] != FIELD:
        raise ValueError("not a LIF file")
    (size,) = struct.unpack_from("<i", head, 9)
    try:
        return ElementTree.fromstring(read(13, 2 * size).decode("utf-16-le").lstrip("\ufeff").rstrip("\0")), 13 + 2 * size
    except (ElementTree.ParseError, UnicodeDecodeError) as e:
        raise ValueError(f"a LIF file's tree can't be read: {e}") from e


def blocks(read: Read, size: int, at: int, wide: bool) -> dict[str, tuple[int, int]]:
    """Place and size of each block of memory by its name; a file that was cut ends with the last whole head."""
    out = {}
    field = "<q" if wide else "<I"
    while at + 9 < size:
        head = read(at, 9 + struct.calcsize(field) + 5)
        if len(head) < 9 + struct.calcsize(field) + 5:
            break
        if struct.unpack_from("<i", head)[0] != BLOCK or head[8] != FIELD or head[-5] != FIELD:
            raise ValueError(f"no block of memory at byte {at}")
        (used,), (letters,) = struct.unpack_from(field, head, 9), struct.unpack_from("<i", head, len(head) - 4)
        start = at + len(head) + 2 * letters
        out[read(at + len(head), 2 * letters).decode("utf-16-le").rstrip("\0")] = (start, max(0, min(used, size - start)))
        at = start + used
    return out


def images(node: ElementTree.Element, above: str = "") -> Iterator[tuple[str, ElementTree.Element, str]]:
    """Name with those of the folders around it, description and block's name of each image, in the order of the tree."""
    for element in [node] if node.tag == "Element" else node.findall("Element"):
        name = f"{above}/{element.get('Name', '')}".lstrip("/")
        memory = element.find("Memory")
        if (about := element.find("Data/Image/ImageDescription")) is not None:
            yield name, about, "" if memory is None else memory.get("MemoryBlockID", "")
        if (inner := element.find("Children")) is not None:
            yield from images(inner, name)


def plane_rows(read: Read, size: int) -> Iterator[dict]:
    """A row for each plane of each image."""
    root, at = tree(read)
    stored = blocks(read, size, at, int(root.get("Version", "1")) >= 2)
    for series, (name, about, block) in enumerate(images(root)):
        sizes, steps, scales = {}, {}, {}
        for d in about.findall("Dimensions/DimensionDescription"):
            k, n = int(d.get("DimID")), int(d.get("NumberOfElements"))
            length = abs(float(d.get("Length") or 0)) * 1e6
            sizes[k], steps[k], scales[k] = n, int(d.get("BytesInc")), length / (n - 1) if n > 1 and length > 0 else None
        channels = about.findall("Channels/ChannelDescription")
        if X not in sizes or not channels:
            continue  # a list of measurements
        down = Y if Y in sizes else Z  # a section along the depth has no other rows
        h, w = sizes.get(down, 1), sizes[X]
        start, have = stored.get(block, (0, 0))
        outer = [T, MOSAIC, *([Z] if down == Y else [])]
        for place in np.ndindex(*[sizes.get(a, 1) for a in outer]):
            first = sum(int(i) * steps.get(a, 0) for a, i in zip(outer, place, strict=True))
            own = dict(zip(outer, map(int, place), strict=True))
            for c, channel in enumerate(channels):
                bits, real = int(channel.get("Resolution", 8)), channel.get("DataType") == "1"
                wide = next(n for n in (1, 2, 4, 8) if bits <= 8 * n)
                offset = first + int(channel.get("BytesInc") or 0)
                span = (h - 1) * steps.get(down, 0) + (w - 1) * steps[X] + wide
                yield {
                    "series": series, "name": name, "dtype": np.dtype(f"{'f' if real else 'u'}{wide}").name, "t": own[T], "m": own[MOSAIC], "c": c, "z": own.get(Z, 0), "h": h, "w": w,
                    "scale_x": scales[X], "scale_y": scales.get(down), "scale_z": scales.get(Z) if down == Y else None, "stored": offset + span <= have,
                    "spec": {"at": start + offset, "n": span, "step": [steps.get(down, 0), steps[X]]},
                }


def plane_of(data: bytes, row: dict) -> np.ndarray:
    """The plane of a range of bytes."""
    kind = np.dtype(row["dtype"]).newbyteorder("<")
    down, right = row["spec"]["step"]
    at = (np.arange(row["h"])[:, None] * down + np.arange(row["w"]) * right)[..., None] + np.arange(kind.itemsize)
    return np.frombuffer(data, np.uint8)[at].view(kind)[..., 0]


def write(out, series: list[dict], planes: Iterator[tuple[int, int, int, int, np.ndarray]], dtype: str) -> int:
    """A LIF file from front to back: series (name, nt, nz, nc, h, w, scale in micrometres) in the order of their numbers, planes (series, t, z, c, pixels) in order; the number of planes.

    Planes that are missing become zeros.
    """
    kind = np.dtype(dtype).newbyteorder("<")
    elements = []
    for k, s in enumerate(series):
        plane = s["h"] * s["w"] * kind.itemsize
        dims = [(X, s["w"], kind.itemsize), (Y, s["h"], s["w"] * kind.itemsize), (Z, s["nz"], plane * s["nc"]), (T, s["nt"], plane * s["nc"] * s["nz"])]
        length = {a: s.get("scale", 1.0) * (n - 1) / 1e6 for a, n, _ in dims}
        described = "".join(f'<DimensionDescription DimID="{a}" NumberOfElements="{n}" Origin="0" Length="{length[a]!r}" Unit="m" BytesInc="{b}"/>' for a, n, b in dims)
        channels = "".join(f'<ChannelDescription DataType="{int(kind.kind == "f")}" Resolution="{8 * kind.itemsize}" BytesInc="{c * plane}"/>' for c in range(s["nc"]))
        elements.append(
            f"<Element Name={quoteattr(s['name'])}><Data><Image><ImageDescription><Channels>{channels}</Channels><Dimensions>{described}</Dimensions></ImageDescription></Image></Data>"
            f'<Memory Size="{plane * s["nc"] * s["nz"] * s["nt"]}" MemoryBlockID="MemBlock_{k}"/></Element>'
        )
    text = f'<LMSDataContainerHeader Version="2"><Element Name="all"><Children>{"".join(elements)}</Children></Element></LMSDataContainerHeader>'.encode("utf-16-le")
    out.write(struct.pack("<iiBi", BLOCK, len(text) + 5, FIELD, len(text) // 2) + text)
    made, ahead = 0, next(planes, None)
    for k, s in enumerate(series):
        name = f"MemBlock_{k}".encode("utf-16-le")
        plane = s["h"] * s["w"] * kind.itemsize
        out.write(struct.pack("<iiBqBi", BLOCK, 14 + len(name), FIELD, plane * s["nc"] * s["nz"] * s["nt"], FIELD, len(name) // 2) + name)
        for t, z, c in np.ndindex(s["nt"], s["nz"], s["nc"]):
            if ahead is not None and ahead[:4] == (k, t, z, c):
                out.write(np.ascontiguousarray(ahead[4], kind).tobytes())
                made, ahead = made + 1, next(planes, None)
            else:
                out.write(b"\0" * plane)
    if ahead is not None:
        raise ValueError(f"plane {ahead[:4]} is of no series, or there twice")
    return made
