"""ND2 files of version 3: chunks by name, which a map at the file's end gives the places of.

Loops of the experiment (time, positions, depth) give the order of its frames; positions are series, and a frame's components
channels. Frames that the map lacks aren't stored; they are read as zeros. Frames are plain or deflated.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np

Read = Callable[[int, int], bytes]
#: What chunks begin with, names of the chunks at both ends and of the map.
MAGIC = 0x0ABECEDA
FIRST, MAP, LAST = b"ND2 FILE SIGNATURE CHUNK NAME01!", b"ND2 FILEMAP SIGNATURE NAME 0001!", b"ND2 CHUNK MAP SIGNATURE 0000001!"
#: Kinds of loops as axes, of packings, and of values in metadata.
LOOPS = {1: "t", 2: "series", 4: "z", 8: "t"}
DEFLATED, PLAIN = 0, 2
NUMBERS = {1: "<?", 2: "<i", 3: "<I", 4: "<q", 5: "<Q", 6: "<d", 7: "<Q"}
TEXT, BYTES, LEVEL, PACKED = 8, 9, 11, 76


def chunk(read: Read, at: int) -> tuple[int, int]:
    """Place and size of the data of the chunk at a byte."""
    magic, name, size = struct.unpack("<IIQ", read(at, 16))
    if magic != MAGIC:
        raise ValueError(f"no chunk at byte {at}")
    return at + 16 + name, size


def chunks(read: Read, size: int) -> dict[str, int]:
    """Where each chunk begins."""
    if size < 56 or read(16, 32) != FIRST:
        raise ValueError("not an ND2 file of version 3")
    end = read(size - 40, 40)
    if end[:32] != LAST:
        raise ValueError("the file's map of chunks is missing")
    start, n = chunk(read, struct.unpack("<Q", end[32:])[0])
    table, at, out = read(start, n), 0, {}
    while (stop := table.find(b"!", at)) >= 0 and table[at : stop + 1] != LAST:
        out[table[at:stop].decode()] = struct.unpack_from("<Q", table, stop + 1)[0]
        at = stop + 17
    return out


def metadata(data: bytes, count: int = 1, at: int = 0) -> dict:
    """Named values, some of which are levels of named values."""
    out = {}
    if data[at : at + 1] == bytes([PACKED]):
        return metadata(zlib.decompress(data[at + 12 :]), count)
    for _ in range(count):
        if at >= len(data):
            break
        begin, kind, letters = at, data[at], data[at + 1]
        name, at = data[at + 2 : at + 2 + 2 * letters].decode("utf-16-le").rstrip("\0"), at + 2 + 2 * letters
        if kind in NUMBERS:
            (value,) = struct.unpack_from(NUMBERS[kind], data, at)
            at += struct.calcsize(NUMBERS[kind])
        elif kind == TEXT:
            stop = at
            while data[stop : stop + 2] not in (b"\0\0", b""):
                stop += 2
            value, at = data[at:stop].decode("utf-16-le", "replace"), stop + 2
        elif kind == BYTES:
            (n,) = struct.unpack_from("<Q", data, at)
            value, at = data[at + 8 : at + 8 + n], at + 8 + n
        elif kind == LEVEL:
            inner, length = struct.unpack_from("<IQ", data, at)
            value, at = metadata(data[: begin + length], inner, at + 12), begin + length + 8 * inner
        else:
            raise ValueError(f"metadata of kind {kind} aren't read")
        out[name] = value
    return out


def loops(level: dict) -> list[tuple[str, int, dict]]:
    """Axis, length and parameters of each loop of an experiment, outermost first."""
    out = []
    while level:
        pars = level.get("uLoopPars") or {}
        if "uiCount" not in pars and len(pars) == 1:
            (pars,) = pars.values()
        axis = LOOPS.get(level.get("eType"))
        if axis is None:
            raise ValueError(f"loops of kind {level.get('eType')} aren't read")
        valid = level.get("pItemValid")
        count = sum(map(bool, valid)) if axis == "series" and isinstance(valid, bytes) else pars.get("uiCount", 1)
        out.append((axis, count, pars))
        inner = level.get("ppNextLevelEx") or {}
        level = next((v for v in inner.values() if isinstance(v, dict)), {})
    return out


def plane_rows(read: Read, size: int) -> Iterator[dict]:
    """A row for each component of each frame."""
    at = chunks(read, size)

    def named(name: str) -> dict:
        return metadata(read(*chunk(read, at[name]))) if name in at else {}

    about = named("ImageAttributesLV").get("SLxImageAttributes")
    if not about:
        raise ValueError("the file has no attributes")
    h, w, comps, bits = about["uiHeight"], about["uiWidth"], about["uiComp"], about["uiBpcInMemory"]
    kind = np.dtype(f"{'f' if bits == 32 else 'u'}{bits // 8}").name
    packing = about.get("eCompression", PLAIN)
    if packing not in (DEFLATED, PLAIN):
        raise ValueError(f"frames of packing {packing} aren't read")
    order = loops(named("ImageMetadataLV").get("SLxExperiment", {}))
    if len({a for a, _, _ in order}) < len(order):
        raise ValueError("two loops along one axis aren't read")
    picture = named("ImageMetadataSeqLV|0").get("SLxPictureMetadata", {})
    side = picture.get("dCalibration") or None
    depth = next((abs(p["dZStep"]) for a, _, p in order if a == "z" and p.get("dZStep")), None)
    for n, place in enumerate(np.ndindex(*[count for _, count, _ in order])):
        own = {"t": 0, "series": 0, "z": 0} | {a: int(i) for (a, _, _), i in zip(order, place, strict=True)}
        where = at.get(f"ImageDataSeq|{n}")
        for c in range(comps):
            yield {
                **own, "name": f"position {own['series']}", "dtype": kind, "m": 0, "c": c, "h": h, "w": w, "scale_x": side, "scale_y": side, "scale_z": depth, "stored": where is not None,
                "spec": {"chunk": where, "row": about.get("uiWidthBytes", w * comps * bits // 8), "of": comps, "packed": packing == DEFLATED},
            }


def frame(read: Read, spec: dict) -> bytes:
    """The bytes of all components of a frame, after its time."""
    start, n = chunk(read, spec["chunk"])
    data = read(start + 8, n - 8)
    return zlib.decompress(data) if spec["packed"] else data


def plane_of(data: bytes, row: dict) -> np.ndarray:
    """A component of a frame, whose lines may be longer than its width."""
    kind, spec = np.dtype(row["dtype"]).newbyteorder("<"), row["spec"]
    lines = np.frombuffer(data, np.uint8, row["h"] * spec["row"]).reshape(row["h"], spec["row"])
    return np.ascontiguousarray(lines[:, : row["w"] * spec["of"] * kind.itemsize]).view(kind).reshape(row["h"], row["w"], spec["of"])[:, :, row["c"]]


# Writing


def values(named: dict) -> bytes:
    """Metadata of numbers and levels."""
    out = b""
    for name, value in named.items():
        label = (name + "\0").encode("utf-16-le")
        if isinstance(value, dict):
            inner, head = values(value), 2 + len(label) + 12
            body = struct.pack("<IQ", len(value), head + len(inner)) + inner + b"\0" * 8 * len(value)
        else:
            body = struct.pack("<d" if isinstance(value, float) else "<I", value)
        out += struct.pack("<BB", LEVEL if isinstance(value, dict) else 6 if isinstance(value, float) else 3, len(label) // 2) + label + body
    return out


def write(out, size: dict, planes: Iterator[tuple[int, int, int, int, np.ndarray]], dtype: str, packing: int = PLAIN) -> int:
    """An ND2 file from front to back: its size (nt, ns, nz, nc, h, w, scale), planes (t, series, z, c, pixels) in order; the number of planes.

    Of a frame components that are missing become zeros; a frame without any is left out.
    """
    kind = np.dtype(dtype).newbyteorder("<")
    at, where = 0, []

    def put(name: bytes, data: bytes, listed: bool = True) -> None:
        nonlocal at
        out.write(struct.pack("<IIQ", MAGIC, len(name), len(data)) + name + data)
        if listed:
            where.append(name + struct.pack("<QQ", at, len(data)))
        at += 16 + len(name) + len(data)

    put(FIRST, b"Ver3.0".ljust(64, b"\0"))
    made, ahead = 0, next(planes, None)
    while ahead is not None:
        key = ahead[:3]
        pixels = np.zeros((size["h"], size["w"], size["nc"]), kind)
        while ahead is not None and ahead[:3] == key:
            pixels[:, :, ahead[3]] = ahead[4]
            made, ahead = made + 1, next(planes, None)
        n = (key[0] * size["ns"] + key[1]) * size["nz"] + key[2]
        put(b"ImageDataSeq|%d!" % n, struct.pack("<d", float(n)) + (zlib.compress(pixels.tobytes()) if packing == DEFLATED else pixels.tobytes()))
    order = [(1, size["nt"], {}), (2, size["ns"], {}), (4, size["nz"], {"dZStep": float(size["scale"])})]
    level: dict = {}
    for code, count, more in reversed(order):
        level = {"eType": code, "uLoopPars": {"uiCount": count, **more}} | ({"ppNextLevelEx": {"": level}} if level else {})
    row = size["w"] * size["nc"] * kind.itemsize
    about = {"uiWidth": size["w"], "uiWidthBytes": row, "uiHeight": size["h"], "uiComp": size["nc"], "uiBpcInMemory": 8 * kind.itemsize, "uiSequenceCount": size["nt"] * size["ns"] * size["nz"], "eCompression": packing}
    put(b"ImageAttributesLV!", values({"SLxImageAttributes": about}))
    put(b"ImageMetadataLV!", values({"SLxExperiment": level}))
    put(b"ImageMetadataSeqLV|0!", values({"SLxPictureMetadata": {"dCalibration": float(size["scale"])}}))
    start = at
    put(MAP, b"".join(where) + LAST + struct.pack("<Q", start), False)
    out.write(LAST + struct.pack("<Q", start))
    return made
