"""TIFF and BigTIFF: pages by byte ranges, and files of pages written from front to back.

Strips and tiles, plain, deflated, LZW, PackBits, Zstandard or baseline JPEG, with or without differences along rows (of floating-point
numbers too), samples side by side or in planes of their own. A page's table of contents is read without its pixels, and so are those
of smaller levels that it names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np

from . import jpeg

Read = Callable[[int, int], bytes]
#: Field types as struct codes, tags, compressions, and kinds of numbers.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 13: "I", 16: "Q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 317, 339
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SUB, TABLES, LENS = 322, 323, 324, 325, 330, 347, 65421
ACROSS, UNIT = 282, 296
PLAIN, LZW, JPEG, DEFLATE, OLD_DEFLATE, PACKBITS, ZSTD = 1, 5, 7, 8, 32946, 32773, 50000
YCC = 6
KINDS = {1: "u", 2: "i", 3: "f"}


def layout(read: Read) -> tuple[str, bool, int]:
    """Order of bytes, whether places are of 64 bits, and the place of the first page's table."""
    head = read(0, 16)
    if head[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    end = "<" if head[:2] == b"II" else ">"
    big = struct.unpack(end + "H", head[2:4])[0] == 43
    return end, big, struct.unpack_from(end + ("Q" if big else "I"), head, 8 if big else 4)[0]


def page_at(read: Read, at: int, end: str, big: bool) -> tuple[dict, int]:
    """A page's size, type, description and where its segments are, and the place of the next page's table."""
    word, entry, count = ("Q", 20, "Q") if big else ("I", 12, "H")
    size = struct.calcsize(word)
    n = struct.unpack(end + count, read(at, struct.calcsize(count)))[0]
    table = read(at + struct.calcsize(count), n * entry + size)
    tags: dict[int, tuple] = {}
    shared = None
    for k in range(n):
        tag, kind, many = struct.unpack_from(end + "HH" + word, table, k * entry)
        field = table[k * entry + 4 + size : (k + 1) * entry]
        if tag == TABLES and many > size:
            shared = [struct.unpack(end + word, field[:size])[0], many]
        elif code := TYPES.get(kind):
            form = end + (f"{many}s" if code == "s" else code * many)
            length = struct.calcsize(form)
            tags[tag] = struct.unpack(form, field[:length] if length <= size else read(struct.unpack(end + word, field[:size])[0], length))
    one = lambda tag, default: tags.get(tag, (default,))[0]
    h, w, tiled = one(HEIGHT, 0), one(WIDTH, 0), TILE_OFFSETS in tags
    page = {
        "h": h, "w": w, "samples": one(SAMPLES, 1), "planar": one(PLANAR, 1) == 2, "compression": one(COMPRESSION, PLAIN), "predictor": one(PREDICTOR, 1),
        "dtype": f"{end}{KINDS[one(FORMAT, 1)]}{one(BITS, 8) // 8}", "th": one(TILE_HEIGHT, 0) if tiled else min(one(ROWS, h), h), "tw": one(TILE_WIDTH, 0) if tiled else w,
        "offsets": list(tags[TILE_OFFSETS if tiled else OFFSETS]), "counts": list(tags[TILE_COUNTS if tiled else COUNTS]), "description": one(DESCRIPTION, b"").rstrip(b"\0").decode("utf-8", "replace"),
        "tiled": tiled, "ycc": one(PHOTOMETRIC, 1) == YCC, "tables": shared, "sub": list(tags.get(SUB, ())), "lens": one(LENS, None), "across": tags.get(ACROSS, (0, 0)), "unit": one(UNIT, 2),
    }
    return page, struct.unpack_from(end + word, table, n * entry)[0]


def pages(read: Read) -> Iterator[dict]:
    """Of each page its size, type, description and where its segments are."""
    end, big, at = layout(read)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        page, at = page_at(read, at, end, big)
        yield page


def levels(read: Read) -> list[dict]:
    """The first page and its smaller copies, largest first: those that it names itself, else other pages of its form, laid out like it.

    Labels, overviews of the slide and thumbnails have another form or layout, or a lens that says so.
    """
    end, big, _ = layout(read)
    found = list(pages(read))
    first = found[0]
    others = [page_at(read, at, end, big)[0] for at in first["sub"]] or found[1:]
    alike = [p for p in others if p["w"] < first["w"] and abs(first["w"] / p["w"] * p["h"] / first["h"] - 1) < 0.02 + 1 / min(p["h"], p["w"])]
    alike = [p for p in alike if (p["tiled"], p["samples"], p["dtype"]) == (first["tiled"], first["samples"], first["dtype"]) and (p["lens"] is None or p["lens"] > 0)]
    return [first, *sorted(alike, key=lambda p: -p["w"])]


def unpack_bits(data: bytes) -> bytes:
    """Runs: n literal bytes after n - 1, or one byte 257 - n times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, last, bits = list(first), bytearray(), b"", 9
    held, have = 0, 0
    for byte in data:
        held, have = held << 8 | byte, have + 8
        if have < bits:
            continue
        have -= bits
        code, held = held >> have, held & ((1 << have) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, bits = list(first), b"", 9
            continue
        now = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + now[:1])
        out += now
        last, bits = now, max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def unpacked(data: bytes, compression: int, tables: bytes = b"", ycc: bool = False) -> bytes:
    if compression == PLAIN:
        return data
    if compression == JPEG:
        return jpeg.decode(data, tables, ycc).tobytes()
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == LZW:
        return unpack_lzw(data)
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"compression {compression} isn't read")


def undone(raw: bytes, page: dict, rows: int, inner: int) -> np.ndarray:
    """(y, x, sample) of a segment's bytes, the predictor undone."""
    kind, tw = np.dtype(page["dtype"]), page["tw"]
    native = kind.newbyteorder("=")
    if page["predictor"] == 1:
        return np.frombuffer(raw, kind, rows * tw * inner).reshape(rows, tw, inner).astype(native)
    if page["predictor"] == 2:
        return np.cumsum(np.frombuffer(raw, kind, rows * tw * inner).reshape(rows, tw, inner).astype(native), 1, dtype=native)
    if page["predictor"] != 3 or kind.kind != "f":
        raise ValueError("this predictor isn't read")
    # Differences of bytes, of which a row has all first ones of its numbers, then all second ones, high ones first.
    n = kind.itemsize
    bytes_of = np.cumsum(np.frombuffer(raw, np.uint8, rows * tw * inner * n).reshape(rows, -1, inner), 1, dtype=np.uint8)
    return np.ascontiguousarray(bytes_of.reshape(rows, n, tw * inner).transpose(0, 2, 1)).view(f">f{n}").reshape(rows, tw, inner).astype(native)


def segment_at(read: Read, page: dict, k: int) -> np.ndarray:
    """(y, x, sample) of the k-th strip or tile of a page; the last strip may have fewer rows. Tiles that were left out, of no bytes, are zeros."""
    kind, inner = np.dtype(page["dtype"]), 1 if page["planar"] else page["samples"]
    if not page["counts"][k]:
        return np.zeros((page["th"], page["tw"], inner), kind.newbyteorder("="))
    shared = page.get("tables")
    raw = unpacked(read(page["offsets"][k], page["counts"][k]), page["compression"], read(*shared) if shared and page["compression"] == JPEG else b"", page.get("ycc", False))
    return undone(raw, page, min(page["th"], len(raw) // (page["tw"] * inner * kind.itemsize)), inner)


def page_sample(read: Read, page: dict, sample: int = 0) -> np.ndarray:
    """One sample of a page: its segments put in their places."""
    h, w, th, tw = page["h"], page["w"], page["th"], page["tw"]
    across = -(-w // tw)
    each = across * -(-h // th)
    first = sample * each if page["planar"] else 0
    out = np.empty((h, w), np.dtype(page["dtype"]).newbyteorder("="))
    for k in range(each):
        y, x = k // across * th, k % across * tw
        part = segment_at(read, page, first + k)[:, :, 0 if page["planar"] else sample]
        out[y : y + len(part), x : x + tw] = part[: h - y, : w - x]
    return out


def hyperstack(description: str) -> tuple[str, tuple[int, ...]]:
    """Axes and sizes that a description of ImageJ's form (`frames=`, `slices=`, `channels=`) states for the pages in order."""
    if not description.startswith("ImageJ="):
        return "", ()
    found = {m[1]: int(m[2]) for m in re.finditer(r"^(frames|slices|channels)=(\d+)", description, re.M)}
    stated = [(a, found.get(n, 1)) for a, n in (("T", "frames"), ("Z", "slices"), ("C", "channels"))]
    return "".join(a for a, n in stated if n > 1), tuple(n for _, n in stated if n > 1)


def write_pages(out, planes: Iterator[np.ndarray], description: str = "", level: int = 6) -> int:
    """A BigTIFF of deflated pages of one strip, written from front to back; the number of pages."""
    at, n = 16, 0
    out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))
    now = next(planes, None)
    while now is not None:
        ahead = next(planes, None)
        data, text = zlib.compress(np.ascontiguousarray(now).tobytes(), level), description.encode() + b"\0" if description and not n else b""
        kind = {"u": 1, "i": 2, "f": 3, "b": 1}[now.dtype.kind]
        short = text if len(text) <= 8 else b""
        fields = [
            (WIDTH, 4, 1, now.shape[1]), (HEIGHT, 4, 1, now.shape[0]), (BITS, 3, 1, now.dtype.itemsize * 8), (COMPRESSION, 3, 1, DEFLATE), (PHOTOMETRIC, 3, 1, 1),
            *([(DESCRIPTION, 2, len(text), int.from_bytes(short.ljust(8, b"\0"), "little") if short else None)] if text else []),
            (OFFSETS, 16, 1, None), (SAMPLES, 3, 1, 1), (ROWS, 4, 1, now.shape[0]), (COUNTS, 16, 1, len(data)), (FORMAT, 3, 1, kind),
        ]
        after = at + 8 + 20 * len(fields) + 8
        inside, pad = (text if text and not short else b""), b"\0" * (-(after + (0 if short else len(text))) % 8)
        start = after + len(inside) + len(pad)
        end = start + len(data)
        gap = -end % 8
        table = b"".join(struct.pack("<HHQQ", tag, t, many, v if v is not None else after if tag == DESCRIPTION else start) for tag, t, many, v in fields)
        out.write(struct.pack("<Q", len(fields)) + table + struct.pack("<Q", end + gap if ahead is not None else 0) + inside + pad + data + b"\0" * gap)
        at, n, now = end + gap, n + 1, ahead
    return n
