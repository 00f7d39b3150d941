"""Baseline JPEG images, as TIFF files hold them: Huffman codes by tables, blocks by matrix products.

Tables may come from a stream of their own that images of one file share. Coefficients of 8-bit baseline and extended
sequential images are read; progressive, lossless and arithmetic ones raise. Components that are stored smaller are enlarged by repetition.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

#: Markers.
SOF0, SOF1, DHT, SOI, EOI, SOS, DQT, DRI, RST0, RST7, ADOBE = 0xC0, 0xC1, 0xC4, 0xD8, 0xD9, 0xDA, 0xDB, 0xDD, 0xD0, 0xD7, 0xEE


def zigzag() -> np.ndarray:
    """The place in a block of each coefficient in the order of the stream: diagonals, every other one upwards."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * y + x for y, x in cells])


def basis() -> np.ndarray:
    """Rows of the orthonormal cosine transform."""
    k, n = np.mgrid[:8, :8]
    return np.where(k == 0, np.sqrt(1 / 8), 1 / 2) * np.cos((2 * n + 1) * k * np.pi / 16)


ORDER, COSINES = zigzag(), basis()


def huffman(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits that a stream may go on with the code's length times 256 plus its symbol; 0 where no code begins so."""
    table = np.zeros(1 << 16, np.int64)
    code = at = 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code += 1
        code, at = code << 1, at + n
    return table.tolist()


def segments(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """Marker, content and end of each segment, up to the first scan."""
    at = 2 if data[:2] == bytes([0xFF, SOI]) else 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker in (0xFF, SOI):
            at += 1 if marker == 0xFF else 2
            continue
        if marker == EOI:
            return
        (n,) = struct.unpack_from(">H", data, at + 2)
        yield marker, data[at + 4 : at + 2 + n], at + 2 + n
        if marker == SOS:
            return
        at += 2 + n


class Bits:
    """The bits of a stretch between two restarts; 16 at a time from any place."""

    def __init__(self, data: bytes) -> None:
        padded = np.frombuffer(data.replace(b"\xff\0", b"\xff") + b"\xff" * 8, np.uint8).astype(np.int64)
        wide = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
        self.ahead = ((wide[:, None] >> np.arange(8, 0, -1)) & 0xFFFF).ravel().tolist()
        self.at = 0

    def code(self, table: list[int]) -> int:
        found = table[self.ahead[self.at]]
        if not found:
            raise ValueError("no such code")
        self.at += found >> 8
        return found & 255

    def number(self, n: int) -> int:
        """A number of n bits, of which those that begin with 0 are negative."""
        if not n:
            return 0
        value = self.ahead[self.at] >> (16 - n)
        self.at += n
        return value if value >> (n - 1) else value - (1 << n) + 1


def stretches(data: bytes, start: int) -> list[bytes]:
    """The scan's bytes between its restarts, up to the next other marker."""
    out, begin, at = [], start, start
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        marker = data[at + 1]
        if RST0 <= marker <= RST7:
            out.append(data[begin:at])
            begin = at + 2
        elif marker not in (0, 0xFF):
            return [*out, data[begin:at]]
        at += 1 if marker == 0xFF else 2
    return [*out, data[begin:]]


def decode(data: bytes, tables: bytes = b"", ycc: bool | None = None) -> np.ndarray:
    """(y, x, component) bytes of an image; with `ycc` luminance and colour differences become red, green and blue, without it as the stream says."""
    steps, codes, every, parts, adobe = {}, {}, 0, [], None
    start = 0
    for marker, body, end in [*segments(tables), *segments(data)]:
        if marker == DQT:
            at = 0
            while at < len(body):
                wide = body[at] >> 4
                table = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1)
                steps[body[at] & 15] = table.astype(np.float64)
                at += 1 + 64 * (1 + wide)
        elif marker == DHT:
            at = 0
            while at < len(body):
                n = sum(body[at + 1 : at + 17])
                codes[body[at]] = huffman(body[at + 1 : at + 17], body[at + 17 : at + 17 + n])
                at += 17 + n
        elif marker in (SOF0, SOF1):
            bits, h, w, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not h or not w:
                raise ValueError(f"JPEG of {bits} bits and {h} lines isn't read")
            parts = [{"id": body[6 + 3 * k], "across": body[7 + 3 * k] >> 4, "down": body[7 + 3 * k] & 15, "steps": body[8 + 3 * k]} for k in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"JPEG of kind {marker - SOF0} isn't read")
        elif marker == DRI:
            (every,) = struct.unpack(">H", body[:2])
        elif marker == ADOBE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif marker == SOS:
            of = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            start = end
    if not parts or not start:
        raise ValueError("not a JPEG image")
    if set(of) != {p["id"] for p in parts}:
        raise ValueError("JPEG of several scans isn't read")
    if len(parts) == 1:
        parts[0] |= {"across": 1, "down": 1}
    wide, high = max(p["across"] for p in parts), max(p["down"] for p in parts)
    rows, columns = -(-h // (8 * high)), -(-w // (8 * wide))
    for p in parts:
        p["blocks"] = np.zeros((rows * p["down"], columns * p["across"], 64))
        p["dc"], p["ac"] = codes[of[p["id"]] >> 4], codes[16 | of[p["id"]] & 15]
    units = rows * columns
    every = every or units
    for k, stretch in enumerate(stretches(data, start)[: -(-units // every)]):
        bits, last = Bits(stretch), [0] * len(parts)
        for unit in range(k * every, min(units, (k + 1) * every)):
            row, column = divmod(unit, columns)
            for c, p in enumerate(parts):
                for y in range(row * p["down"], (row + 1) * p["down"]):
                    for x in range(column * p["across"], (column + 1) * p["across"]):
                        last[c] += bits.number(bits.code(p["dc"]))
                        at, block = 1, p["blocks"][y, x]
                        block[0] = last[c]
                        while at < 64:
                            symbol = bits.code(p["ac"])
                            if not symbol & 15:
                                if symbol != 0xF0:
                                    break
                                at += 16
                                continue
                            at += symbol >> 4
                            if at > 63:
                                raise ValueError("a block has too many coefficients")
                            block[at] = bits.number(symbol & 15)
                            at += 1
    planes = []
    for p in parts:
        across = np.empty_like(p["blocks"])
        across[:, :, ORDER] = p["blocks"] * steps[p["steps"]]
        flat = COSINES.T @ across.reshape(*across.shape[:2], 8, 8) @ COSINES
        plane = flat.transpose(0, 2, 1, 3).reshape(8 * flat.shape[0], 8 * flat.shape[1])
        planes.append(plane.repeat(high // p["down"], 0).repeat(wide // p["across"], 1)[:h, :w] + 128)
    out = np.stack(planes, 2)
    if len(parts) == 3 and (ycc if ycc is not None else adobe != 0):
        y, b, r = np.moveaxis(np.clip(np.rint(out), 0, 255), 2, 0)
        # Luminance weights of red 0.299 and blue 0.114.
        red, blue = y + 2 * (1 - 0.299) * (r - 128), y + 2 * (1 - 0.114) * (b - 128)
        out = np.stack([red, (y - 0.299 * red - 0.114 * blue) / (1 - 0.299 - 0.114), blue], 2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
