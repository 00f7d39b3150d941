"""What chunks of Zarr stores are packed with: Blosc frames, Zstandard, zlib and gzip, check sums, and the index of a shard.

A Blosc frame has a head of 16 bytes, where its blocks begin, and the blocks, each of one stream or one for each byte of an
element; streams are packed by LZ4, Snappy, zlib or Zstandard, and bytes or bits of a block's elements may be shuffled.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

#: Flags of a Blosc frame, its packers by number, and what its splitting of blocks depends on.
SHUFFLED, COPIED, BITS_SHUFFLED, WHOLE_BLOCKS = 1, 2, 4, 16
PACKERS = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}
MOST_STREAMS, LEAST_STREAM = 16, 128
#: Fixed value: offset and length of a chunk that a shard doesn't have.
ABSENT = (1 << 64) - 1


def inflate(data: bytes, packer: str, size: int) -> bytes:
    """A stream of a Blosc frame whose unpacked size is known."""
    return zlib.decompress(data) if packer == "zlib" else pa.Codec(packer).decompress(data, size).to_pybytes()


def unshuffle(block: bytes, width: int, bits: bool) -> bytes:
    """Elements of a block from the planes of their bytes or bits; what is left over after whole elements stays."""
    n = len(block) // width
    body = np.frombuffer(block, np.uint8, n * width)
    if not bits:
        return body.reshape(width, n).T.tobytes() + block[n * width :]
    if n % 8:
        return block
    planes = np.unpackbits(body.reshape(width * 8, n // 8), axis=1, bitorder="little")
    return np.packbits(planes.T, axis=1, bitorder="little").tobytes() + block[n * width :]


def unblosc(frame: bytes) -> bytes:
    """What a Blosc frame holds."""
    if len(frame) < 16:
        raise ValueError("a Blosc frame has a head of 16 bytes")
    _, _, flags, width, size, block, packed = struct.unpack_from("<BBBBIII", frame)
    if packed > len(frame):
        raise ValueError("a Blosc frame is cut off")
    if flags & COPIED:
        return frame[16 : 16 + size]
    if flags >> 5 not in PACKERS:
        raise ValueError(f"Blosc frames of packer {flags >> 5} aren't read")
    packer, count = PACKERS[flags >> 5], -(-size // block) if size else 0
    out = bytearray()
    for k, at in enumerate(struct.unpack_from(f"<{count}I", frame, 16)):
        own = min(block, size - k * block)
        split = own == block and not flags & WHOLE_BLOCKS and width <= MOST_STREAMS and block // width >= LEAST_STREAM
        streams, part = width if split else 1, bytearray()
        for _ in range(streams):
            (n,) = struct.unpack_from("<I", frame, at)
            stream = frame[at + 4 : at + 4 + n]
            part += stream if n == own // streams else inflate(stream, packer, own // streams)
            at += 4 + n
        shuffled = width > 1 and flags & SHUFFLED or flags & BITS_SHUFFLED
        out += unshuffle(bytes(part), width, bool(flags & BITS_SHUFFLED)) if shuffled else part
    return bytes(out)


def crc32c(data: bytes) -> int:
    """The Castagnoli check sum."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0x82F63B78 if k & 1 else 0)
        table.append(k)
    crc = 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF


def unpacked(data: bytes, codecs: Sequence[str]) -> bytes:
    """A chunk's bytes, through its codecs from the last to the first."""
    for codec in reversed(codecs):
        if codec == "crc32c":
            data = data[:-4]
        elif codec == "blosc":
            data = unblosc(data)
        elif codec == "zlib":
            data = zlib.decompress(data)
        elif codec == "gzip":
            data = gzip.decompress(data)
        elif codec == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        else:
            raise ValueError(f"compressor {codec} isn't read")
    return data


def packed(data: bytes, codec: str, level: int) -> bytes:
    if codec == "zstd":
        return pa.Codec("zstd", compression_level=level).compress(data).to_pybytes()
    if codec in ("zlib", "gzip"):
        return (zlib if codec == "zlib" else gzip).compress(data, level)
    if codec:
        raise ValueError(f"compressor {codec} isn't written")
    return data


def shard_of(chunks: Sequence[bytes | None]) -> bytes:
    """Chunks end to end and, after them, the index: offset and length of each, and a check sum."""
    at, entries = 0, []
    for c in chunks:
        entries += [ABSENT, ABSENT] if c is None else [at, len(c)]
        at += len(c or b"")
    index = struct.pack(f"<{len(entries)}Q", *entries)
    return b"".join(c or b"" for c in chunks) + index + struct.pack("<I", crc32c(index))


def index_of(data: bytes, checked: bool) -> np.ndarray:
    """(chunk, 2): where each chunk of a shard is and how long, from the bytes of its index."""
    if checked:
        data, (own,) = data[:-4], struct.unpack("<I", data[-4:])
        if crc32c(data) != own:
            raise ValueError("a shard's index is damaged")
    return np.frombuffer(data, "<u8").reshape(-1, 2)
