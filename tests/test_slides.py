"""Slides by tiles, JPEG segments, floating-point predictors, folders of plates."""

import io
import itertools
import struct
import zlib

import numpy as np
import pytest

from voxelmill.sources import arrays, jpeg, slides, tiff, wells

# A plain encoder: every symbol of AC has a code of 8 bits, every symbol of DC one of 4.
AC = [s for s in range(256) if s != 0x0F][:255]
TABLES = b"".join(
    struct.pack(">BBHB", 0xFF, 0xC4, 19 + len(s), kind) + bytes(len(s) if k == n else 0 for k in range(1, 17)) + bytes(s) for kind, n, s in ((0, 4, list(range(12))), (16, 8, AC))
)


def steps_of(q):
    return struct.pack(">BBHB", 0xFF, 0xDB, 67, 0) + bytes([q] * 64)


def zigzag_walk():
    y = x = 0
    up = True
    for _ in range(64):
        yield 8 * y + x
        if up:
            if x == 7:
                y, up = y + 1, False
            elif y == 0:
                x, up = x + 1, False
            else:
                y, x = y - 1, x + 1
        elif y == 7:
            x, up = x + 1, True
        elif x == 0:
            y, up = y + 1, True
        else:
            y, x = y + 1, x - 1


WALK = list(zigzag_walk())


def encode(parts, h, w, sampling, q=1, every=0, tables=True):
    """A JPEG stream of component planes (already in the sizes of their sampling, padded to whole units)."""
    n = len(parts)
    head = b"\xff\xd8" + (TABLES + steps_of(q) if tables else b"")
    head += struct.pack(">BBHBHHB", 0xFF, 0xC0, 8 + 3 * n, 8, h, w, n) + b"".join(bytes([k + 1, a << 4 | d, 0]) for k, (a, d) in enumerate(sampling))
    if every:
        head += struct.pack(">BBHH", 0xFF, 0xDD, 4, every)
    head += struct.pack(">BBHB", 0xFF, 0xDA, 6 + 2 * n, n) + b"".join(bytes([k + 1, 0]) for k in range(n)) + bytes([0, 63, 0])
    out, bits, last = [], [], [0] * n

    def put(value, length):
        bits.append(format(value, f"0{length}b") if length else "")

    def number(v):
        size = abs(v).bit_length()
        return size, v if v >= 0 else v + (1 << size) - 1

    def flush():
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        bits.clear()
        out.append(bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)).replace(b"\xff", b"\xff\0"))

    down, right = parts[0].shape[0] // (8 * sampling[0][1]), parts[0].shape[1] // (8 * sampling[0][0])
    for unit, (r, c) in enumerate(itertools.product(range(down), range(right))):
        if every and unit and unit % every == 0:
            flush()
            out.append(bytes([0xFF, 0xD0 + (unit // every - 1) % 8]))
            last = [0] * n
        for k, (plane, (a, d)) in enumerate(zip(parts, sampling, strict=True)):
            for y, x in itertools.product(range(r * d, r * d + d), range(c * a, c * a + a)):
                cell = plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8].astype(float) - 128
                i, j = np.mgrid[:8, :8]
                cosines = np.where(i == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * j + 1) * i * np.pi / 16)
                values = np.rint((cosines @ cell @ cosines.T).ravel()[WALK] / q).astype(int).tolist()
                size, v = number(values[0] - last[k])
                last[k] = values[0]
                put(size, 4)
                put(v, size)
                run = 0
                end = max([p for p in range(1, 64) if values[p]], default=0)
                for p in range(1, end + 1):
                    if not values[p]:
                        run += 1
                        continue
                    while run > 15:
                        put(AC.index(0xF0), 8)
                        run -= 16
                    size, v = number(values[p])
                    put(AC.index(run << 4 | size), 8)
                    put(v, size)
                    run = 0
                if end < 63:
                    put(AC.index(0), 8)
    flush()
    return head + b"".join(out) + b"\xff\xd9"


def smooth(h, w, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    return np.clip(128 + 90 * np.sin(y / 5 + seed) * np.cos(x / 7) + rng.normal(0, 3, (h, w)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("every", [0, 2])
def test_jpeg_of_one_component(every):
    image = smooth(20, 27)
    padded = np.pad(image, ((0, 4), (0, 5)), "edge")
    got = jpeg.decode(encode([padded], 20, 27, [(1, 1)], every=every))
    assert got.shape == (20, 27, 1) and np.abs(got[:, :, 0].astype(int) - image).max() <= 1


def test_jpeg_of_colours():
    """Luminance in full, colours at half size; the transform against its formula."""
    y, b, r = smooth(32, 48, 1), smooth(16, 24, 2) // 4 + 96, smooth(16, 24, 3) // 4 + 96
    stream = encode([y, b, r], 32, 48, [(2, 2), (1, 1), (1, 1)])
    plain = jpeg.decode(stream, ycc=False).astype(int)
    big = [v.repeat(2, 0).repeat(2, 1).astype(int) for v in (b, r)]
    assert max(np.abs(plain[:, :, k] - v).max() for k, v in enumerate([y.astype(int), *big])) <= 1
    got = jpeg.decode(stream).astype(int)
    blue, red = plain[:, :, 1] - 128, plain[:, :, 2] - 128
    want = np.stack([plain[:, :, 0] + 1.402 * red, plain[:, :, 0] - 0.344136 * blue - 0.714136 * red, plain[:, :, 0] + 1.772 * blue], 2)
    assert np.abs(got - np.clip(np.rint(want), 0, 255)).max() <= 1


def test_jpeg_that_isnt_read():
    good = encode([smooth(8, 8)], 8, 8, [(1, 1)])
    for bad in (b"", b"\xff\xd8\xff\xd9", good.replace(b"\xff\xc0", b"\xff\xc2"), good[:-8].replace(b"\xff\xc0\x00\x0b\x08", b"\xff\xc0\x00\x0b\x0c")):
        with pytest.raises(ValueError):
            jpeg.decode(bad)


def tagged(tags, segments, following=False):
    """A classic TIFF page at byte 8 whose tags (tag, type, values) are longs, shorts or bytes; segments come last."""
    size = {3: 2, 4: 4, 7: 1, 2: 1}
    tags = sorted([*tags, (324, 4, [0] * len(segments)), (325, 4, [len(s) for s in segments])])
    at = 8 + 2 + 12 * len(tags) + 4
    extra = sum(size[t] * len(v) for _, t, v in tags if size[t] * len(v) > 4)
    places = list(itertools.accumulate([at + extra, *map(len, segments[:-1])]))
    table, body = b"", b""
    for tag, kind, v in tags:
        v = places if tag == 324 else v
        raw = bytes(v) if size[kind] == 1 else struct.pack(f"<{len(v)}{'H' if kind == 3 else 'I'}", *v)
        table += struct.pack("<HHI", tag, kind, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(body)))
        body += raw if len(raw) > 4 else b""
    return struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + table + struct.pack("<I", 0) + body + b"".join(segments)


def test_jpeg_tiles_with_shared_tables(spark, tmp_path):
    """A slide of 2 x 2 tiles, the first read alone and all as a plane."""
    image = [smooth(64, 64, 1), smooth(64, 64, 2) // 4 + 96, smooth(64, 64, 3) // 4 + 96]
    tiles = [encode([v[y : y + 32, x : x + 32] for v in image], 32, 32, [(1, 1)] * 3, tables=False) for y in (0, 32) for x in (0, 32)]
    shared = b"\xff\xd8" + TABLES + steps_of(1) + b"\xff\xd9"
    data = tagged([(256, 4, [64]), (257, 4, [64]), (258, 3, [8, 8, 8]), (259, 3, [7]), (262, 3, [6]), (277, 3, [3]), (322, 4, [32]), (323, 4, [32]), (347, 7, list(shared))], tiles)
    (tmp_path / "s.svs").write_bytes(data)
    (tmp_path / "s.tif").write_bytes(data)
    want = np.concatenate([np.concatenate([jpeg.decode(tiles[2 * r + c], shared, True) for c in (0, 1)], 1) for r in (0, 1)], 0)
    plan = slides.slide_plan(spark, str(tmp_path)).where("path LIKE '%svs'")
    got = {r["c"]: np.array(r["data"]).reshape(r["h"], r["w"]) for r in slides.load_region(plan, 0, 20, 10, 30, 100).collect()}
    assert sorted(got) == [0, 1, 2] and all((got[c] == want[20:50, 10:64, c]).all() for c in got)
    planes = {r["c"]: np.array(r["data"]).reshape(r["h"], r["w"]) for r in arrays.read_planes(spark, str(tmp_path)).collect()}
    assert all((planes[c] == want[:, :, c]).all() for c in range(3))


@pytest.mark.parametrize("kind", ["float32", "float64"])
def test_floating_point_predictor(kind):
    image = np.random.default_rng(5).normal(0, 1e6, (9, 11)).astype(kind)
    n = image.itemsize
    rows = image.astype(f">f{n}").view(np.uint8).reshape(9, 11, n).transpose(0, 2, 1).reshape(9, -1)
    stored = np.concatenate([rows[:, :1], np.diff(rows, axis=1)], 1)
    data = zlib.compress(stored.tobytes())
    file = tagged([(256, 4, [11]), (257, 4, [9]), (258, 3, [8 * n]), (259, 3, [8]), (317, 3, [3]), (339, 3, [3]), (322, 4, [11]), (323, 4, [9])], [data])
    read = lambda at, size: file[at : at + size]
    assert (tiff.page_sample(read, next(tiff.pages(read))) == image).all()


def test_levels_and_regions(spark, tmp_path):
    rng = np.random.default_rng(6)
    data = {(name, c): rng.integers(0, 255, (70, 90), np.uint8) for name in ("a", "b") for c in range(3)}
    rows = [(name, c, 70, 90, v.astype(float).ravel().tolist()) for (name, c), v in data.items()]
    df = spark.createDataFrame(rows, "path string, c int, h int, w int, data array<double>")
    assert sorted(r["tiles"] for r in slides.write_slides(df, str(tmp_path), tile=32, levels=3, scale=0.5).collect()) == [9 + 4 + 1] * 2
    plan = slides.slide_plan(spark, str(tmp_path))
    found = sorted({(r["level"], r["factor"], r["scale"], r["plane_h"], r["plane_w"]) for r in plan.collect()})
    assert [(f[0], f[3], f[4]) for f in found] == [(0, 70, 90), (1, 35, 45), (2, 18, 23)] and found[1][1:3] == (2.0, 1.0)
    got = {(r["path"][-5], r["c"]): np.array(r["data"]).reshape(r["h"], r["w"]) for r in slides.load_region(plan, 1, 5, 30, 20, 40).collect()}
    assert set(got) == set(data) and all((got[k] == v[::2, ::2][5:25, 30:45]).all() for k, v in data.items())
    assert slides.touching(plan, 1, 5, 33, 20, 7).count() == 2 and slides.load_region(plan, 7, 0, 0, 9, 9).count() == 0
    (tmp_path / "bad.ndpi").write_bytes(b"none")
    assert slides.slide_plan(spark, str(tmp_path), "skip").count() == 28


def test_only_a_tiles_bytes_are_read():
    out = io.BytesIO()
    image = np.random.default_rng(7).integers(0, 255, (512, 512, 1), np.uint8)
    slides.write_levels(out, [image, image[::2, ::2].copy()], 64, 1.0)
    spent = []

    def read(at, n):
        spent.append(n)
        return out.getvalue()[at : at + n]

    page = tiff.levels(read)[1]
    assert sum(spent) < 4000
    spent.clear()
    assert (tiff.segment_at(read, page, 5)[:, :, 0] == image[::2, ::2, 0][64:128, 64:128]).all() and sum(spent) == page["counts"][5]


def test_pages_that_are_no_levels():
    """A thumbnail in strips, a label of another form."""
    out = io.BytesIO()
    image = np.zeros((64, 96, 3), np.uint8)
    slides.write_levels(out, [image, image[::2, ::2].copy(), np.zeros((30, 30, 3), np.uint8), np.zeros((16, 24, 1), np.uint8)], 16, 1.0)
    read = lambda at, n: out.getvalue()[at : at + n]
    assert [(p["h"], p["w"]) for p in tiff.levels(read)] == [(64, 96), (32, 48)]


def test_wells(spark, tmp_path):
    """Fields of names become axes that count from 0; a name without a well is no part of a plate."""
    for folder, well, po, lo, co, sl in [("p", "A001", 1, 3, 2, 5), ("p", "A001", 1, 7, 2, 5), ("p", "C012", 1, 3, 6, 9), ("p", "C012", 2, 3, 6, 9), ("q", "B002", 1, 1, 1, 1)]:
        (tmp_path / folder).mkdir(exist_ok=True)
        np.save(tmp_path / folder / f"-{well}--PO{po:02}--LO{lo:03}--CO{co}--SL{sl:03}--PX32500--PW0080.npy", np.full((2, 3), lo * 10 + co))
    np.save(tmp_path / "p" / "overview.npy", np.zeros((2, 3)))
    plan = wells.well_plan(arrays.plane_plan(spark, str(tmp_path)))
    got = sorted((r["dataset"][-1], r["well"], r["position"], r["series"], r["t"], r["c"], r["z"], r["scale"], r["data"][0]) for r in arrays.load_planes(plan).collect())
    assert got == [("p", "A001", 1, 0, 0, 0, 0, 3.25, 32.0), ("p", "A001", 1, 0, 1, 0, 0, 3.25, 72.0), ("p", "C012", 1, 1, 0, 1, 1, 3.25, 36.0), ("p", "C012", 2, 1, 0, 1, 1, 3.25, 36.0), ("q", "B002", 1, 0, 0, 0, 0, 3.25, 11.0)]
    assert sorted(r["series"] for r in wells.well_plan(arrays.plane_plan(spark, str(tmp_path)), True).where("dataset LIKE '%p'").collect()) == [0, 0, 1, 2]
