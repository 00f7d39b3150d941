"""LIF and ND2 files."""

import io
import json
import struct

import numpy as np
import pytest

from voxelmill.sources import containers, lif, nd2

ROWS = "path string, series int, t int, c int, z int, h int, w int, data array<double>"


def random_series(dtype, n=2, shape=(7, 5), seed=3):
    rng = np.random.default_rng(seed)
    return {(s, t, c, z): rng.integers(0, 250, shape).astype(dtype) for s in range(n) for t in range(3) for c in range(2) for z in range(2)}


def frame_of(spark, data, name="plate"):
    return spark.createDataFrame([(name, *k, *v.shape, v.astype(float).ravel().tolist()) for k, v in data.items()], ROWS)


def planes_of(df):
    return {(r["series"], r["t"], r["c"], r["z"]): np.array(r["data"]).reshape(r["h"], r["w"]) for r in df.collect()}


def same(got, want):
    return set(got) == set(want) and all((got[k] == v).all() for k, v in want.items())


@pytest.mark.parametrize(("form", "dtype", "packing"), [("lif", "uint8", 2), ("lif", "uint16", 2), ("lif", "float32", 2), ("nd2", "uint8", 2), ("nd2", "uint16", nd2.DEFLATED), ("nd2", "float32", nd2.PLAIN)])
def test_series_come_back(spark, tmp_path, form, dtype, packing):
    data = random_series(dtype)
    assert containers.write_series(frame_of(spark, data), str(tmp_path), form=form, dtype=dtype, scale=0.25, packing=packing).first()["planes"] == len(data)
    plan = containers.container_plan(spark, str(tmp_path))
    assert same(planes_of(containers.load_series(plan)), data)
    assert plan.select("dtype", "stored").distinct().collect() == [(dtype, True)]
    one = plan.where("series = 1 AND t = 2").first()
    assert (one["scale_x"], one["scale_y"], one["scale_z"]) == pytest.approx((0.25, 0.25, 0.25))
    assert same(planes_of(containers.read_series(spark, str(tmp_path), 1)), {k: v for k, v in data.items() if k[0] == 1})


def test_series_of_several_sizes(spark, tmp_path):
    data = random_series("uint8", 1) | {(1, 0, 0, 0): np.full((2, 9), 7, np.uint8)}
    containers.write_series(frame_of(spark, data), str(tmp_path), dtype="uint8")
    got = planes_of(containers.read_series(spark, str(tmp_path)))
    assert same(got, data)
    with pytest.raises(Exception, match="several sizes"):
        containers.write_series(frame_of(spark, data), str(tmp_path), form="nd2", dtype="uint8")


@pytest.mark.parametrize("form", ["lif", "nd2"])
def test_missing_frames_are_zeros(spark, tmp_path, form):
    data = random_series("uint16")
    gone = [(0, 1, c, 1) for c in range(2)]
    containers.write_series(frame_of(spark, {k: v for k, v in data.items() if k not in gone}), str(tmp_path), form=form)
    plan = containers.container_plan(spark, str(tmp_path))
    assert same(planes_of(containers.load_series(plan)), data | {k: np.zeros((7, 5)) for k in gone})
    assert plan.where("NOT stored").count() == (2 if form == "nd2" else 0)


def bytes_of(write, *args):
    out = io.BytesIO()
    write(out, *args)
    return out.getvalue()


def reader(data, spent=None):
    def read(at, n):
        if spent is not None:
            spent.append(n)
        return data[at : at + n]

    return read


def test_cut_lif(spark, tmp_path):
    """What was stored before the file ends is read."""
    size = {"name": "a", "nt": 4, "nz": 1, "nc": 1, "h": 3, "w": 4, "scale": 1.0}
    whole = bytes_of(lif.write, [size], iter([(0, t, 0, 0, np.full((3, 4), t + 1)) for t in range(4)]), "uint8")
    (tmp_path / "cut.lif").write_bytes(whole[:-17])  # the last plane and a part of the one before
    plan = containers.container_plan(spark, str(tmp_path))
    assert [r["stored"] for r in plan.orderBy("t").collect()] == [True, True, False, False]
    assert [v.max() for _, v in sorted(planes_of(containers.load_series(plan)).items())] == [1, 2, 0, 0]


def lif_file(xml, blocks, wide):
    text = xml.encode("utf-16-le")
    out = struct.pack("<iiBi", 0x70, len(text) + 5, 0x2A, len(text) // 2) + text
    for name, data in blocks:
        label = name.encode("utf-16-le")
        out += struct.pack("<iiB" + ("q" if wide else "I") + "Bi", 0x70, 0, 0x2A, len(data), 0x2A, len(label) // 2) + label + data
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_lif_of_others(spark, tmp_path, wide):
    """Folders of images, samples between each other, a mosaic, a block that no image names, an image without block, sections along the depth."""

    def image(name, channels, dims, block):
        c = "".join(f'<ChannelDescription DataType="0" Resolution="{bits}" BytesInc="{at}"/>' for bits, at in channels)
        d = "".join(f'<DimensionDescription DimID="{k}" NumberOfElements="{n}" Length="{length}" BytesInc="{b}" Unit="m"/>' for k, n, length, b in dims)
        return f'<Element Name="{name}"><Data><Image><ImageDescription><Channels>{c}</Channels><Dimensions>{d}</Dimensions></ImageDescription></Image></Data><Memory Size="0" MemoryBlockID="{block}"/></Element>'

    rng = np.random.default_rng(4)
    rgb, tiles, section = rng.integers(0, 255, (4, 5, 3), np.uint8), rng.integers(0, 4000, (3, 2, 6), np.uint16), rng.integers(0, 255, (6, 4), np.uint8)
    inner = image("rgb", [(8, 0), (8, 1), (8, 2)], [(1, 5, 4e-6, 3), (2, 4, 1.5e-6, 15)], "B1") + image("tiles", [(12, 0)], [(1, 6, 5e-6, 2), (2, 2, 0, 12), (10, 3, 0, 24)], "B2")
    more = image("lost", [(8, 0)], [(1, 2, 0, 1), (2, 2, 0, 2)], "none") + image("section", [(8, 0)], [(1, 4, 3e-6, 1), (3, 6, 5e-6, 4)], "B4")
    xml = f'<LMSDataContainerHeader Version="{2 if wide else 1}"><Element Name="top"><Children><Element Name="sub"><Children>{inner}</Children></Element>{more}</Children></Element></LMSDataContainerHeader>'
    blocks = [("B4", section.tobytes()), ("other", b"12345"), ("B1", rgb.tobytes()), ("B2", tiles.tobytes())]
    (tmp_path / "x.lif").write_bytes(lif_file(xml, blocks, wide))
    plan = containers.container_plan(spark, str(tmp_path))
    assert sorted({(r["series"], r["name"]) for r in plan.collect()}) == [(0, "top/sub/rgb"), (1, "top/sub/tiles"), (2, "top/lost"), (3, "top/section")]
    got = {(r["series"], r["m"], r["c"]): np.array(r["data"]).reshape(r["h"], r["w"]) for r in containers.load_series(plan).collect()}
    assert all((got[0, 0, c] == rgb[:, :, c]).all() for c in range(3)) and all((got[1, m, 0] == tiles[m]).all() for m in range(3))
    assert not got[2, 0, 0].any() and (got[3, 0, 0] == section).all()
    first = plan.where("series = 0").first()
    assert (first["scale_x"], first["scale_y"], first["scale_z"]) == (pytest.approx(1.0), pytest.approx(0.5), None)


def test_only_a_planes_bytes_are_read():
    big = np.arange(64 * 64, dtype=np.uint16).reshape(64, 64)
    series = {"name": "a", "nt": 50, "nz": 1, "nc": 1, "h": 64, "w": 64, "scale": 1.0}
    whole = bytes_of(lif.write, [series], iter([(0, t, 0, 0, big + t) for t in range(50)]), "uint16")
    spent = []
    rows = list(lif.plane_rows(reader(whole, spent), len(whole)))
    assert len(rows) == 50 and sum(spent) < 4000
    row = rows[30]
    assert row["spec"]["n"] == 64 * 64 * 2 and (lif.plane_of(reader(whole)(row["spec"]["at"], row["spec"]["n"]), row) == big + 30).all()
    whole = bytes_of(nd2.write, {**series, "ns": 1}, iter([(t, 0, 0, 0, big + t) for t in range(50)]), "uint16")
    spent.clear()
    rows = list(nd2.plane_rows(reader(whole, spent), len(whole)))
    assert len(rows) == 50 and sum(spent) < 6000
    spent.clear()
    assert (nd2.plane_of(nd2.frame(reader(whole, spent), rows[30]["spec"]), rows[30]) == big + 30).all() and sum(spent) == 64 * 64 * 2 + 16


def test_nd2_metadata():
    """Levels, packed levels, texts, bytes, lines that are longer than their width, positions that were left out."""
    about = {"a": {"uiCount": 3, "deep": {"x": 1.5}}, "b": 7}
    assert nd2.metadata(nd2.values(about), 2) == about
    import zlib

    assert nd2.metadata(bytes([nd2.PACKED, 0]) + bytes(10) + zlib.compress(nd2.values(about)), 2) == about
    text = bytes([nd2.TEXT, 2]) + "s\0".encode("utf-16-le") + "ab\0".encode("utf-16-le") + bytes([nd2.BYTES, 2]) + "v\0".encode("utf-16-le") + struct.pack("<Q", 3) + b"\1\0\1"
    assert nd2.metadata(text, 2) == {"s": "ab", "v": b"\1\0\1"}
    level = {"eType": 2, "uLoopPars": {"i0": {"uiCount": 3}}, "pItemValid": b"\1\0\1", "ppNextLevelEx": {"i0": {"eType": 8, "uLoopPars": {"uiCount": 4}}}}
    assert [(a, n) for a, n, _ in nd2.loops(level)] == [("series", 2), ("t", 4)]
    with pytest.raises(ValueError, match="kind 6"):
        nd2.loops({"eType": 6})
    row = {"dtype": "uint16", "h": 2, "w": 3, "c": 1, "spec": {"row": 14, "of": 2}}
    lines = np.arange(14, dtype="<u2")
    assert nd2.plane_of(lines.tobytes(), row).tolist() == [[1, 3, 5], [8, 10, 12]]


def test_files_that_arent_read(spark, tmp_path):
    (tmp_path / "a.lif").write_bytes(b"none")
    (tmp_path / "b.nd2").write_bytes(b"\0" * 100)
    (tmp_path / "c.lif").write_bytes(lif_file("<LMSDataContainerHeader", [], True))
    size = {"nt": 1, "ns": 1, "nz": 1, "nc": 1, "h": 2, "w": 2, "scale": 1.0}
    (tmp_path / "d.nd2").write_bytes(bytes_of(nd2.write, size, iter([(0, 0, 0, 0, np.ones((2, 2)))]), "uint8"))
    assert containers.read_series(spark, str(tmp_path), on_error="skip").count() == 1
    with pytest.raises(Exception, match="LIF|ND2|tree"):
        containers.container_plan(spark, str(tmp_path)).count()
    assert json.loads(containers.container_plan(spark, str(tmp_path), "skip").first()["spec"])["of"] == 1
