"""Files in and out, and folders that images keep arriving in."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.sources import arrays, sinks, store, zarr
from voxelmill.sources import tiff as form
from voxelmill.streaming import folders


def tiff(pages, end="<", deflate=False, big=False):
    """A TIFF of one strip a page."""
    word, many = ("Q", "Q") if big else ("I", "H")
    head = (b"II" if end == "<" else b"MM") + (struct.pack(end + "HHHQ", 43, 8, 0, 16) if big else struct.pack(end + "HI", 42, 8))
    out, links = bytearray(head), [8 if big else 4]
    for p in pages:
        raw = p.astype(p.dtype.newbyteorder(end)).tobytes()
        raw = zlib.compress(raw) if deflate else raw
        at = len(out)
        out += raw
        kind = {"u": 1, "i": 2, "f": 3}[p.dtype.kind]
        tags = [(256, p.shape[1]), (257, p.shape[0]), (258, p.dtype.itemsize * 8), (259, 8 if deflate else 1), (273, at), (277, 1), (279, len(raw)), (339, kind)]
        struct.pack_into(end + word, out, links[-1], len(out))
        out += struct.pack(end + many, len(tags))
        for tag, value in tags:
            out += struct.pack(end + "HH" + word + word, tag, 16 if big else 4, 1, value)
        links.append(len(out))
        out += struct.pack(end + word, 0)
    return bytes(out)


@pytest.mark.parametrize(("end", "deflate", "big", "kind"), [("<", False, False, "u1"), (">", True, False, "u2"), ("<", True, True, "f4"), (">", False, True, "i4")])
def test_tiff_round_trip(end, deflate, big, kind):
    pages = [np.random.default_rng(k).integers(0, 99, (4, 6)).astype(kind) for k in range(3)]
    data = tiff(pages, end, deflate, big)
    read = lambda at, n: data[at : at + n]
    got = [form.page_sample(read, p) for p in form.pages(read)]
    assert all((a == b).all() and a.dtype.itemsize == b.dtype.itemsize for a, b in zip(got, pages, strict=True))


def test_tiles_samples_and_predictor():
    """A tiled page of three samples with differences along rows, deflated and as Zstandard."""
    zstandard = pytest.importorskip("zstandard")
    image = np.random.default_rng(1).integers(0, 999, (5, 7, 3)).astype("<u2")
    for code, pack in ((8, zlib.compress), (50000, zstandard.ZstdCompressor().compress), (1, bytes), (32773, lambda d: b"".join(bytes([0, x]) for x in d))):
        tiles = []
        for y in (0, 4):
            for x in (0, 4):
                t = np.zeros((4, 4, 3), "<u2")
                part = image[y : y + 4, x : x + 4]
                t[: part.shape[0], : part.shape[1]] = part
                tiles.append(pack(np.diff(t, axis=1, prepend=np.zeros((4, 1, 3), "<u2")).astype("<u2").tobytes()))
        data = b"".join(tiles)
        at = np.cumsum([0] + [len(t) for t in tiles])
        page = {"h": 5, "w": 7, "samples": 3, "planar": False, "compression": code, "predictor": 2, "dtype": "<u2", "th": 4, "tw": 4, "offsets": at[:-1].tolist(), "counts": np.diff(at).tolist()}
        for k in range(3):
            assert (form.page_sample(lambda o, n, data=data: data[o : o + n], page, k) == image[:, :, k]).all()


def test_written_pages_are_read(tmp_path):
    for text in ("", "x", "ImageJ=\nslices=3\n"):
        pages = [np.random.default_rng(k).integers(0, 60000, (7, 9)).astype("u2") for k in range(3)]
        with store.replacing(f"{tmp_path}/deep/a.tif") as out:
            assert form.write_pages(out, iter(pages), text) == 3
        with store.Ranges(f"{tmp_path}/deep/a.tif") as read:
            found = list(form.pages(read))
            assert found[0]["description"] == text and all((form.page_sample(read, p) == a).all() for p, a in zip(found, pages, strict=True))
    assert store.names_in(f"{tmp_path}/deep") == ["a.tif"]


def test_stacks_of_five_axes(spark, tmp_path):
    """TIFF and Zarr, whole and one plane, with chunks of several planes and levels, as written elsewhere."""
    stack = np.arange(2 * 3 * 2 * 5 * 6).reshape(2, 3, 2, 5, 6)
    rows = [("img", t, c, z, 5, 6, stack[t, c, z].ravel().astype(float).tolist()) for t, c, z in np.ndindex(2, 3, 2)]
    df = spark.createDataFrame(rows, "path string, t int, c int, z int, h int, w int, data array<double>")
    same = lambda got: {(r["t"], r["c"], r["z"]): r["data"] for r in got.collect()} == {(r[1], r[2], r[3]): r[6] for r in rows}
    assert [tuple(r) for r in sinks.write_images(df, f"{tmp_path}/t").collect()] == [(f"{tmp_path}/t/img.tif", 12)]
    assert same(arrays.read_planes(spark, f"{tmp_path}/t"))
    one = arrays.plane_plan(spark, f"{tmp_path}/t").where("t = 1 AND c = 2 AND z = 0")
    assert arrays.load_planes(one).first()["data"] == rows[10][6]
    np.save(tmp_path / "back.npy", np.asfortranarray(stack[0, 0]))
    assert [r["data"] for r in arrays.read_planes(spark, str(tmp_path), (".npy",), recursive=False).orderBy("z").collect()] == [rows[0][6], rows[1][6]]
    assert zarr.write_zarr(df, f"{tmp_path}/z", dtype="uint16", chunk=4).first()["planes"] == 12
    assert same(zarr.read_zarr(spark, f"{tmp_path}/z")) and zarr.chunk_plan(spark, [f"{tmp_path}/z/img.zarr"]).select("t0", "c0", "z0").distinct().count() == 12
    # Version 3, chunks of two planes, gzip, one chunk missing: its pixels are the fill value.
    import gzip
    import json

    image = tmp_path / "three.zarr"
    (image / "0").mkdir(parents=True)
    (image / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"multiscales": [{"axes": [{"name": a} for a in "zyx"], "datasets": [{"path": "0"}]}]}}}))
    coding = {"zarr_format": 3, "node_type": "array", "shape": [3, 5, 6], "data_type": "int32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [2, 4, 4]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
              "fill_value": 9, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 1}}]}
    (image / "0" / "zarr.json").write_text(json.dumps(coding))
    want = np.arange(90).reshape(3, 5, 6)
    for z, y, x in np.ndindex(2, 2, 2):
        full = np.zeros((2, 4, 4), "<i4")
        part = want[2 * z : 2 * z + 2, 4 * y : 4 * y + 4, 4 * x : 4 * x + 4]
        full[: part.shape[0], : part.shape[1], : part.shape[2]] = part
        if (z, y, x) != (1, 1, 1):
            (image / "0" / "c" / str(z) / str(y)).mkdir(parents=True, exist_ok=True)
            (image / "0" / "c" / str(z) / str(y) / str(x)).write_bytes(gzip.compress(full.tobytes()))
    want[2, 4, 4:] = 9
    got = zarr.read_zarr(spark, str(image)).orderBy("z").collect()
    assert [r["data"] for r in got] == [p.ravel().tolist() for p in want] and got[0]["dtype"] == "int32"


def test_read_planes(spark, tmp_path):
    stack = np.arange(2 * 3 * 4).reshape(2, 3, 4).astype("u2")
    np.save(tmp_path / "a.npy", stack)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.tif").write_bytes(tiff(list(stack)))
    (tmp_path / "bad.tif").write_bytes(b"II*\0nonsense")
    (tmp_path / "notes.txt").write_text("x")
    planes = arrays.read_planes(spark, str(tmp_path), on_error="skip")
    rows = planes.collect()
    assert len(rows) == 4 and {(r["axes"], r["dtype"], r["h"], r["w"]) for r in rows} == {("ZYX", "uint16", 3, 4)}
    assert all(r["data"] == stack[r["z"]].ravel().tolist() for r in rows)
    assert arrays.pixels_of(planes).where("z = 1 AND y = 2 AND x = 3").select("v").distinct().collect()[0][0] == 23
    report = {r["path"].rsplit("/", 1)[1]: r["status"] for r in arrays.conversion_report(spark, str(tmp_path), planes).collect()}
    assert report == {"a.npy": "success", "b.tif": "success", "bad.tif": "failed", "notes.txt": "skipped"}
    assert {r["t"] for r in arrays.read_planes(spark, str(tmp_path), (".npy",), axes="TYX").collect()} == {0, 1}
    with pytest.raises(Exception, match="TIFF|strips|unpack|bytes|buffer"):
        arrays.read_planes(spark, str(tmp_path)).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "n int, filename string, t int")
    sinks.write_table(df, f"{tmp_path}/t", first=["filename"])
    assert spark.read.option("header", "true").csv(f"{tmp_path}/t").columns == ["filename", "n", "t"]
    assert sinks.append_new(df, f"{tmp_path}/c", "filename") == 2
    more = df.union(spark.createDataFrame([(3, "c", 0)], df.schema))
    assert sinks.append_new(more, f"{tmp_path}/c", "filename") == 1 and spark.read.option("header", "true").csv(f"{tmp_path}/c").count() == 3
    sinks.write_planes(df, f"{tmp_path}/p", ["t"])
    assert spark.read.parquet(f"{tmp_path}/p").where("t = 1").count() == 1
    assert sinks.catalog(spark, str(tmp_path)).where("name LIKE 'part-%'").count() >= 3


def test_labels_take_the_narrowest_type(spark, tmp_path):
    df = spark.createDataFrame([("a.tif", 0, 0, 0, 1, 2, [0.0, 70000.0])], "path string, t int, c int, z int, h int, w int, data array<double>")
    assert sinks.label_dtype(df, "uint8") == "uint32"
    assert sinks.write_labels(df, str(tmp_path), source="uint8").first()["image"].endswith("/a_labels.tif")
    got = arrays.read_planes(spark, str(tmp_path)).first()
    assert got["dtype"] == "uint32" and got["data"] == [0.0, 70000.0]
    assert [r["path"] for r in sinks.select_files(spark.createDataFrame([("x.TIF",), ("y.txt",)], "path string"), [".tif"]).collect()] == ["x.TIF"]


def test_resized_images_have_the_new_scale(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 0, z, 4, 6, [float(k) for k in range(24)]) for z in range(2)], "path string, t int, c int, z int, h int, w int, data array<double>")
    zarr.write_zarr(df, str(tmp_path), scale={"z": 2.0, "y": 0.5, "x": 0.5})
    zarr.resize_zarr(spark, f"{tmp_path}/a.zarr", f"{tmp_path}/half", 0.5)
    d = zarr.described(f"{tmp_path}/half/a.zarr")
    assert d["shape"] == [1, 1, 2, 2, 3] and d["scale"] == {"t": 1.0, "c": 1.0, "z": 2.0, "y": 1.0, "x": 1.0}


def test_metadata(spark):
    ome = '{"multiscales":[{"axes":[{"name":"z","unit":"um"},{"name":"y"}],"datasets":[{"path":"0","coordinateTransformations":[{"type":"scale","scale":[2.0,0.5]}]}]}]}'
    assert spark.createDataFrame([(ome,)], "j string").select(sinks.ome_scale(F.col("j"))).first()[0] == {"z": 2.0, "y": 0.5}
    xml = "<M><Scaling><Items><Distance Id='X'><Value>6.5e-07</Value></Distance><Distance Id='Z'><Value>5</Value></Distance></Items></Scaling></M>"
    r = sinks.czi_scales(spark.createDataFrame([(xml,)], "xml string")).first()
    assert np.isclose(r["scale_x"], 0.65) and r["scale_z"] is None


def test_arriving_images_are_done_once(spark, tmp_path):
    rows = [(k, y, x, y * 2 + x, 1 + y) for k in range(4) for y in range(2) for x in range(2)]
    df = spark.createDataFrame(rows, "image_id int, y int, x int, v int, label int")
    src, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    df.where("image_id < 2").coalesce(1).write.mode("append").parquet(src)
    folders.regions_of_arriving(folders.arriving(spark, src, df, 1), out, check).awaitTermination()
    df.where("image_id >= 2").coalesce(1).write.mode("append").parquet(src)
    folders.regions_of_arriving(folders.arriving(spark, src, df, 1), out, check).awaitTermination()
    from voxelmill.operators.regions import regionprops

    want = regionprops(df)
    got = spark.read.parquet(out).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 8


@pytest.mark.parametrize("form", ["tif", "npy"])
def test_images_stay_whole_where_joins_are_planned_anew(spark, tmp_path, form):
    """Sizes too large to broadcast by the plan and small enough when they are there: an image's planes still meet in one task."""
    ids = spark.range(0, 400, 1, 8)
    frame = ids.select(F.concat(F.lit("m"), F.col("id") % 4).alias("path"), F.floor(F.col("id") / 4).cast("int").alias("t"), F.lit(0).alias("c"), F.lit(0).alias("z"), F.lit(16).alias("h"), F.lit(32).alias("w"), F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.when(i == 0, F.col("id") % 251).otherwise(F.pmod(F.xxhash64(i, "id"), F.lit(251))).cast("double")).alias("data"))
    keys = {"spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "200k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for key, n in keys.items():
            spark.conf.set(key, n)
        done = sinks.write_images(frame, str(tmp_path / "out"), dtype="uint8", form=form)
        assert sorted((r["image"][-6:-4], r["planes"]) for r in done.collect()) == [(f"m{k}", 100) for k in range(4)]
        got = {(r["path"][-6:-4], r["t"]): r["data"][0] for r in arrays.read_planes(spark, str(tmp_path / "out"), axes="TYX" if form == "npy" else None).collect()}
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert got == {(f"m{k % 4}", k // 4): k % 251 for k in range(400)}
