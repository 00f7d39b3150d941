"""Blosc frames, shards, chunk-wise reading, and the data source of images."""

import contextlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelmill.sources import arrays, codecs, datasource, metadata, sinks, store, zarr

# Blosc


def shuffled(block, width, bits):
    n = len(block) // width
    a = np.frombuffer(block, np.uint8, n * width).reshape(n, width)
    rest = block[n * width :]
    if not bits:
        return b"".join(a[:, k].tobytes() for k in range(width)) + rest
    if n % 8:
        return block
    planes = [[(int(e[j]) >> b) & 1 for e in a] for j in range(width) for b in range(8)]
    return b"".join(bytes(sum(p[k + i] << i for i in range(8)) for k in range(0, n, 8)) for p in planes) + rest


def frame(data, width, block, packer, shuffle=True, bits=False, whole=False, copied=False):
    """A plain encoder of Blosc frames, stream by stream."""
    flags = packer << 5 | (shuffle and not bits) * 1 | copied * 2 | bits * 4 | whole * 16
    if copied:
        return struct.pack("<BBBBIII", 2, 1, flags, width, len(data), block, 16 + len(data)) + data
    pack = {1: pa.Codec("lz4_raw").compress, 2: pa.Codec("snappy").compress, 3: zlib.compress, 4: pa.Codec("zstd").compress}[packer]
    starts, body, at = [], b"", 16 + 4 * -(-len(data) // block)
    for lo in range(0, len(data), block):
        part = data[lo : lo + block]
        split = len(part) == block and not whole and width <= 16 and block // width >= 128
        streams = width if split else 1
        mixed = shuffled(part, width, bits) if bits or shuffle and width > 1 else part
        starts.append(at + len(body))
        for k in range(streams):
            own = mixed[k * len(part) // streams : (k + 1) * len(part) // streams]
            small = bytes(memoryview(pack(own)))
            small = small if len(small) < len(own) else own
            body += struct.pack("<I", len(small)) + small
    return struct.pack("<BBBBIII", 2, 1, flags, width, len(data), block, at + len(body)) + struct.pack(f"<{len(starts)}I", *starts) + body


@pytest.mark.parametrize("packer", [1, 2, 3, 4])
@pytest.mark.parametrize(("width", "bits", "shuffle", "whole"), [(1, False, False, False), (2, False, True, False), (4, False, True, True), (2, True, True, False), (8, True, True, True), (4, False, False, False), (1, True, True, False)])
def test_blosc_round_trip(packer, width, bits, shuffle, whole):
    rng = np.random.default_rng(width)
    for n in (0, 1, 100, 4096, 10000, 4096 + 8 * width + 3):
        for data in (np.cumsum(rng.integers(0, 3, n)).astype(f"<u{width}").tobytes(), rng.bytes(n)):
            assert codecs.unblosc(frame(data, width, 2048, packer, shuffle, bits, whole)) == data
    assert codecs.unblosc(frame(b"abc", width, 2048, packer, copied=True)) == b"abc"


def test_blosc_frames_that_arent_read():
    good = frame(bytes(1000), 1, 2048, 1)
    for bad in (b"", good[:10], good[:-1], good[:2] + bytes([good[2] & 31]) + good[3:]):
        with pytest.raises(ValueError, match="Blosc"):
            codecs.unblosc(bad)


def test_check_sums_and_damaged_indexes():
    assert codecs.crc32c(b"123456789") == 0xE3069283
    shard = codecs.shard_of([b"abc", None, b"de"])
    index = codecs.index_of(shard[-52:], True)
    assert index.tolist() == [[0, 3], [codecs.ABSENT] * 2, [3, 2]]
    with pytest.raises(ValueError, match="damaged"):
        codecs.index_of(shard[-52:-5] + b"\1" + shard[-4:], True)


# Stores


def image(h=37, w=45, n=2):
    return np.random.default_rng(7).integers(0, 60000, (n, h, w))


def blosc_store(folder, data, chunk, order="C", sep=".", dtype="<u2"):
    """A version 2 store of TYX with Blosc frames, as most are."""
    level = folder / "0"
    level.mkdir(parents=True)
    (folder / ".zattrs").write_text(json.dumps({"multiscales": [{"axes": [{"name": a} for a in "tyx"], "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 0.5, 0.25]}]}]}]}))
    meta = {"zarr_format": 2, "shape": data.shape, "chunks": chunk, "dtype": dtype, "compressor": {"id": "blosc", "cname": "lz4"}, "fill_value": 9, "order": order, "filters": None, "dimension_separator": sep}
    (level / ".zarray").write_text(json.dumps(meta))
    for at in np.ndindex(*[-(-n // c) for n, c in zip(data.shape, chunk, strict=True)]):
        part = data[tuple(slice(a * c, (a + 1) * c) for a, c in zip(at, chunk, strict=True))].astype(dtype)
        full = np.zeros(chunk, dtype)
        full[tuple(slice(0, n) for n in part.shape)] = part
        (level / sep.join(map(str, at))).write_bytes(frame(full.tobytes(order=order), full.itemsize, 512, 1))
    return level


def planes(df):
    return {(r["t"], r["z"]): np.array(r["data"]).reshape(r["h"], r["w"]) for r in df.collect()}


@pytest.mark.parametrize(("chunk", "order", "dtype"), [((1, 16, 16), "C", "<u2"), ((2, 20, 45), "F", ">u2"), ((2, 64, 64), "C", "<u4")])
def test_blosc_stores_are_read(spark, tmp_path, chunk, order, dtype):
    data = image()
    level = blosc_store(tmp_path / "a.zarr", data, chunk, order, dtype=dtype)
    got = planes(zarr.read_zarr(spark, str(tmp_path)))
    assert all((got[t, 0] == data[t]).all() for t in range(2))
    (level / "0.0.0").unlink()  # a chunk that isn't there has the fill value
    got = planes(zarr.read_zarr(spark, str(tmp_path)))
    assert (got[0, 0][: chunk[1], : chunk[2]] == 9).all() and (got[0, 0][chunk[1] :] == data[0][chunk[1] :]).all()


@pytest.mark.parametrize(("version", "shard", "codec"), [(2, 0, "zstd"), (2, 0, "zlib"), (3, 0, "gzip"), (3, 0, ""), (3, 16, "zstd"), (3, 32, "gzip")])
def test_written_stores_are_read(spark, tmp_path, version, shard, codec):
    data = image()
    data[0, :20] = 0
    df = spark.createDataFrame([("a", t, 0, 0, 37, 45, data[t].astype(float).ravel().tolist()) for t in range(2)], "path string, t int, c int, z int, h int, w int, data array<double>")
    zarr.write_zarr(df, str(tmp_path), dtype="uint16", chunk=8, levels=2, codec=codec, version=version, shard=shard, scale={"y": 0.5})
    for level in (0, 1):
        got = planes(zarr.read_zarr(spark, str(tmp_path), level))
        assert all((got[t, 0] == data[t][:: level + 1, :: level + 1]).all() for t in range(2))
    assert zarr.described(f"{tmp_path}/a.zarr", 1)["scale"]["y"] == 1.0
    with pytest.raises(ValueError, match="levels"):
        zarr.described(f"{tmp_path}/a.zarr", 2)
    for bad in ({"codec": "lzma"}, {"version": 3, "shard": 12}, {"version": 2, "shard": 16}):
        with pytest.raises(ValueError):
            zarr.write_zarr(df, str(tmp_path), chunk=8, **bad)


def test_one_chunk_of_a_shard_is_read_alone(spark, tmp_path, monkeypatch):
    data = image(64, 64, 1)
    df = spark.createDataFrame([("a", 0, 0, 0, 64, 64, data[0].astype(float).ravel().tolist())], "path string, t int, c int, z int, h int, w int, data array<double>")
    zarr.write_zarr(df, str(tmp_path), dtype="uint16", chunk=8, codec="", version=3, shard=64)
    counted = []

    class Counting(zarr.Ranges):
        def __call__(self, at, n):
            counted.append(n)
            return super().__call__(at, n)

    monkeypatch.setattr(zarr, "Ranges", Counting)
    d = zarr.described(f"{tmp_path}/a.zarr")
    assert (zarr.read_chunk(d, [0, 0, 0, 3, 5])[0, 0, 0] == data[0, 24:32, 40:48]).all()
    assert counted == [64 * 16 + 4, 8 * 8 * 2]


def test_tiles_of_a_wide_store_need_no_whole_planes(spark, tmp_path):
    """20,000 x 20,000 of which few chunks are there: those wanted are read, and no task sees a plane."""
    folder = tmp_path / "wide.zarr"
    level = folder / "0"
    level.mkdir(parents=True)
    meta = {"zarr_format": 2, "shape": [1, 20000, 20000], "chunks": [1, 512, 512], "dtype": "<u2", "compressor": None, "fill_value": 0, "order": "C", "filters": None}
    (folder / ".zattrs").write_text(json.dumps({"multiscales": [{"axes": ["t", "y", "x"], "datasets": [{"path": "0"}]}]}))
    (level / ".zarray").write_text(json.dumps(meta))
    own = np.arange(512 * 512, dtype="<u2")
    (level / "0.38.39").write_bytes(own.tobytes())
    plan = zarr.chunk_plan(spark, [str(folder)])
    assert plan.count() == 40 * 40
    rows = zarr.load_tiles(plan.where("y0 >= 19000 AND x0 >= 19500")).collect()
    assert sorted((r["y0"], r["x0"], r["h"], r["w"]) for r in rows) == [(19456, 19968, 512, 32), (19968, 19968, 32, 32)]
    assert rows[0]["plane_h"] == 20000 and np.array(next(r for r in rows if r["y0"] == 19456)["data"]).reshape(512, 32).tolist() == own.reshape(512, 512)[:, :32].tolist()


# The data source


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("images")
    data = np.random.default_rng(1).integers(0, 255, (6, 9, 11))
    df = spark.createDataFrame([("movie", t, 0, 0, 9, 11, data[t].astype(float).ravel().tolist()) for t in range(6)], "path string, t int, c int, z int, h int, w int, data array<double>")
    sinks.write_images(df, f"{top}/tiff", dtype="uint8")
    np.save(top / "stack.npy", data.astype(np.uint16))
    zarr.write_zarr(df, f"{top}/deep/er", dtype="uint8", chunk=4)
    (top / "notes.txt").write_text("no image")
    datasource.register(spark)
    return str(top), data


def test_all_formats_by_one_name(spark, folder):
    top, data = folder
    rows = spark.read.format("voxelmill").option("axes", "TYX").load(top).collect()
    assert len(rows) == 18 and {r["path"].rsplit(".", 1)[1] for r in rows} == {"tif", "npy", "zarr"}
    assert all((np.array(r["data"]).reshape(9, 11) == data[r["t"]]).all() for r in rows)
    one = spark.read.format("voxelmill").option("axes", "TYX").load(f"{top}/stack.npy")
    assert one.where("t = 3").count() == 1 and one.where("t > 1 AND t <= 4 AND NOT (t = 3)").count() == 2 and one.where("t IN (0, 5) AND data[0] >= 0").count() == 2
    assert spark.read.format("voxelmill").load(f"{top}/deep/er/movie.zarr").where("t = 2 AND path LIKE '%movie%'").count() == 1


def test_filters_leave_files_and_planes_unread(folder, monkeypatch):
    top, data = folder
    spent = []

    class Counting(datasource.Ranges):
        def __call__(self, at, n):
            spent.append(n)
            return super().__call__(at, n)

    monkeypatch.setattr(datasource, "Ranges", Counting)
    from pyspark.sql import datasource as D

    reader = datasource.ImageReader({"path": top, "axes": "TYX", "split": "300"})
    left = list(reader.pushFilters([D.EqualTo(("t",), 3), D.StringEndsWith(("path",), ".npy"), D.EqualTo(("data",), 1)]))
    parts = reader.partitions()
    assert len(left) == 1 and len(parts) > 1 and {p.path.endswith("stack.npy") for p in parts} == {True}
    found = [b for p in parts for b in reader.read(p)]
    assert [b.column("t")[0].as_py() for b in found] == [3] and sorted(spent)[:1] == [9 * 11 * 2] and sum(n == 9 * 11 * 2 for n in spent) == 1


def test_damaged_files(spark, tmp_path):
    (tmp_path / "bad.tif").write_bytes(b"II*\0nothing")
    np.save(tmp_path / "good.npy", np.zeros((3, 4)))
    datasource.register(spark)
    read = spark.read.format("voxelmill")
    assert read.option("on_error", "skip").load(str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="."):
        spark.read.format("voxelmill").load(str(tmp_path)).collect()
    (tmp_path / "none").mkdir()
    assert spark.read.format("voxelmill").load(f"{tmp_path}/none").count() == 0
    assert arrays.SCHEMA.startswith("path")


def movie(spark, data, path="a.tif"):
    rows = [(path, t, c, z, *data.shape[3:], data[t, c, z].ravel().tolist()) for t, c, z in np.ndindex(*data.shape[:3])]
    return spark.createDataFrame(rows, "path string, t int, c int, z int, h int, w int, data array<double>")


@pytest.mark.parametrize("axes", ["tczyx", "zyx", "xzy", "yxz", "zcxyt"])
@pytest.mark.parametrize("how", [{"version": 2}, {"version": 3, "shard": 8}])
def test_axes_of_any_order(spark, tmp_path, axes, how):
    data = np.random.default_rng(3).integers(0, 900, (2 if "t" in axes else 1, 2 if "c" in axes else 1, 3, 9, 14)).astype(float)
    zarr.write_zarr(movie(spark, data), str(tmp_path), chunk=4, axes=axes, levels=2, scale={"z": 2.0, "x": 0.5}, **how)
    for level, step in ((0, 1), (1, 2)):
        d = zarr.described(f"{tmp_path}/a.zarr", level)
        assert d["axes"] == axes and d["scale"]["x"] == 0.5 * step and d["scale"]["z"] == 2.0
        got = zarr.read_zarr(spark, str(tmp_path), level).collect()
        assert len(got) == np.prod(data.shape[:3])
        for r in got:
            assert np.array_equal(np.reshape(r["data"], (r["h"], r["w"])), data[r["t"], r["c"], r["z"], ::step, ::step])
    with pytest.raises(Exception, match="lack"):
        zarr.write_zarr(movie(spark, data), f"{tmp_path}/other", axes="yx").collect()


def test_labels_have_the_axes_levels_and_scales_of_their_source(spark, tmp_path):
    data = np.random.default_rng(4).integers(0, 200, (2, 2, 3, 8, 8)).astype(float)
    for name, axes, levels in (("a.b", "tczyx", 3), ("c", "zcyxt", 1)):
        zarr.write_zarr(movie(spark, data, f"{name}.tif"), str(tmp_path), dtype="uint8", levels=levels, axes=axes, scale={"t": 5.0, "z": 3.0, "y": 0.5})
    images = [f"{tmp_path}/a.b.zarr", f"{tmp_path}/c.zarr"]
    sources = metadata.image_catalog(spark, images)
    assert [(r["axes"], r["dtype"], r["levels"]) for r in sources.orderBy("path").collect()] == [("tczyx", "uint8", 3), ("zcyxt", "uint8", 1)]
    projected = zarr.read_zarr(spark, str(tmp_path)).where("c = 0").withColumn("data", F.transform("data", lambda v: v * 300))
    for _ in range(2):  # the second time they are replaced
        done = metadata.write_labels_like(projected, sources, f"{tmp_path}/out", gone="c")
        assert sorted(r["image"] for r in done.collect()) == [f"{tmp_path}/out/a.b_labels.zarr", f"{tmp_path}/out/c_labels.zarr"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.b_labels.zarr", "c_labels.zarr"]
    got = {r["path"].rsplit("/", 1)[1][0]: r for r in metadata.image_catalog(spark, [r["image"] for r in done.collect()]).collect()}
    assert (got["a"]["axes"], got["a"]["levels"], got["a"]["dtype"]) == ("tzyx", 3, "uint32") and (got["c"]["axes"], got["c"]["levels"]) == ("zyxt", 1)
    assert got["a"]["scales"] == [{"t": 5.0, "z": 3.0, "y": 0.5 * k, "x": 1.0 * k} for k in (1, 2, 4)]
    assert {(r["t"], r["z"]): r["data"] for r in zarr.read_zarr(spark, f"{tmp_path}/out/a.b_labels.zarr").collect()} == {(t, z): (data[t, 0, z].ravel() * 300).tolist() for t in range(2) for z in range(3)}


def test_a_replaced_store_is_whole_at_every_step(spark, tmp_path, monkeypatch):
    """Whatever step of a swap a crash comes at, what is there afterwards is the old image or the new one."""
    folder, new = tmp_path / "a.zarr", tmp_path / "draft" / "a.zarr"
    real = store.place

    class Crash(Exception):
        pass

    for steps in range(5):
        for path, text in ((folder, "old"), (new, "new")):
            path.mkdir(parents=True, exist_ok=True)
            (path / "0").write_text(text)
        left = [steps]

        class Counted:
            def __init__(self, system):
                self.system = system

            def __getattr__(self, name):
                if name in ("move", "delete_dir"):
                    left[0] -= 1
                    if left[0] < 0:
                        raise Crash
                return getattr(self.system, name)

        monkeypatch.setattr(store, "place", lambda p: (Counted(real(p)[0]), real(p)[1]))
        with contextlib.suppress(Crash):
            store.swap(str(new), str(folder))
        monkeypatch.setattr(store, "place", real)
        states = [p for p in (folder, tmp_path / "a.zarr.old") if p.exists()]
        assert states and all((p / "0").read_text() in ("old", "new") for p in states)
        metadata.restore(str(tmp_path), ["a.zarr"])
        assert (folder / "0").read_text() == ("old" if steps < 2 else "new") and not (tmp_path / "a.zarr.old").exists()
        store.swap(str(new), str(folder))  # a task that runs again
        assert (folder / "0").read_text() == "new" and not new.exists()


def test_a_failed_job_leaves_stores_as_they_were(spark, tmp_path):
    data = np.ones((1, 1, 2, 4, 4))
    zarr.write_zarr(movie(spark, data), str(tmp_path))
    broken = movie(spark, 2 * data).withColumn("data", F.when(F.col("z") == 1, F.array(F.lit(1.0))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="reshape"):
        metadata.replace_zarr(broken, str(tmp_path))
    assert {tuple(r["data"]) for r in zarr.read_zarr(spark, str(tmp_path)).collect()} == {(1.0,) * 16} and [p.name for p in tmp_path.iterdir()] == ["a.zarr"]
    metadata.replace_zarr(movie(spark, 2 * data), str(tmp_path))
    assert {tuple(r["data"]) for r in zarr.read_zarr(spark, str(tmp_path)).collect()} == {(2.0,) * 16}


@pytest.mark.parametrize("version", [2, 3])
def test_patched_metadata(spark, tmp_path, version):
    zarr.write_zarr(movie(spark, np.ones((1, 2, 1, 8, 8))), str(tmp_path), levels=3, version=version, scale={"z": 4.0})
    patch = spark.createDataFrame([(f"{tmp_path}/a.zarr", {"y": 0.25}, [(0.0, 9.0, 1.0, 8.0)])], f"path string, scale map<string, double>, windows array<{metadata.WINDOW}>")
    for _ in range(2):
        assert metadata.patch_metadata(patch).first()["levels"] == 3
    r = metadata.image_catalog(spark, [f"{tmp_path}/a.zarr"]).first()
    assert [(s["z"], s["y"], s["x"]) for s in r["scales"]] == [(4.0, 0.25 * k, 1.0 * k) for k in (1, 2, 4)] and [tuple(w) for w in r["windows"]] == [(0.0, 9.0, 1.0, 8.0)]
    assert zarr.read_zarr(spark, str(tmp_path)).count() == 2


def test_chunks_of_a_small_plan_are_loaded_by_many_tasks(spark, tmp_path):
    """A plan's bytes are few, what its rows load aren't: partitions aren't merged."""
    planes = spark.range(40).select(F.lit("m").alias("path"), F.col("id").cast("int").alias("t"), F.lit(0).alias("c"), F.lit(0).alias("z"), F.lit(2).alias("h"), F.lit(2).alias("w"), F.array_repeat(F.col("id").cast("double"), 4).alias("data"))
    zarr.write_zarr(planes, str(tmp_path), dtype="uint8", chunk=2)
    tiles = zarr.load_tiles(zarr.chunk_plan(spark, zarr.images_in(str(tmp_path))))
    assert tiles.count() == 40 and tiles.select(F.spark_partition_id().alias("p")).distinct().count() == 4
