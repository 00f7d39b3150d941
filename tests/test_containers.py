"""CZI files, equalised volumes, and movies that arrive frame by frame."""

import io
import itertools
import time

import numpy as np
import pytest

from voxelmill.operators.contrast import clahe_volume
from voxelmill.operators.enhance import clahe
from voxelmill.sources import czi, sinks
from voxelmill.streaming.movies import complete_movies

# CZI


def scenes(rng, shape=(21, 33), n=2, frames=2):
    return {(s, t, z): rng.integers(0, 60000, shape) for s in range(n) for t in range(frames) for z in range(2)}


def planes_of(df):
    return {(r["scene"], r["t"], r["c"], r["z"]): np.array(r["data"]).reshape(r["h"], r["w"]) for r in df.collect()}


@pytest.mark.parametrize(("compression", "dtype"), [(czi.PLAIN, "uint16"), (czi.ZSTD, "uint16"), (czi.ZSTD_BYTES, "uint16"), (czi.ZSTD_BYTES, "uint8"), (czi.PLAIN, "float32")])
def test_scenes_of_mosaics(spark, tmp_path, compression, dtype):
    data = scenes(np.random.default_rng(1))
    if dtype == "uint8":
        data = {k: v % 256 for k, v in data.items()}
    rows = [("slide", s, t, 0, z, *v.shape, v.astype(float).ravel().tolist()) for (s, t, z), v in data.items()]
    df = spark.createDataFrame(rows, "path string, scene int, t int, c int, z int, h int, w int, data array<double>")
    assert czi.write_czi(df, str(tmp_path), dtype=dtype, tile=8, compression=compression, level=True).first()["tiles"] == 8 * 15 * 2
    got = planes_of(czi.read_czi(spark, str(tmp_path)))
    assert set(got) == {(s, t, 0, z) for s, t, z in data} and all((got[s, t, 0, z] == v).all() for (s, t, z), v in data.items())
    plan = czi.czi_plan(spark, str(tmp_path))
    half = planes_of(czi.load_czi(plan.where("factor = 2 AND scene = 1 AND t = 0")))
    assert set(half) == {(1, 0, 0, 0), (1, 0, 0, 1)} and all((half[1, 0, 0, z] == data[1, 0, z][::2, ::2]).all() for z in range(2))
    assert plan.where("factor = 1").select("plane_h", "plane_w").distinct().collect() == [(21, 33)]


def test_samples_overlaps_and_metadata(spark, tmp_path):
    rng = np.random.default_rng(2)
    low, high = rng.integers(0, 255, (4, 6, 3), np.uint8), rng.integers(0, 255, (4, 6, 3), np.uint8)
    xml = '<ImageDocument><Metadata><Scaling><Items><Distance Id="X"><Value>5e-07</Value></Distance></Items></Scaling></Metadata></ImageDocument>'
    out = io.BytesIO()
    blocks = [({"X": (-4, 6, 6), "Y": (7, 4, 4), "C": (0, 1, 1), "M": (0, 1, 1)}, low), ({"X": (0, 6, 6), "Y": (7, 4, 4), "C": (0, 1, 1), "M": (1, 1, 1)}, high)]
    assert czi.write_blocks(out, iter(blocks), czi.ZSTD, xml) == 2
    (tmp_path / "a.czi").write_bytes(out.getvalue())
    got = planes_of(czi.read_czi(spark, str(tmp_path)))
    want = np.concatenate([low[:, :4], high], axis=1)  # the second of the mosaic is on top
    assert set(got) == {(0, 0, c, 0) for c in range(3)} and all((got[0, 0, c, 0] == want[:, :, 2 - c]).all() for c in range(3))
    text = czi.metadata_xml(lambda at, n: out.getvalue()[at : at + n])
    assert sinks.czi_scales(spark.createDataFrame([(text,)], "xml string")).first()["scale_x"] == pytest.approx(0.5)


def test_single_tiles_are_read_alone(spark, tmp_path):
    data = np.arange(64 * 64, dtype=np.uint16).reshape(64, 64)
    out = io.BytesIO()
    czi.write_blocks(out, iter([({"X": (x, 16, 16), "Y": (y, 16, 16), "M": (m, 1, 1)}, data[y : y + 16, x : x + 16]) for m, (y, x) in enumerate(itertools.product(range(0, 64, 16), repeat=2))]), czi.PLAIN)
    spent = []

    def read(at, n):
        spent.append(n)
        return out.getvalue()[at : at + n]

    row = [r for r in czi.tile_rows("p", read) if r["m"] == 6][0]
    assert sum(spent) < 2000
    spent.clear()
    import json

    assert (czi.read_tile(read, json.loads(row["spec"]), 16, 16) == data[16:32, 32:48]).all() and sum(spent) == 16 * 16 * 2 + 16 + 32


def test_files_that_arent_read(spark, tmp_path):
    (tmp_path / "bad.czi").write_bytes(b"no such file")
    out = io.BytesIO()
    czi.write_blocks(out, iter([({"X": (0, 2, 2), "Y": (0, 2, 2)}, np.ones((2, 2), np.uint8))]))
    (tmp_path / "good.czi").write_bytes(out.getvalue())
    assert czi.read_czi(spark, str(tmp_path), "skip").count() == 1
    with pytest.raises(Exception, match="ZISRAWFILE"):
        czi.read_czi(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="compression 4"):
        czi.unpacked(b"", 4)


# Equalised volumes


def plain_clahe(v, k, clip, top=255, bins=256):
    """Pixel by pixel, from the histograms of the tiles around it."""
    low, high = v.min(), v.max()
    level = np.floor((v - low) / (high - low) * (bins - 1)).astype(int) if high > low else np.zeros(v.shape, int)
    count = [-(-n // k) for n in v.shape]
    lut = {}
    for tile in itertools.product(*map(range, count)):
        own = level[tuple(slice(t * k, (t + 1) * k) for t in tile)].ravel()
        hist = np.bincount(own, minlength=bins)
        limit = max(1.0, clip * len(own))
        lut[tile] = (np.cumsum(np.minimum(hist, limit)) + np.arange(1, bins + 1) * np.maximum(hist - limit, 0).sum() / bins) / len(own)
    out = np.zeros(v.shape)
    for p in np.ndindex(*v.shape):
        f = [min(max((a - (k - 1) / 2) / k, 0), n - 1) for a, n in zip(p, count, strict=True)]
        for corner in itertools.product((0, 1), repeat=v.ndim):
            weight = np.prod([x - int(x) if up else 1 - (x - int(x)) for x, up in zip(f, corner, strict=True)])
            out[p] += weight * lut[tuple(min(int(x) + up, n - 1) for x, up, n in zip(f, corner, count, strict=True))][level[p]]
    return np.floor(np.minimum(1, out) * top + 1e-9).astype(int)


@pytest.mark.parametrize(("shape", "k", "clip"), [((4, 8, 8), 3, 0.2), ((7, 9, 10), 3, 0.05), ((3, 20, 21), 5, 0.1), ((2, 6, 6), 7, 0.01)])
def test_volumes_by_brute_force(spark, shape, k, clip):
    rng = np.random.default_rng(3)
    volumes = [rng.integers(0, 200, shape), np.full(shape, 7), rng.integers(0, 4, shape) * 50]
    rows = [(n, *map(int, p), int(v[p])) for n, v in enumerate(volumes) for p in np.ndindex(*shape)]
    df = spark.createDataFrame(rows, "image_id int, z int, y int, x int, v int")
    got = [np.zeros(shape, int) for _ in volumes]
    for r in clahe_volume(df, dict(zip("zyx", shape, strict=True)), clip_limit=clip, kernel_size=k).collect():
        got[r["image_id"]][r["z"], r["y"], r["x"]] = r["v"]
    assert all((g == plain_clahe(v, k, clip)).all() for g, v in zip(got, volumes, strict=True))


def test_planes_by_tables_are_planes_by_kernel(spark):
    v = np.random.default_rng(4).integers(0, 255, (40, 50))
    df = spark.createDataFrame([(0, *map(int, p), int(v[p])) for p in np.ndindex(*v.shape)], "image_id int, y int, x int, v int")
    one, two = clahe(df, 40, 50, kernel_size=9, clip_limit=0.03), clahe_volume(df, {"y": 40, "x": 50}, kernel_size=9, clip_limit=0.03)
    assert {(r["y"], r["x"]): r["v"] for r in one.collect()} == {(r["y"], r["x"]): r["v"] for r in two.collect()}


# Movies


def frames(spark, folder, rows):
    spark.createDataFrame(rows, "movie string, t int, frames int, path string").coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, source, out, checkpoint, patience=0):
    stream = spark.readStream.schema("movie string, t int, frames int, path string").option("maxFilesPerTrigger", 1).parquet(str(source))
    return complete_movies(stream, patience).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append")


def test_each_movie_once_in_any_order_and_over_restarts(spark, tmp_path):
    rng = np.random.default_rng(5)
    every = [(f"m{m}", t, 6 + m, f"m{m}/{t}.tif") for m in range(5) for t in range(6 + m)]
    every = [every[k] for k in rng.permutation(len(every))]
    late = [r for r in every if r[0] == "m4"][:2]
    every = [r for r in every if r not in late]
    thirds = [every[k::3] for k in range(3)]
    src, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    for part in thirds[:2]:
        frames(spark, src, [*part, part[0]])
    run(spark, src, out, check).trigger(availableNow=True).start().awaitTermination()
    early = [m for m in range(5) if {r for r in thirds[0] + thirds[1] if r[0] == f"m{m}"} == {(f"m{m}", t, 6 + m, f"m{m}/{t}.tif") for t in range(6 + m)}]
    assert sorted(r["movie"] for r in spark.read.schema("movie string").parquet(str(out)).collect()) == [f"m{m}" for m in early]
    frames(spark, src, [*thirds[2], *thirds[0][:3], (None, 0, 1, "x"), ("m0", 99, 6, "beyond"), ("m9", 0, 1, "alone")])
    run(spark, src, out, check).trigger(availableNow=True).start().awaitTermination()
    got = {r["movie"]: r for r in spark.read.parquet(str(out)).collect()}
    assert set(got) == {"m0", "m1", "m2", "m3", "m9"} and spark.read.parquet(str(out)).count() == 5
    assert all(got[f"m{m}"]["paths"] == [f"m{m}/{t}.tif" for t in range(6 + m)] and got[f"m{m}"]["complete"] and got[f"m{m}"]["missing"] == [] for m in range(4))
    frames(spark, src, [*late, *thirds[0][:5]])  # frames of movies that were given on change nothing
    run(spark, src, out, check).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["movie"] for r in spark.read.parquet(str(out)).collect()) == ["m0", "m1", "m2", "m3", "m4", "m9"]


def test_patience_ends(spark, tmp_path):
    src, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    frames(spark, src, [("a", 0, 3, "a0"), ("a", 2, 3, "a2")])
    query = run(spark, src, out, check, patience=500).trigger(processingTime="200 milliseconds").start()
    try:
        until, rows = time.time() + 90, {}
        while time.time() < until and "a" not in rows:
            time.sleep(0.5)
            frames(spark, src, [("b", 0, 2, "b0")])  # batches go on
            if list(out.glob("_spark_metadata/*")):
                rows = {r["movie"]: r for r in spark.read.schema("movie string, frames int, complete boolean, missing array<int>, paths array<string>").parquet(str(out)).collect()}
    finally:
        query.stop()
    assert not rows["a"]["complete"] and rows["a"]["missing"] == [1] and rows["a"]["paths"] == ["a0", "a2"]


def test_frames_of_a_batch(spark):
    """The same on a table at once, as one batch: the operator needs a stream, its rule doesn't."""
    from voxelmill.streaming.movies import assemble

    class State:
        exists, hasTimedOut, kept = False, False, None  # noqa: N815

        def update(self, new):
            self.kept = new

    import pandas as pd

    rows = pd.DataFrame({"t": [1, 0, 1], "frames": [2, 2, 2], "path": ["b", "a", "a1"]})
    (one,) = assemble(("m",), iter([rows]), State(), 0)
    assert one.iloc[0]["paths"] == ["a", "a1"] and one.iloc[0]["complete"]
