"""Registered operators over folders, and table functions."""

import numpy as np
import pytest

from voxelmill.functions import tables
from voxelmill.operators import labels as L  # noqa: F401
from voxelmill.plans import batch, registry
from voxelmill.plans import queries as Q  # noqa: F401  # all operators
from voxelmill.sources import arrays


def save(folder, **images):
    folder.mkdir(exist_ok=True)
    for name, image in images.items():
        np.save(folder / f"{name}.npy", image)


def written(spark, folder):
    out = {}
    for r in arrays.read_planes(spark, str(folder)).collect():
        out.setdefault(r["path"].rsplit("/", 1)[1], {})[r["t"], r["c"], r["z"]] = np.array(r["data"]).reshape(r["h"], r["w"])
    return out


def test_labels_of_several_sizes(spark, tmp_path):
    """Images keep their sizes, and planes without labels are there."""
    a, b = np.zeros((2, 3, 4), np.uint16), np.array([[5, 5], [6, 0]], np.uint16)
    a[0, 1] = [0, 7, 7, 7]
    save(tmp_path / "in", a=a, b=b)
    done = batch.process(spark, str(tmp_path / "in"), str(tmp_path / "out"), "Remove Small Labels", min_size=1).collect()
    assert sorted((r["source"].rsplit("/", 1)[1], r["image"].rsplit("/", 1)[1], r["planes"]) for r in done) == [("a.npy", "a_rm_small.tif", 2), ("b.npy", "b_rm_small.tif", 1)]
    got = written(spark, tmp_path / "out")
    assert (np.stack([got["a_rm_small.tif"][0, 0, z] for z in (0, 1)]) == a).all() and got["b_rm_small.tif"][0, 0, 0].tolist() == [[5, 5], [0, 0]]


def test_planes_and_parameters(spark, tmp_path):
    save(tmp_path / "in", a=np.arange(20, dtype=np.uint8).reshape(4, 5))
    batch.process(spark, str(tmp_path / "in"), str(tmp_path / "out"), "Median Filter", form="npy", dtype="uint8", size=1)
    assert (written(spark, tmp_path / "out")["a_median.npy"][0, 0, 0] == np.arange(20).reshape(4, 5)).all()
    with pytest.raises(TypeError, match="no parameters"):
        batch.process(spark, str(tmp_path / "in"), str(tmp_path / "out"), "Median Filter", sigma=1)


def test_operators_on_plans(spark, tmp_path):
    """Channels are merged and split without pixels as rows; files that an operator doesn't want aren't read."""
    one, two = np.arange(6, dtype=np.uint16).reshape(2, 3), np.arange(6, 12, dtype=np.uint16).reshape(2, 3)
    save(tmp_path / "in", s_channel_1=one, s_channel_3=two)
    (tmp_path / "in" / "other.npy").write_bytes(b"can't be read")
    with pytest.raises(Exception, match="magic|npy|file"):
        arrays.load_planes(arrays.plane_plan(spark, str(tmp_path / "in"))).count()
    done = batch.process(spark, str(tmp_path / "in"), str(tmp_path / "out"), "Merge Color Channels", on_error="skip").collect()
    assert [(r["source"].rsplit("/", 1)[1], r["planes"]) for r in done] == [("s_channel_1.npy", 2)]
    (got,) = written(spark, tmp_path / "out").values()
    assert (got[0, 0, 0] == one).all() and (got[0, 1, 0] == two).all()
    done = batch.process(spark, str(tmp_path / "out"), str(tmp_path / "split"), "Split Color Channels")
    assert done.select("source").distinct().count() == 1
    assert {k: v[0, 0, 0].tolist() for k, v in written(spark, tmp_path / "split").items()} == {
        "s_channel_1_merged_colors_channel_0_split.tif": one.tolist(), "s_channel_1_merged_colors_channel_1_split.tif": two.tolist(),
    }


def test_tables_paths_and_none(spark, tmp_path):
    save(tmp_path / "in", a=np.array([[1, 1], [0, 2]], np.uint8), b=np.zeros((2, 2), np.uint8))
    done = batch.process(spark, str(tmp_path / "in"), str(tmp_path / "out"), "Extract Regionprops to CSV", value=None, mean=False, median=False, std=False)
    (row,) = done.collect()
    assert row["source"].endswith("a.npy") and spark.read.parquet(row["image"]).select("size").orderBy("size").collect() == [(1,), (2,)]
    assert [r["path"].rsplit("/", 1)[1] for r in batch.left(spark, str(tmp_path / "in"), done).collect()] == ["b.npy"]

    seen = []

    @registry.register("Path Only", "_p", kind="path")
    def path_only(planes):
        return planes.selectExpr("concat(path, '.done') AS image")

    @registry.register("Nothing", "_n", kind="none")
    def nothing(planes):
        seen.append(planes.count())

    try:
        assert batch.process(spark, str(tmp_path / "in"), "", "Path Only").count() == 2
        assert batch.process(spark, str(tmp_path / "in"), "", "Nothing").count() == 0 and seen == [2]
    finally:
        del registry.REGISTRY["Path Only"], registry.REGISTRY["Nothing"]
    with pytest.raises(ValueError, match="no kind"):
        registry.register("x", "_x", kind="layer")


def test_plane_objects(spark):
    tables.register(spark)
    rows = [(0, 2, 3, [1.0, 0.0, 2.0, 1.0, 0.0, 2.0]), (1, 1, 2, [0.0, 0.0]), (2, None, 2, None)]
    spark.createDataFrame(rows, "k int, h int, w int, data array<double>").createOrReplaceTempView("some_planes")
    got = spark.sql("SELECT k, o.* FROM some_planes, LATERAL plane_objects(h, w, data) o ORDER BY k, label").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1.0, 2, 0, 0, 2, 1, 0.5, 0.0), (0, 2, 2.0, 2, 0, 2, 2, 3, 0.5, 2.0)]
