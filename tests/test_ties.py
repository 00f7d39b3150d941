"""Volumes that lack planes, variances that tie, wells of more than three digits: what queries differed from their SQL by on larger tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import stencils, thresholds
from voxelmill.sources import wells

#: An image whose two best thresholds part it equally well but for the last bits of sums.
TIED = [97, 122, 121, 127, 128, 112, 168, 68, 134, 92, 97, 185, 119, 95, 121, 156, 110, 94, 173, 136, 159, 102, 136, 153, 61, 128, 80, 126, 128, 170, 125, 106, 155, 97, 109, 147, 161, 108, 117, 74, 131, 151, 115, 156, 116, 140, 183, 132, 122, 95, 156, 118, 69, 86, 154, 84, 117, 113, 106, 107, 48, 144, 179, 195]


def test_variances_that_tie_take_the_first_threshold(spark):
    pixels = spark.createDataFrame([(1, float(v) ** 0.5) for v in TIED], "image_id int, v double")
    assert thresholds.otsu(pixels, digits=6).first()["threshold"] == pytest.approx(10.899716, abs=1e-6)


def stack(spark, planes: dict[int, np.ndarray]):
    return spark.createDataFrame([("s", z, *p.shape, p.ravel().tolist()) for z, p in planes.items()], "s string, z int, h int, w int, data array<double>")


def test_missing_planes_have_no_part_in_medians(spark):
    """By their SQL, planes that a cube of four lacks aren't mirrored."""
    planes = {z: np.random.default_rng(z).integers(0, 99, (5, 6)).astype(float) for z in (0, 1)}
    got = {r["z"]: np.array(r["data"]).reshape(5, 6) for r in stencils.median_volume(stack(spark, planes), ["s"], 3, depth=4).collect()}
    assert sorted(got) == [0, 1]
    fold = lambda k, n: min(max(k, 0), n - 1)
    for z, y, x in np.ndindex(2, 5, 6):
        near = [planes[fold(z + a, 4)][fold(y + b, 5), fold(x + c, 6)] for a, b, c in np.ndindex(3, 3, 3) for a, b, c in [(a - 1, b - 1, c - 1)] if fold(z + a, 4) in planes]
        assert got[z][y, x] == np.median(near)


def test_missing_planes_are_zeros_to_a_gaussian(spark):
    planes = {z: np.full((4, 4), 10.0 + z) for z in (0, 1, 3)}
    full = planes | {2: np.zeros((4, 4))}
    blurred = lambda p, **how: {r["z"]: r["data"] for r in stencils.gaussian_blur(stack(spark, p), 0.7, ["s"], **how).collect()}
    want, got = blurred(full), blurred(planes, depth=4)
    assert sorted(got) == [0, 1, 3] and all(got[z] == pytest.approx(want[z]) for z in got)


def test_gaussian_volume_takes_whole_cubes(spark, tmp_path, sf_dir):
    """Of six planes the last two are no cube, as the query's SQL says."""
    from voxelmill.plans.queries import QUERIES

    spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 6").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = QUERIES["gaussian_volume"](spark, str(tmp_path))
    assert found.select("scene", "z").distinct().count() == 4 and found.where("scene = 1").isEmpty()


def test_wells_go_by_their_numbers(spark):
    paths = [f"/d/-{w}--PO01--LO001--CO1--SL010--PX32500--IN0020.tif" for w in ("B1000", "B999", "B2", "A10", "AA1")]
    plan = spark.createDataFrame([(p,) for p in paths], "path string").withColumns({a: F.lit(0) for a in "tcz"})
    assert [r["well"] for r in wells.well_plan(plan).orderBy("series").collect()] == ["A10", "B2", "B999", "B1000", "AA1"]
