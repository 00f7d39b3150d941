"""Labels by tiles and by blocks against whole images."""

import itertools

import numpy as np
import pytest

from voxelmill.functions.tiles import label_array, roots
from voxelmill.operators import components, stitching

AXES = "wzyx"


def flood(m, full=True):
    """The first pixel of the component of each nonzero pixel, pixel by pixel."""
    seen, out = np.zeros(m.shape, bool), np.full(m.shape, -1)
    for start in np.ndindex(*m.shape):
        if m[start] and not seen[start]:
            stack = [start]
            seen[start] = True
            while stack:
                p = stack.pop()
                out[p] = np.ravel_multi_index(start, m.shape)
                for o in itertools.product((-1, 0, 1), repeat=m.ndim):
                    q = tuple(np.add(p, o))
                    if (full or sum(map(abs, o)) == 1) and all(0 <= a < n for a, n in zip(q, m.shape, strict=True)) and not seen[q] and m[q] == m[p]:
                        seen[q] = True
                        stack.append(q)
    return out


def noise(shape, share=0.4, values=2, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.random(shape) < share) * rng.integers(1, values + 1, shape)


def pixels(spark, *images, value="v"):
    axes = list(AXES[-images[0].ndim :])
    rows = [(k, *map(int, p), int(m[p])) for k, m in enumerate(images) for p in np.ndindex(*m.shape)]
    return spark.createDataFrame(rows, f"image_id int, {', '.join(a + ' int' for a in axes)}, {value} int"), axes


@pytest.mark.parametrize("shape", [(50,), (20, 23), (6, 7, 8), (4, 5, 4, 5)])
@pytest.mark.parametrize("full", [True, False])
def test_arrays_match_flood(shape, full):
    m = noise(shape)
    want, got = flood(m, full), label_array(m, full)
    firsts = np.unique(want[want >= 0])
    assert (got == np.where(want >= 0, np.searchsorted(firsts, want) + 1, 0)).all()
    assert not label_array(np.zeros(shape)).any() and (label_array(np.full(shape, 2.5)) == 1).all()


def test_roots_of_a_long_path():
    n = 5000
    order = np.random.default_rng(0).permutation(n)
    assert (roots(n, order[:-1], order[1:]) == 0).all() and roots(3, np.zeros(0, int), np.zeros(0, int)).tolist() == [0, 1, 2]


@pytest.mark.parametrize(("shape", "side", "full", "few"), [((20, 23), 4, True, 1 << 16), ((20, 23), 5, False, 0), ((6, 7, 8), 3, True, 0), ((6, 7, 8), 2, False, 1 << 16), ((40,), 7, True, 1 << 16)])
def test_components_don_t_depend_on_tiles(spark, monkeypatch, shape, side, full, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    images = [noise(shape, 0.45, 2, s) for s in (1, 2)]
    df, axes = pixels(spark, *images)
    want = {}
    for k, m in enumerate(images):
        first = flood(m, full)
        want |= {(k, *map(int, p)): tuple(map(int, np.unravel_index(first[tuple(p)], shape))) for p in np.argwhere(m)}
    got = {(r["image_id"], *(r[a] for a in axes)): tuple(r["first"]) for r in components.components(df, ["image_id"], axes, full=full, side=side).collect()}
    assert got == want


def test_a_snake_over_many_tiles_is_one(spark):
    m = np.zeros((64, 64), int)
    m[::2] = 1
    m[1::4, -1] = m[3::4, 0] = 1
    df, axes = pixels(spark, m)
    assert components.binary_to_labels(df, axes=axes).select("label").distinct().count() == 1
    found = components.components(df, ["image_id"], axes, side=8)
    assert {tuple(r["first"]) for r in found.select("first").distinct().collect()} == {(0, 0)} and found.count() == int(m.sum())


def test_large_planes_in_tiles(spark):
    """1024 x 1024 of random blobs in 16 tiles: what one tile gives."""
    rng = np.random.default_rng(4)
    coarse = np.kron((rng.random((128, 128)) < 0.42), np.ones((8, 8), int))
    p = spark.range(1024 * 1024).selectExpr("0 AS image_id", "CAST(id DIV 1024 AS INT) AS y", "CAST(id % 1024 AS INT) AS x")
    at = np.flatnonzero(coarse)
    there = spark.createDataFrame(__import__("pandas").DataFrame({"id": at})).selectExpr("CAST(id DIV 1024 AS INT) AS y", "CAST(id % 1024 AS INT) AS x", "1 AS v")
    got = components.binary_to_labels(p.join(there, ["y", "x"])).toPandas()
    out = np.zeros((1024, 1024), int)
    out[got["y"], got["x"]] = got["label"]
    assert (out == label_array(coarse)).all()


def test_values_of_other_types(spark):
    df = spark.createDataFrame([(1, 0, 0, True), (1, 0, 1, True), (1, 2, 0, True), (1, 0, 3, False), (1, 1, 3, None)], "image_id int, y long, x short, v boolean")
    got = {(r["y"], r["x"]): r["label"] for r in components.binary_to_labels(df.withColumn("v", df.v.cast("double"))).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (2, 0): 2}
    assert components.binary_to_labels(df.withColumn("v", df.v.cast("int")).where("false")).collect() == []


# Blocks


def as_array(df, shape, axes):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[tuple(r[a] for a in axes)] = r["label"]
    return out


def test_blocks_cover_lengths():
    counts = [(100, 40, 10, 3), (100, 60, 60, 41), (100, 40, 60, 61), (30, 40, 10, 1), (40, 40, 0, 1), (41, 40, 0, 2)]
    assert [stitching.block_count(n, s, o) for n, s, o, _ in counts] == [c for *_, c in counts]
    with pytest.raises(ValueError):
        stitching.block_count(10, 0, 0)
    with pytest.raises(ValueError):
        stitching.stride_of(5, -1)


@pytest.mark.parametrize(("shape", "size", "overlap"), [((30, 33), 12, 4), ((30, 33), 9, 6), ((9, 10, 11), 5, 2), ((16, 16), 32, 8)])
def test_stitched_components_are_those_of_the_whole(spark, shape, size, overlap):
    m = noise(shape, 0.4, 1, 5)
    df, axes = pixels(spark, m)
    got = as_array(stitching.segment_stitched(df, ["image_id"], axes, label_array, size, overlap, share=0.0), shape, axes)
    assert (got == label_array(m)).all()


def discs(side, centres, r):
    y, x = np.indices((side, side))
    out = np.zeros((side, side), int)
    for k, (a, b) in enumerate(centres, 1):
        out[(y - a) ** 2 + (x - b) ** 2 <= r * r] = k
    return out


def test_objects_that_touch_stay_apart_and_cut_ones_are_joined(spark):
    """A model that tells touching discs apart: whole discs again, though blocks cut them and number them anew."""
    truth = discs(60, [(10, 10), (10, 21), (21, 10), (32, 30), (32, 41), (50, 22), (50, 50)], 5)
    df, axes = pixels(spark, truth)

    def model(box):
        ids = np.unique(box[box > 0])
        return np.where(box > 0, np.searchsorted(ids, box) * 7 + 1, 0)

    got = as_array(stitching.segment_stitched(df, ["image_id"], axes, model, 26, 12), truth.shape, axes)
    pairs = {(a, b) for a, b in zip(truth.ravel().tolist(), got.ravel().tolist(), strict=True)}
    assert len(pairs) == 8 and ((truth > 0) == (got > 0)).all()


def test_a_sliver_in_the_band_joins_nothing_by_share(spark):
    """Two blocks that disagree on where one of two neighbours ends: the few pixels shared don't make them one."""
    rows = [(0, 0, 0, 0, x, 1) for x in range(2, 14)] + [(0, 0, 1, 0, x, 1) for x in range(13, 22)] + [(0, 0, 1, 0, x, 2) for x in range(8, 13)]
    found = spark.createDataFrame(rows, "image_id int, by long, bx long, y int, x int, label long")
    shape = {"y": 1, "x": 24}
    apart = stitching.stitch_blocks(found, ["image_id"], shape, 16, 8, 0.5)
    assert apart.select("label").distinct().count() == 2
    assert stitching.stitch_blocks(found, ["image_id"], shape, 16, 8, 0.1).select("label").distinct().count() == 1


def test_masks_leave_blocks_out(spark):
    m = np.zeros((40, 40), int)
    m[2:5, 2:5] = m[30:33, 30:33] = m[2:5, 18:22] = 1
    df, axes = pixels(spark, m)
    mask = df.where("y < 8 AND x < 8 AND v = 1")
    args = (df, ["image_id"], axes, label_array, 10, 2)
    alone = stitching.segment_stitched(*args, mask=mask, margin=0)
    assert alone.count() == 9 and stitching.segment_stitched(*args, mask=mask, margin=2).count() == 9 + 12 and stitching.segment_stitched(*args).count() == 9 + 12 + 9
    shape = {"y": 40, "x": 40}
    assert stitching.active_blocks(mask, ["image_id"], shape, 10, 2, margin=1).count() == 4


def test_a_model_must_keep_shapes(spark):
    df, axes = pixels(spark, np.ones((4, 4), int))
    with pytest.raises(Exception, match="the model made"):
        stitching.segment_stitched(df, ["image_id"], axes, lambda b: b[:1]).collect()
