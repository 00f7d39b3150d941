"""Operators on small arrays with known results, and against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.functions import graph
from voxelmill.operators import components, editing, enhance, inspection, labels, models, pixelmaps, regions, slices, stacks, stencils, stitching, thresholds, tracking
from voxelmill.plans import catalog, registry


def frame(spark, array, name="label", image=0):
    """A dense array as rows of image_id, coordinates and a value."""
    axes = ["z", "y", "x"][-array.ndim :]
    rows = [(image, *map(int, p), float(array[p]) if array.dtype.kind == "f" else int(array[p])) for p in np.ndindex(*array.shape)]
    kind = "double" if array.dtype.kind == "f" else "long"
    return spark.createDataFrame(rows, "image_id long, " + ", ".join(f"{a} int" for a in axes) + f", {name} {kind}")


def array(df, shape, name="label"):
    out = np.zeros(shape)
    axes = ["z", "y", "x"][-len(shape) :]
    for r in df.collect():
        out[tuple(r[a] for a in axes)] = r[name]
    return out


def planes(spark, *arrays):
    return spark.createDataFrame([(k, *a.shape, a.ravel().astype(float).tolist()) for k, a in enumerate(arrays)], "image_id int, h int, w int, data array<double>")


def matrices(df):
    return [np.array(r["data"]).reshape(r["h"], r["w"]) for r in df.orderBy("image_id").collect()]


def blobs(seed, shape, n=5):
    rng = np.random.default_rng(seed)
    return np.where(rng.random(shape) < 0.6, rng.integers(1, n + 1, shape), 0)


def test_two_squares(spark):
    a = np.zeros((100, 100), int)
    a[20:40, 20:40], a[60:80, 60:80] = 1, 2
    got = regions.regionprops(frame(spark, a), value=None, extent=True).orderBy("label").collect()
    assert [(r["label"], r["size"], r["centroid_y"], r["bbox_min_x"], r["bbox_max_x"], r["extent"]) for r in got] == [(1, 400, 29.5, 20, 40, 1.0), (2, 400, 69.5, 60, 80, 1.0)]


def test_volume_regions(spark):
    a = np.zeros((10, 30, 30), int)
    a[2:5, 2:12, 2:12], a[5:8, 15:25, 15:25] = 1, 2
    got = regions.regionprops(frame(spark, a), axes=["z", "y", "x"], value=None).orderBy("label").collect()
    assert [(r["size"], r["bbox_min_z"], r["bbox_max_z"]) for r in got] == [(300, 2, 5), (300, 5, 8)]


def test_summary_deviation_of_samples(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (10, 20, 30, 40, 50)] + [("b", 1.0)], "f string, size double")
    got = {r["f"]: r for r in regions.regionprops_summary(df, ["f"], ["size"]).collect()}
    assert (got["a"]["size_sum"], got["a"]["size_mean"], got["a"]["size_median"]) == (150, 30, 30) and np.isclose(got["a"]["size_std"], np.std([10, 20, 30, 40, 50], ddof=1))
    assert got["b"]["size_std"] is None


def test_ellipse_of_a_line(spark):
    a = np.zeros((5, 12), int)
    a[2, 1:11] = 1
    r = regions.regionprops(frame(spark, a), value=None, moments=True).first()
    assert np.isclose(r["major_axis"], 4 * np.sqrt(np.var(range(10)) + 1 / 12)) and np.isclose(r["minor_axis"], 4 * np.sqrt(1 / 12)) and np.isclose(abs(r["orientation"]), np.pi / 2)


def test_solidity_and_perimeter(spark):
    a = np.zeros((12, 12), int)
    a[1:6, 1:6] = 1
    a[7:11, 2:10] = 2
    a[7:9, 4:8] = 0
    got = {r["label"]: r for r in regions.solidity(frame(spark, a), ["image_id"]).collect()}
    assert got[1]["solidity"] == 1.0 and got[2]["area"] == 24 and got[2]["convex_area"] > 24
    assert {r["label"]: r["perimeter"] for r in regions.perimeter(frame(spark, a), ["image_id"]).collect()}[1] == 16


def test_label_means_and_medoids(spark):
    a = np.array([[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, 0, 0], [3, 3, 0, 0]])
    df = frame(spark, a).withColumn("v", F.when(F.col("label") == 1, 10.0).when(F.col("label") == 2, 50.0).otherwise(100.0))
    assert {r["label"]: r["mean"] for r in labels.label_means(df, ["image_id"]).collect()} == {1: 10, 2: 50, 3: 100}
    m = lambda v, k: labels.medoids_of(*np.unique(np.array(v, float), return_counts=True), k)
    two, three = m([10, 15, 20, 80, 85, 90], 2), m([10, 15, 50, 55, 90, 95], 3)
    assert 20 < two.mean() < 80 and two.tolist() == [15, 85] and len(three) == 3 and m([5, 5, 7], 3).tolist() == [5, 7]
    for seed in range(30):
        v = np.random.default_rng(seed).integers(0, 50, 40)
        u, n = np.unique(v.astype(float), return_counts=True)
        assert set(labels.medoids_of(u, n, 3)) <= set(u)
    with pytest.raises(ValueError, match="same"):
        labels.intensity_label_filter(df.withColumn("v", F.lit(42.0)), strict=True)


def test_weighted_medians_of_clusters():
    def plain(values, k):
        u, n = np.unique(values, return_counts=True)
        now = u[np.unique(np.round(np.linspace(0, len(u) - 1, k)).astype(int))]
        while True:
            own = [[x for x in values if np.abs(now - x).argmin() == j] for j in range(len(now))]
            new = np.unique([sorted(c)[-(-len(c) // 2) - 1] for c in own])
            if np.array_equal(new, now):
                return now
            now = new

    for seed in range(20):
        v = np.random.default_rng(seed).normal(0, 1, 31)
        assert np.allclose(labels.medoids_of(*np.unique(v, return_counts=True), 2), plain(v, 2))


@pytest.mark.parametrize(("a", "least", "want"), [("corner", 10, 1), ("alone", 5, 0), ("between", 8, 1)])
def test_merge_small(spark, a, least, want):
    m = np.zeros((10, 10), int)
    if a == "corner":
        m[:8, :8], m[8:, :2] = 1, 2
        at = (9, 0)
    elif a == "alone":
        m[:8, :8], m[9, 9] = 1, 2
        at = (9, 9)
    else:
        m = np.full((7, 10), 1)
        m[:, 5], m[:, 6:] = 3, 2
        at = (3, 5)
    out = array(labels.merge_small_labels(frame(spark, m), min_size=least), m.shape)
    assert out[at] == want


def test_merge_small_in_volumes(spark):
    m = np.zeros((10, 10, 10), int)
    m[:8, :8, :8], m[8:, :2, :2] = 1, 2
    out = array(labels.merge_small_labels(frame(spark, m), axes=["z", "y", "x"], min_size=20), m.shape)
    assert set(np.unique(out)) == {0, 1} and out[9, 0, 0] == 1


@pytest.mark.parametrize("least", [1, 5, 200])
def test_remove_small(spark, least):
    m = blobs(3, (20, 20), 7)
    ids, n = np.unique(m, return_counts=True)
    kept = [i for i, k in zip(ids, n, strict=True) if i and k > least]
    assert (array(labels.remove_small_labels(frame(spark, m), min_size=least), m.shape) == np.where(np.isin(m, kept), m, 0)).all()


def test_mirror(spark):
    m = np.zeros((4, 2, 2), int)
    m[0, 0, 0], m[1] = 5, 3
    out = array(slices.mirror_labels(frame(spark, m), ["image_id"], "z", 4), m.shape)
    assert (out[1] == 8).all() and out[2, 0, 0] == 10 and (out != 0).sum() == 5


def test_intersect_and_alignment(spark):
    a, b = np.array([[0, 5], [2, 0]]), np.array([[1, 5], [0, 0]])
    shape = {"y": 2, "x": 2}
    assert array(slices.intersect_labels(frame(spark, a), frame(spark, b), ["image_id"], ["y", "x"], shape, shape), (2, 2)).tolist() == [[0, 5], [0, 0]]
    small = np.array([[7]])
    wide = np.zeros((5, 5), int)
    wide[2:5, 2:5] = 4
    out = array(slices.intersect_labels(frame(spark, wide), frame(spark, small), ["image_id"], ["y", "x"], {"y": 5, "x": 5}, {"y": 1, "x": 1}), (5, 5))
    assert out.sum() == 4 and out[3, 3] == 4


def test_layers(spark):
    m = np.zeros((9, 9), int)
    m[2:7, 2:7] = 1
    out = array(slices.subdivide_labels(frame(spark, m), ["image_id"], {"y": 9, "x": 9}), m.shape)
    assert {1, 2, 3} <= set(np.unique(out)) <= {0, 1, 2, 3} and ((out > 0) | (m == 0)).all()
    half = m[4:]
    cut = array(slices.subdivide_labels(frame(spark, half), ["image_id"], {"y": 5, "x": 9}, True, "y"), half.shape)
    assert {1, 2, 3} <= set(np.unique(cut)) and cut[0, 4] == 1 and cut[2, 4] == 3


def test_slice_range_of_even_slices_keeps_all(spark):
    m = np.ones((3, 2, 2), int)
    assert slices.keep_slice_range_by_area(frame(spark, m), ["image_id"], "z", 3).count() == 12


@pytest.mark.parametrize(("shape", "full"), [((12, 15), True), ((5, 6, 7), True), ((12, 15), False), ((5, 6, 7), False)])
def test_components_match_flood(spark, shape, full):
    m = (np.random.default_rng(9).random(shape) < 0.35) * np.random.default_rng(8).integers(1, 3, shape)
    seen, want = np.zeros(shape, bool), {}
    for start in np.ndindex(*shape):
        if m[start] and not seen[start]:
            stack, own = [start], []
            seen[start] = True
            while stack:
                p = stack.pop()
                own.append(p)
                for o in itertools.product((-1, 0, 1), repeat=len(shape)):
                    q = tuple(np.add(p, o))
                    if (full or sum(map(abs, o)) == 1) and all(0 <= a < n for a, n in zip(q, shape, strict=True)) and not seen[q] and m[q] == m[p]:
                        seen[q] = True
                        stack.append(q)
            want |= dict.fromkeys(own, start)
    axes = ["z", "y", "x"][-len(shape) :]
    got = {tuple(r[a] for a in axes): tuple(r["first"]) for r in components.components(frame(spark, m, "v"), ["image_id"], axes, full=full).collect()}
    assert got == want


def test_numbering_by_scan_and_class(spark):
    m = np.array([[2, 0, 1], [0, 0, 0], [1, 0, 2]])
    assert array(components.binary_to_labels(frame(spark, m, "v")), m.shape).tolist() == [[1, 0, 2], [0, 0, 0], [3, 0, 4]]
    assert array(components.semantic_to_instance(frame(spark, m, "v")), m.shape).tolist() == [[3, 0, 1], [0, 0, 0], [2, 0, 4]]


def test_stencils_match_padded_arrays(spark):
    m = np.random.default_rng(4).integers(0, 255, (7, 9)).astype(float)
    wide = np.pad(m, 2, mode="symmetric")
    around = np.stack([wide[1 + dy : 8 + dy, 1 + dx : 10 + dx] for dy in range(3) for dx in range(3)])
    (got,) = matrices(stencils.median_filter(planes(spark, m)))
    assert (got == np.median(around, 0)).all()
    w = np.array(stencils.gaussian_weights(1.3))
    r = len(w) // 2
    far = np.pad(m, r, mode="symmetric")
    want = sum(a * sum(b * far[i : i + 7, j : j + 9] for j, b in enumerate(w)) for i, a in enumerate(w))
    (got,) = matrices(stencils.gaussian_blur(planes(spark, m), 1.3))
    assert np.allclose(got, want)


def test_median_of_volumes(spark):
    v = np.random.default_rng(6).integers(0, 99, (4, 5, 6)).astype(float)
    df = planes(spark, *v).select(F.lit(0).alias("s"), F.col("image_id").alias("z"), "h", "w", "data")
    wide = np.pad(v, 1, mode="symmetric")
    want = np.median(np.stack([wide[a : a + 4, b : b + 5, c : c + 6] for a in range(3) for b in range(3) for c in range(3)]), 0)
    got = np.stack([np.array(r["data"]).reshape(5, 6) for r in stencils.median_volume(df, ["s"]).orderBy("z").collect()])
    assert (got == want).all()


def test_erosion_undoes_dilation_of_a_square(spark):
    m = np.zeros((9, 9))
    m[3:6, 3:6] = 1
    (got,) = matrices(stencils.binary_erosion(stencils.binary_dilation(planes(spark, m), iterations=2), iterations=2))
    assert (got == m).all()


def test_track_brightness_is_the_same_in_any_depth(spark):
    rows = [(t, 1, 1, 5, 25) for t in range(3)] + [(t, 4, 4, 7, 240) for t in range(3)] + [(0, 0, 0, 0, 0), (0, 0, 1, 0, 250)]
    for factor in (1, 256):
        movie = spark.createDataFrame([(*r[:4], r[4] * factor) for r in rows], "t int, y int, x int, label int, v int")
        assert {r["label"] for r in thresholds.delete_low_intensity_tracks(movie, 0.5).where("label <> 0").collect()} == {7}
        assert thresholds.delete_low_intensity_tracks(movie, 0).where("label = 5").count() == 3


def test_otsu_matches_plain_one(spark):
    rng = np.random.default_rng(2)
    a = np.where(rng.random((20, 20)) < 0.4, rng.normal(60, 9, (20, 20)), rng.normal(150, 20, (20, 20))).astype(int)
    v = np.arange(a.min(), a.max() + 1)
    n = np.array([(a == x).sum() for x in v])
    w1, w2 = np.cumsum(n), np.cumsum(n[::-1])[::-1]
    m1, m2 = np.cumsum(n * v) / w1, (np.cumsum((n * v)[::-1]) / np.cumsum(n[::-1]))[::-1]
    want = v[np.argmax(w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2)]
    assert thresholds.otsu(frame(spark, a, "v")).first()["threshold"] == want
    assert thresholds.otsu(frame(spark, np.full((2, 2), 7), "v")).first()["threshold"] == 7


def test_constant_images(spark):
    for value, want in ((0, 0), (9, 255)):
        assert {r["v"] for r in pixelmaps.convert_to_uint8(frame(spark, np.full((2, 2), value), "v")).collect()} == {want}
    assert {r["v"] for r in inspection.frames_to_bytes(frame(spark, np.full((2, 2), 5), "v"), ["image_id"]).collect()} == {128}


def test_edits(spark):
    assert labels.compose([{1: 2}, {2: 3}, {3: 1}]) == {2: 1, 3: 1} | {} and labels.compose([{1: 2, 2: 1}, {1: 2, 2: 1}]) == {}
    m = np.array([[1, 2], [3, 0]])
    once = labels.relabel(labels.relabel(frame(spark, m), {1: 2}), {2: 3})
    assert array(once, m.shape).tolist() == array(labels.apply_edits(frame(spark, m), [{1: 2}, {2: 3}]), m.shape).tolist()
    assert array(labels.apply_edits(frame(spark, m), [{1: 2}, {2: 3}], undone=2), m.shape).tolist() == m.tolist()


def test_frames(spark):
    movie = spark.createDataFrame([(t, t * 10) for t in range(4)], "t int, v int")
    assert [tuple(r) for r in pixelmaps.frame_removal(movie, [1, 2], 4).orderBy("t").collect()] == [(0, 0), (1, 30)]
    with pytest.raises(ValueError, match="at least one"):
        pixelmaps.frame_removal(movie, [0, 1, 2, 3], 4)


def test_natural_order(spark):
    names = ["b2.tif", "B10.tif", "a010.tif", "a9.tif", "a9b.tif", "c"]
    got = [r["path"] for r in stacks.natural_order(spark.createDataFrame([(n,) for n in names], "path string")).orderBy("rank").collect()]
    assert got == ["a9.tif", "a9b.tif", "a010.tif", "b2.tif", "B10.tif", "c"]


def test_pairs_and_groups_of_files(spark):
    files = spark.createDataFrame([(n,) for n in ("a.tif", "a_seg.tif", "a_labels.tif", "b.tif", "b_seg.tif", "c.tif")], "path string")
    got = {r["image"]: r["partner"] for r in stacks.pair_by_suffix(files, ["_labels.tif", "_seg.tif"]).collect()}
    assert got == {"a.tif": "a_labels.tif", "b.tif": "b_seg.tif", "c.tif": None}
    with pytest.raises(ValueError, match="c.tif has no partner"):
        stacks.pair_by_suffix(files, ["_labels.tif", "_seg.tif"], strict=True)
    one, two = (spark.createDataFrame([(f"s{k}_x_{c}.tif",) for k in (1, 2)], "path string") for c in ("red", "green"))
    assert {r["name"]: (r["file_0"], r["file_1"]) for r in stacks.group_by_common_name([one, two]).collect()} == {f"s{k}_x_": (f"s{k}_x_red.tif", f"s{k}_x_green.tif") for k in (1, 2)}


def test_axes():
    assert catalog.resolve_axes((3, 4, 5)) == "ZYX" and catalog.resolve_axes((3, 4, 5), "TYX") == "TYX" and catalog.resolve_axes((4, 5), "CYX") == "YX" and catalog.resolve_axes((2, 3, 4, 5), None, "TCYX") == "TCYX"
    assert stacks.channel_axis((10, 3, 64, 64)) == 1 and stacks.channel_axis((64, 64, 3)) == 2 and stacks.channel_axis((5, 64, 64)) is None and stacks.channel_axis((4, 3, 64, 64), 4) == 0 and stacks.channel_axis((4, 3, 9, 9), 4, "TCYX") == 1
    assert catalog.loop_axes("TZYX") == (["t"], ["z", "y", "x"]) and catalog.label_type(70000, "uint8") == "uint32" and catalog.label_type(9, "uint32") == "uint32"
    with pytest.raises(ValueError, match="name the axes"):
        catalog.resolve_axes((3, 4, 5), "ZZYX", strict=True)


def test_three_channels_of_names(spark):
    sets = [spark.createDataFrame([(f"/d/{n}.tif",) for n in names], "path string") for names in (["expA_day1_dapi", "expB_day1_dapi"], ["gfp_expB_day1", "gfp_expA_day1"], ["expA_day1_rfp", "expB_day1_rfp"])]
    got = {tuple(r[f"file_{k}"] for k in range(3)) for r in stacks.group_by_common_name(sets).collect()}
    assert got == {("/d/expA_day1_dapi.tif", "/d/gfp_expA_day1.tif", "/d/expA_day1_rfp.tif"), ("/d/expB_day1_dapi.tif", "/d/gfp_expB_day1.tif", "/d/expB_day1_rfp.tif")}


def test_split_channels(spark):
    df = spark.createDataFrame([(k, c, t, 1, c * 10 + t) for k, n in ((0, 2), (1, 3)) for c in range(2) for t in range(n)], "image_id int, c int, t int, x int, v int")
    out = stacks.split_channels(df, output_format="fiji", sort_by_timepoints=["image_id"])
    assert out.columns[:2] == ["t", "x"] and {r["file"] for r in out.select("file").collect()} == {f"T{n}/image_channel_{c}" for n in (2, 3) for c in (0, 1)}


def test_frames_of_different_sizes_raise(spark):
    df = spark.createDataFrame([("a", 0, 1, 1), ("b", 0, 1, 2)], "path string, t int, y int, v int").withColumn("x", F.col("v"))
    with pytest.raises(ValueError, match="different sizes"):
        stacks.merge_timepoints(df, shape=["y", "x"])


def merged_by_rule(image, least):
    """Merging of small labels, pixel by pixel with sets."""
    out = {p: int(v) for p, v in np.ndenumerate(image)}
    for _ in range(50):
        of = {}
        for p, v in out.items():
            of.setdefault(v, []).append(p)
        small = sorted(v for v, own in of.items() if v and len(own) < least)
        if not small:
            break
        boxes = {v: [(min(p[k] for p in of[v]) - 1, max(p[k] for p in of[v]) + 1) for k in range(image.ndim)] for v in small}
        for v in small:
            own = {p for p, w in out.items() if w == v and all(a <= q <= z for q, (a, z) in zip(p, boxes[v], strict=True))}
            ring = {tuple(np.add(p, o) - 1) for p in own for o in np.ndindex(*[3] * image.ndim)} - own
            met = [out[p] for p in ring if out.get(p, 0) not in (0,) and all(a <= q <= z for q, (a, z) in zip(p, boxes[v], strict=True))]
            met = [w for w in met if w not in small] or met
            new = min(set(met), key=lambda w: (-met.count(w), w)) if met else 0
            out |= dict.fromkeys(own, new)
    return np.array([out[p] for p in np.ndindex(*image.shape)]).reshape(image.shape)


def test_merging_small_labels_by_brute_force(spark):
    rng = np.random.default_rng(8)
    images = [rng.integers(0, 12, (12, 12)) * (rng.random((12, 12)) < 0.7) for _ in range(40)] + [np.kron(rng.integers(0, 9, (6, 6)), np.ones((2, 2), int)) for _ in range(20)]
    rows = [(k, y, x, int(v)) for k, m in enumerate(images) for (y, x), v in np.ndenumerate(m) if v]
    got = labels.merge_small_labels(spark.createDataFrame(rows, "image_id long, y int, x int, label long"), min_size=9).collect()
    out = [np.zeros(m.shape, int) for m in images]
    for r in got:
        out[r["image_id"]][r["y"], r["x"]] = r["label"]
    for m, o in zip(images, out, strict=True):
        assert (o == merged_by_rule(m, 9)).all()
    volume = rng.integers(0, 30, (4, 6, 6))
    rows = [(0, z, y, x, int(v)) for (z, y, x), v in np.ndenumerate(volume) if v]
    cube = np.zeros(volume.shape, int)
    for r in labels.merge_small_labels(spark.createDataFrame(rows, "image_id long, z int, y int, x int, label long"), axes=["z", "y", "x"], min_size=6).collect():
        cube[r["z"], r["y"], r["x"]] = r["label"]
    assert (cube == merged_by_rule(volume, 6)).all()


def test_distances_and_basins_by_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(20):
        mask = rng.random((9, 11)) < 0.8
        away = np.argwhere(~mask)
        want = np.array([min(((p - q) ** 2).sum() for q in away) if len(away) else np.inf for p in np.argwhere(np.ones_like(mask))]).reshape(mask.shape)
        assert np.array_equal(editing.squared_distance(mask), np.where(mask, want, 0))
        seeds = [tuple(p) for p in np.argwhere(mask)[[0, -1]]]
        part = editing.flood(-editing.squared_distance(mask), mask, seeds)
        # Each basin hangs together with its seed, and what the seeds can't reach has none.
        reach = [editing.reached(np.isin(np.arange(mask.size).reshape(mask.shape), [s[0] * 11 + s[1]]), mask) for s in seeds]
        assert ((part > 0) == (reach[0] | reach[1])).all()
        for k, s in enumerate(seeds, 1):
            start = np.zeros_like(mask)
            start[s] = True
            assert (editing.reached(start, part == k) == (part == k)).all()


def test_large_planes_are_cut_and_joined(spark):
    """Volumes in tiles give what the whole array gives."""
    from voxelmill.functions import planes as kernels

    rng = np.random.default_rng(10)
    volume = rng.random((3, 23, 31))
    df = spark.createDataFrame([(7, z, 23, 31, p.ravel().tolist()) for z, p in enumerate(volume)], "s int, z int, h int, w int, data array<double>")
    w = stencils.gaussian_weights(0.8)
    for kernel, halo in ((lambda v: stencils.separable(v, w, (0, 1, 2)), len(w) // 2), (lambda v: kernels.median(v, (3, 3, 3)), 1)):
        got = np.stack([np.array(r["data"]).reshape(23, 31) for r in kernels.over_volumes(df, ["s"], kernel, halo, tile=8).orderBy("z").collect()])
        assert np.allclose(got, kernel(volume))


def test_seeds_split_a_dumbbell(spark):
    m = np.zeros((9, 17), int)
    m[1:8, 1:8], m[1:8, 9:16], m[4, 8] = 1, 1, 1
    m[0, 0] = 6
    seeds = spark.createDataFrame([(0, 1, 0, 4, 4), (0, 1, 1, 4, 12)], "image_id long, label long, seed int, y int, x int")
    out = array(editing.split_by_seeds(frame(spark, m), seeds, ["image_id"]), m.shape)
    assert (out[1:8, 1:8] == 1).all() and (out[1:8, 9:16] == 7).all() and out[0, 0] == 6 and out[4, 8] in (1, 7)


def test_squared_distance_matches_brute_force():
    m = np.random.default_rng(5).random((9, 11)) < 0.8
    away = np.argwhere(~m)
    want = np.array([[((away - (y, x)) ** 2).sum(1).min() for x in range(11)] for y in range(9)])
    assert (editing.squared_distance(m) == want).all()


def test_constrained_region():
    region, seed, free = np.zeros((9, 9), bool), np.zeros((9, 9), bool), np.ones((9, 9), bool)
    region[1:6, 1:6], region[3, 3], region[8, 8], seed[2, 2], free[1, :] = True, False, True, True, False
    out = editing.constrained(region, seed, free, 0, 0)
    assert out[3, 3] and not out[8, 8] and not out[1].any() and out.sum() == 20
    assert editing.constrained(region, seed, free, 1, 0).sum() == 4


def test_spots(spark):
    spots = spark.createDataFrame([(0, 0, 4.0, 4.0), (0, 1, 4.0, 5.0), (0, 2, 50.0, 1.0)], "image_id long, spot_id long, y double, x double")
    out = array(tracking.spots_to_labels(spots, {"y": 9, "x": 9}, 2), (9, 9))
    assert out[4, 3] == 1 and out[4, 4] == 2 and set(np.unique(out)) == {0, 1, 2} and (out > 0).sum() == 12


def test_links_match_plain_greedy(spark):
    rng = np.random.default_rng(7)
    rows = [(t, k, float(y), float(x)) for t in range(4) for k, (y, x) in enumerate(rng.random((6, 2)) * 20)]
    regions_ = spark.createDataFrame(rows, "t int, label int, cy double, cx double")
    edges = tracking.candidate_edges(regions_, max_dt=1, max_distance=8.0, neighbors=4)
    left, right, want = set(), set(), set()
    for r in sorted(edges.collect(), key=lambda r: (r["distance"], r["t1"], r["label1"], r["t2"], r["label2"])):
        a, b = (r["t1"], r["label1"]), (r["t2"], r["label2"])
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((a, b))
    assert {((r["t1"], r["label1"]), (r["t2"], r["label2"])) for r in tracking.greedy_link(edges).collect()} == want
    brute = {((a[0], a[1]), (b[0], b[1])) for a in rows for b in sorted((b for b in rows if b[0] == a[0] + 1 and np.hypot(a[2] - b[2], a[3] - b[3]) <= 8), key=lambda b: np.hypot(a[2] - b[2], a[3] - b[3]))[:4]}
    assert {((r["t1"], r["label1"]), (r["t2"], r["label2"])) for r in edges.collect()} == brute


def test_enhancement(spark):
    m = np.random.default_rng(3).integers(0, 200, (16, 16))
    out = array(enhance.clahe(frame(spark, m, "v"), 16, 16, kernel_size=5, clip_limit=0.1), m.shape, "v")
    assert out.max() <= 255 and out.min() >= 0 and np.corrcoef(out.ravel(), m.ravel())[0, 1] > 0.7
    flat = np.full((12, 12), 50.0)
    (ball,) = matrices(enhance.rolling_ball(planes(spark, flat), 3))
    assert (ball == 0).all()
    spot = flat.copy()
    spot[6, 6] = 90
    (ball,) = matrices(enhance.rolling_ball(planes(spark, spot), 3))
    assert ball[6, 6] > 30
    assert np.allclose(enhance.resize_weights(9, 0.5).sum(1), 1) and enhance.resize_weights(8, 2.0).shape == (16, 8)
    (half,) = matrices(enhance.resize_yx(planes(spark, flat), 0.5))
    assert half.shape == (6, 6) and (half == 50).all()


def test_stacks_through_a_model(spark):
    df = planes(spark, *np.ones((4, 2, 3))).select(F.lit(0).alias("s"), F.col("image_id").alias("z"), "h", "w", "data")
    out = models.predict_stacks(df, ["s"], lambda v: v * len(v), depth=3)
    assert [r["data"][0] for r in out.orderBy("z").collect()] == [3, 3, 3, 3]  # the last batch begins a plane early, so it is as deep as the model needs
    with pytest.raises(ValueError, match="5 planes"):
        models.predict_stacks(df, ["s"], lambda v: v, depth=5)


def test_connected(spark):
    edges = [(f"{k:03d}", f"{k + 1:03d}") for k in range(40)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r["node"]: r["label"] for r in graph.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{k:03d}": "000" for k in range(41)} | {"x": "x", "y": "x", "z": "z"}
    assert graph.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def test_registry(spark):
    assert len(registry.names()) >= 40
    m = np.array([[0, 2], [3, 3]])
    assert array(registry.run("Filter Label by ID", frame(spark, m), label_id=3), m.shape).tolist() == [[0, 0], [3, 3]]
    with pytest.raises(TypeError, match="no parameters"):
        registry.run("Filter Label by ID", frame(spark, m), labelid=3)


def test_level_scales():
    assert inspection.level_scales({"z": 2.0, "y": 0.5}, {"z": 4, "y": 100}, {"z": 4, "y": 50}, 2) == [{"z": 2.0, "y": 1.0}, {"z": 2.0, "y": 2.0}]
    assert inspection.model_input(1000, 1000) == 1.0 and np.isclose(inspection.model_input(4000, 2000), 0.5) and stitching.block_count(100, 40, 10) == 3


def test_planes_for_colour_models(spark):
    plane = np.arange(24.0).reshape(4, 6) * 10
    assert np.allclose(models.in_colour(plane), np.stack([plane / 255] * 3, 2)) and np.array_equal(models.in_colour(plane / 1000)[..., 1], plane / 1000)
    big = np.kron(np.arange(4.0).reshape(2, 2), np.ones((20, 20))) * 80
    small = models.in_colour(big, 4e-4)
    assert small.shape == (20, 20, 3) and small[0, 0, 0] == pytest.approx(0) and small[-1, -1, 2] == pytest.approx(240 / 255)
    df = spark.createDataFrame([(0, 40, 40, big.ravel().tolist()), (1, 4, 6, plane.ravel().tolist())], "i int, h int, w int, data array<double>")
    got = {r["i"]: np.reshape(r["data"], (r["h"], r["w"])) for r in models.predict_in_colour(df, lambda a: a[..., 0] > 0.5, 4e-4).collect()}
    assert np.array_equal(got[0], big > 127.5) and np.array_equal(got[1], plane > 127.5)


def test_frames_before_each_file(spark):
    sizes = [3, 1, 4, 1, 5, 9, 2, 6]
    rows = [(f, k, n * (1 + (f == "b"))) for f in "ab" for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "folder string, rank long, __n long")
    for each in (1, 3, 100):
        got = {(r["folder"], r["rank"]): r["__before"] for r in stacks.frames_before(df, ["folder"], each).collect()}
        assert got == {(f, k): sum(sizes[:k]) * (1 + (f == "b")) for f in "ab" for k in range(len(sizes))}
        one = stacks.frames_before(df.where("folder = 'a'").drop("folder"), each=each).collect()
        assert {r["rank"]: r["__before"] for r in one} == {k: sum(sizes[:k]) for k in range(len(sizes))}
