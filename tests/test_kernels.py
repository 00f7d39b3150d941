"""Distances, basins, balls, hulls, order statistics and clusters against plain versions."""

import heapq
import itertools

import numpy as np
import pandas as pd
import pytest

from voxelmill.functions.ranks import exact_percentiles
from voxelmill.operators import editing, enhance, labels, regions, thresholds


@pytest.mark.parametrize("shape", [(9,), (7, 8), (1, 12), (5, 6, 7), (3, 4, 3, 3)])
def test_distances(shape):
    rng = np.random.default_rng(2)
    for share in (0.2, 0.7, 0.95, 1.0):
        m = rng.random(shape) < share
        out = np.argwhere(~m)
        want = [min(((out - p) ** 2).sum(1), default=np.inf) if len(out) else np.inf for p in np.argwhere(np.ones(shape))]
        assert (editing.squared_distance(m).ravel() == np.array(want, float)).all()


def heap_flood(height, mask, seeds):
    out, heap, n = np.zeros(mask.shape, int), [], 0
    for k, s in enumerate(seeds, 1):
        if mask[s]:
            out[s] = k
            heapq.heappush(heap, (height[s], n, s))
            n += 1
    steps = [tuple(d if a == axis else 0 for a in range(mask.ndim)) for axis in reversed(range(mask.ndim)) for d in (1, -1)]
    while heap:
        _, _, p = heapq.heappop(heap)
        for o in steps:
            q = tuple(np.add(p, o))
            if all(0 <= a < b for a, b in zip(q, mask.shape, strict=True)) and mask[q] and not out[q]:
                out[q] = out[p]
                heapq.heappush(heap, (height[q], n, q))
                n += 1
    return out


@pytest.mark.parametrize("shape", [(15, 16), (6, 7, 8), (3, 4, 4, 3)])
def test_basins_are_those_of_a_heap_of_pixels(shape):
    rng = np.random.default_rng(3)
    for k in range(12):
        mask, height = rng.random(shape) < 0.8, rng.integers(0, 3 + 5 * k, shape).astype(float)
        seeds = [tuple(int(rng.integers(0, n)) for n in shape) for _ in range(4)]
        seeds = list(dict.fromkeys(seeds))
        assert (editing.flood(height, mask, seeds) == heap_flood(height, mask, seeds)).all()
    assert not editing.flood(np.zeros(shape), np.zeros(shape, bool), [(0,) * len(shape)]).any()


def test_two_balls_are_split_in_a_volume(spark):
    z, y, x = np.indices((12, 14, 24))
    one, two = ((z - 6) ** 2 + (y - 7) ** 2 + (x - a) ** 2 <= 30 for a in (7, 16))
    own = np.argwhere(one | two)
    df = spark.createDataFrame([(0, *map(int, p), 5) for p in own], "image_id int, z int, y int, x int, label int")
    seeds = spark.createDataFrame([(0, 5, 6, 7, 16, 2), (0, 5, 6, 7, 7, 1)], "image_id int, label int, z int, y int, x int, seed int")
    got = {(r["z"], r["y"], r["x"]): r["label"] for r in editing.split_by_seeds(df, seeds, ["image_id"], axes=("z", "y", "x")).collect()}
    assert len(got) == len(own) and set(got.values()) == {5, 6}
    assert all(got[tuple(map(int, p))] == (5 if p[2] < 11 else 6) for p in own if p[2] not in (11, 12))


@pytest.mark.parametrize(("shape", "radius"), [((1, 20, 23), 4), ((2, 5, 40), 7), ((5, 7, 8), 3), ((4, 6, 5), 6)])
@pytest.mark.parametrize("axes", [2, 3])
def test_balls(shape, radius, axes):
    v = np.random.default_rng(5).integers(0, 255, shape).astype(float)
    want = np.empty(shape)
    places = list(np.ndindex(*shape))
    for p in places:
        near = [(q, sum((a - b) ** 2 for a, b in zip(p, q, strict=True))) for q in places if axes == 3 or p[0] == q[0]]
        want[p] = max(0, v[p] - min(v[q] + radius - np.sqrt(radius * radius - d) for q, d in near if d <= radius * radius))
    assert np.allclose(enhance.above_ball(v, radius, axes), want)


def test_hulls_by_pixels():
    rng = np.random.default_rng(6)
    for _ in range(40):
        ys = np.arange(int(rng.integers(1, 12))) + 3
        low = rng.integers(0, 10, len(ys))
        high = low + rng.integers(0, 10, len(ys))
        corners = np.array([(y + dy, x + dx) for y, a, b in zip(ys, low, high, strict=True) for x in (a, b) for dy, dx in ((-0.5, 0), (0.5, 0), (0, -0.5), (0, 0.5))])
        # A pixel is in the hull if no line through two corners parts it from all of them.
        inside = 0
        for p in itertools.product(range(ys[0], ys[-1] + 1), range(low.min(), high.max() + 1)):
            angle = np.sort(np.unique(np.arctan2(*(corners - p).T))) if not (corners == p).all(1).any() else np.zeros(0)
            inside += not len(angle) or np.max(np.diff(np.r_[angle, angle[0] + 2 * np.pi])) <= np.pi + 1e-9
        assert regions.hull_pixels(ys, low, high) == inside
    assert regions.hull_pixels(np.arange(3000), np.zeros(3000, int), np.full(3000, 2999)) == 3000 * 3000


# Order statistics


@pytest.mark.parametrize("bins", [2, 1024])
def test_percentiles(spark, bins):
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=501), "b": np.r_[np.zeros(50), 1e300, -1e300, rng.random(20)], "c": [7.5], "d": np.repeat([1.0, 2.0], 30), None: rng.exponential(size=100) ** 9, "e": [5e-324, 0.0, 1e-323, -5e-324]}
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("a", None), ("a", float("nan")), ("z", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = {"low": 0.0, "p37": 0.37, "mid": 0.5, "p99": 0.99, "high": 1.0}
    got = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", shares, bins).collect()}
    assert set(got) == set(groups)
    for k, own in groups.items():
        assert [got[k][n] for n in shares] == pytest.approx([np.quantile(np.array(own), s) for s in shares.values()], rel=1e-12, abs=1e-322)
    with pytest.raises(ValueError):
        exact_percentiles(df, ["k"], "v", {"x": 1.5})
    assert exact_percentiles(df.where("false"), ["k"], "v", {"x": 0.5}).collect() == []
    wide = exact_percentiles(spark.createDataFrame([("a", float("inf")), ("a", 1.0), ("a", float("-inf"))], "k string, v double"), ["k"], "v", {"m": 0.5, "t": 1.0}).first()
    assert wide["m"] == 1.0 and wide["t"] > 1e308


def test_float_images_have_the_same_thresholds_and_medians(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"image_id": np.repeat([1, 2], 200), "y": np.tile(np.arange(200), 2) // 20, "x": np.tile(np.arange(200), 2) % 20, "v": rng.random(400), "label": rng.integers(0, 4, 400)})
    df = spark.createDataFrame(pdf)
    got = {r["image_id"]: r["n"] for r in thresholds.percentile_threshold(df, percentile=90).where("v > 0").groupBy("image_id").agg({"*": "count"}).toDF("image_id", "n").collect()}
    assert got == {k: int((g["v"] > np.percentile(g["v"], 90)).sum()) for k, g in pdf.groupby("image_id")}
    middle = {(r["image_id"], r["label"]): r["median_int"] for r in regions.regionprops(df).collect()}
    assert middle == pytest.approx(pdf[pdf.label > 0].groupby(["image_id", "label"])["v"].median().to_dict())


# Clusters


def plain_merge(grid, movable, min_size, passes=50):
    """The rule on a dense grid, pixel by pixel."""
    grid = np.pad(grid, 1)
    for _ in range(passes):
        sizes = {n: int((grid == n).sum()) for n in np.unique(grid).tolist() if n}
        tiny = [n for n in sorted(sizes) if n in movable and sizes[n] < min_size]
        if not tiny:
            break
        boxes = {n: (np.argwhere(grid == n).min(0) - 1, np.argwhere(grid == n).max(0) + 1) for n in tiny}
        for n in tiny:
            low, high = boxes[n]
            box = [tuple(map(int, p)) for p in itertools.product(*[range(a, z + 1) for a, z in zip(low, high, strict=True)])]
            own = {p for p in box if grid[p] == n}
            ring = {q for p in own for o in itertools.product((-1, 0, 1), repeat=grid.ndim) if (q := tuple(int(v) for v in np.add(p, o))) in set(box) and q not in own and grid[q]}
            votes = [int(grid[q]) for q in ring]
            votes = [v for v in votes if v not in tiny] or votes
            to = min(set(votes), key=lambda v: (-votes.count(v), v), default=0)
            for p in own:
                grid[p] = to
    return grid[(slice(1, -1),) * grid.ndim]


@pytest.mark.parametrize("shape", [(12, 13), (5, 6, 6)])
def test_clusters_merge_by_the_rule(shape):
    rng = np.random.default_rng(10)
    for k in range(25):
        grid = rng.integers(0, 9 + k, shape) * (rng.random(shape) < 0.7)
        sizes = {n: int((grid == n).sum()) for n in np.unique(grid).tolist() if n}
        least = 6
        small = {n for n, m in sizes.items() if m < least}
        at = np.argwhere(grid)
        ids = grid[tuple(at.T)]
        got = np.zeros(shape, int)
        got[tuple(at.T)] = labels.merge_cluster(at, ids, np.isin(ids, list(small)), least)
        assert (got == plain_merge(grid, small, least)).all()
