"""Whole queries that have no SQL against plain versions, image by image."""

import numpy as np
import pytest

from voxelmill.plans import fixtures, queries

QUERIES = queries.queries()


@pytest.fixture(scope="module")
def images(spark, sf_dir):
    """Values and labels of each image of the fixture."""
    out = {}
    for r in fixtures.lbl(spark, sf_dir).collect():
        v, label = out.setdefault(r["image_id"], (np.zeros((8, 8), int), np.zeros((8, 8), int)))
        v[r["y"], r["x"]], label[r["y"], r["x"]] = r["v"], r["label"]
    return out


def pixels_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["image_id"], {})[r["y"], r["x"]] = r["label"]
    return out


def zoomed(image, scale):
    """Nearest pixels of a grid that is scaled about its centre."""
    out = np.zeros_like(image)
    new = [round(n * scale) for n in image.shape]
    off = [int((n - m) / 2) for n, m in zip(image.shape, new, strict=True)]
    for p in np.ndindex(*image.shape):
        j = [a - o for a, o in zip(p, off, strict=True)]
        if all(0 <= a < m for a, m in zip(j, new, strict=True)):
            out[p] = image[tuple(min(n - 1, int((a + 0.5) * n / m)) for a, n, m in zip(j, image.shape, new, strict=True))]
    return out


def test_subdivide_half_body(spark, sf_dir, images):
    got = pixels_of(QUERIES["subdivide_half_body"](spark, sf_dir).collect())
    for k, (_, label) in images.items():
        rows = np.flatnonzero(label.any(1))
        if not len(rows):
            assert k not in got
            continue
        lo, hi = rows[0], rows[-1]
        half = label[lo : hi + 1]
        start = (half[0] != 0).sum() >= (half[-1] != 0).sum()
        whole = np.concatenate([half[::-1], half] if start else [half, half[::-1]])
        small, middle, top = zoomed(whole, 0.33), zoomed(whole, 0.67), label.max()
        made = np.where((whole != 0) & (middle == 0), whole + 2 * top, np.where((middle != 0) & (small == 0), middle + top, small))
        kept = made[len(half) :] if start else made[: len(half)]
        assert got.get(k, {}) == {(y + lo, x): v for (y, x), v in np.ndenumerate(kept) if v}


def test_intensity_label_filter_3(spark, sf_dir, images):
    rows = QUERIES["intensity_label_filter_3"](spark, sf_dir).collect()
    got = {(r["image_id"], r["label"]): r for r in rows}
    n = 0
    for k, (v, label) in images.items():
        means = {i: v[label == i].mean() for i in np.unique(label[label != 0])}
        values = np.array(sorted(means.values()))
        distinct = np.unique(values)
        medoids = distinct if len(distinct) <= 3 else distinct[np.unique(np.rint(np.linspace(0, len(distinct) - 1, 3)).astype(int))]
        while len(distinct) > 3:
            nearest = np.abs(values[:, None] - medoids).argmin(1)
            # The lower of two middle values; a cluster's medoid has the least sum of distances.
            new = np.unique([values[nearest == c][(np.sum(nearest == c) - 1) // 2] for c in range(len(medoids)) if (nearest == c).any()])
            if np.array_equal(new, medoids):
                break
            medoids = new
        for i, m in means.items():
            r = got[k, i]
            n += 1
            assert r["mean"] == pytest.approx(m) and r["size"] == (label == i).sum() and r["cluster"] == int((m > (medoids[:-1] + medoids[1:]) / 2).sum())
            assert r["kept"] == (len(medoids) < 2 or m >= medoids[:2].mean())
    assert n == len(rows)


def test_merge_small_labels(spark, sf_dir, images):
    from test_operators import merged_by_rule

    got = pixels_of(QUERIES["merge_small_labels"](spark, sf_dir).collect())
    for k, (_, label) in images.items():
        assert got.get(k, {}) == {p: v for p, v in np.ndenumerate(merged_by_rule(label, 5)) if v}


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def test_region_solidity(spark, sf_dir, images):
    """Pixels whose middles are on the inner side of every edge of the hull of all pixels' sides' middles."""
    rows = QUERIES["region_solidity"](spark, sf_dir).collect()
    assert len(rows) == sum(len(np.unique(label[label != 0])) for _, label in images.values())
    for r in rows:
        label = images[r["image_id"]][1]
        at = np.argwhere(label == r["label"])
        points = sorted({(y + a, x + b) for y, x in at.tolist() for a, b in ((-0.5, 0), (0.5, 0), (0, -0.5), (0, 0.5))})
        hull = []
        for side in (points, points[::-1]):
            chain = []
            for p in side:
                while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                    chain.pop()
                chain.append(p)
            hull += chain[:-1]
        inside = sum(all(turn(a, b, q) >= -1e-9 for a, b in zip(hull, hull[1:] + hull[:1], strict=True)) for q in np.ndindex(8, 8))
        assert (r["area"], r["convex_area"]) == (len(at), inside) and r["solidity"] == pytest.approx(len(at) / inside, abs=1e-6)


@pytest.fixture(scope="module")
def links(spark, sf_dir):
    """Regions and links of the movie: all pairs of next frames by distance, each region once at either end."""
    regions = {(r["t"], r["label"]): (r["cy"], r["cx"]) for r in queries.movie_regions(spark, sf_dir).collect()}
    pairs = []
    for (t, a), p in regions.items():
        near = sorted((float(np.hypot(*np.subtract(p, q))), u, b) for (u, b), q in regions.items() if u == t + 1)
        pairs += [(d, t, a, u, b) for d, u, b in near[:5] if d <= 5]
    taken, out, into = [], set(), set()
    for d, t, a, u, b in sorted(pairs):
        if (t, a) not in out and (u, b) not in into:
            taken.append((t, a, u, b, d))
            out.add((t, a))
            into.add((u, b))
    return regions, taken


def test_greedy_link(spark, sf_dir, links):
    got = {(r["t1"], r["label1"], r["t2"], r["label2"]): r["distance"] for r in QUERIES["greedy_link"](spark, sf_dir).collect()}
    assert set(got) == {x[:4] for x in links[1]} and all(got[x[:4]] == pytest.approx(x[4], abs=1e-6) for x in links[1])


def test_greedy_tracks(spark, sf_dir, links):
    regions, taken = links
    root = {r: r for r in regions}
    for t, a, u, b, _ in sorted(taken):
        root[u, b] = root[t, a]
    number = {r: k for k, r in enumerate(sorted(set(root.values())), 1)}
    assert {(r["t"], r["label"]): r["track_id"] for r in QUERIES["greedy_tracks"](spark, sf_dir).collect()} == {r: number[root[r]] for r in regions}


def basins(mask, seeds):
    """Pixels by rising height, of equal ones the first that was seen, each to the basin beside it."""
    away = [p for p in np.ndindex(10, 10) if not (0 < p[0] < 9 and 0 < p[1] < 9 and mask[p[0] - 1, p[1] - 1])]
    height = {p: -min((p[0] + 1 - a) ** 2 + (p[1] + 1 - b) ** 2 for a, b in away) for p in np.ndindex(8, 8) if mask[p]}
    part, waiting, n = {}, [], 0
    for k, s in enumerate(seeds, 1):
        part[s] = k
        waiting.append((height[s], n, s))
        n += 1
    while waiting:
        waiting.sort()
        _, _, (y, x) = waiting.pop(0)
        for q in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
            if q in height and q not in part:
                part[q] = part[y, x]
                waiting.append((height[q], n, q))
                n += 1
    return part


def test_split_by_seeds(spark, sf_dir, images):
    got = pixels_of(QUERIES["split_by_seeds"](spark, sf_dir).collect())
    for k, (_, label) in images.items():
        want, fresh = {p: v for p, v in np.ndenumerate(label) if v}, label.max() + 1
        for i in np.unique(label[label != 0]):
            seeds = [p for p in np.ndindex(8, 8) if label[p] == i and sum(p) % 3 == 0]
            seeds = list(dict.fromkeys([seeds[0], seeds[-1]])) if seeds else []
            if len(seeds) > 1:
                part = basins(label == i, seeds)
                for p in np.ndindex(8, 8):
                    if label[p] == i and part.get(p, 1) > 1:
                        want[p] = fresh
                fresh += any(v > 1 for v in part.values())
        assert got.get(k, {}) == want


def test_region_constraint(spark, sf_dir, images):
    rows = QUERIES["region_constraint"](spark, sf_dir).collect()
    got = {}
    for r in rows:
        got.setdefault(r["image_id"], set()).add((r["y"], r["x"]))
    faces = ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))
    grid = set(np.ndindex(8, 8))
    grow = lambda s: {(y + a, x + b) for y, x in s for a, b in faces} & grid

    def filled(start, mask):
        now = start & mask
        while (new := grow(now) & mask) != now:
            now = new
        return now

    for k, (v, label) in images.items():
        free = {p for p in grid if label[p] in (0, 1)}
        seed = {p for p in grid if label[p] == 1 and v[p] > 150}
        region = ({p for p in grid if v[p] > 130} | seed) & free
        if not seed and not region:
            assert k not in got
            continue
        region = {p for p in region if seed and min((p[0] - a) ** 2 + (p[1] - b) ** 2 for a, b in seed) <= 16}
        region = grow(region)
        for _ in range(2):
            region = grid - grow(grid - region)
        region = (grow(region) | seed) & free
        edge = {p for p in grid if 0 in p or 7 in p}
        region = (grid - filled(edge, grid - region)) & free
        assert got.get(k, set()) == (filled(seed, region) if seed & region else seed)
