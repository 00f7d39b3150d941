"""Many small objects, images and blocks are dealt with together, as each one alone."""

import numpy as np
import pytest

from voxelmill.functions import tiles
from voxelmill.operators import components, editing, stitching
from voxelmill.plans.queries import queries


@pytest.mark.parametrize("shape", [(20, 7, 9), (8, 5, 6, 7)])
def test_basins_of_a_stack_are_those_of_each_array(shape):
    rng = np.random.default_rng(31)
    mask = rng.random(shape) < 0.7
    mask[0] = True
    seeds = [(k, *(int(rng.integers(0, n)) for n in shape[1:])) for k in range(len(mask)) for _ in range(3)]
    away = editing.squared_distance(mask, apart=1)
    part = editing.flood(-np.where(np.isinf(away), 99, away), mask, seeds, apart=1)
    for k, m in enumerate(mask):
        alone = editing.squared_distance(m)
        assert np.array_equal(away[k], alone)
        want = editing.flood(-np.where(np.isinf(alone), 99, alone), m, [s[1:] for s in seeds if s[0] == k])
        assert np.array_equal(np.where(part[k], part[k] - 3 * k, 0), want)


@pytest.mark.parametrize("cells", [1, 200, 1 << 21])
def test_objects_of_a_stack_are_split_as_each_alone(spark, monkeypatch, cells):
    monkeypatch.setattr(editing, "CELLS", cells)
    rng = np.random.default_rng(32)
    images = {f"i{k}": rng.integers(0, 4, (6, 9)) for k in range(12)}
    images["i3"][:] = 2
    pixels = [(k, *map(int, p), int(m[p])) for k, m in images.items() for p in np.ndindex(m.shape)]
    # Seeds lie in objects, beside them, beyond their boxes and twice at one place.
    seeds = [(k, n, s, *(int(c) for c in rng.integers(-2, 9, 2))) for k in images for n in (1, 2, 3) for s in range(4)]
    seeds += [("i0", 1, 9, *seeds[0][3:]), ("i5", 7, 0, 1, 1), ("i5", 7, 1, 2, 2), ("none", 1, 0, 1, 1), ("none", 1, 1, 2, 2)]
    got = editing.split_by_seeds(spark.createDataFrame(pixels, "image_id string, y int, x int, label int"), spark.createDataFrame(seeds, "image_id string, label int, seed int, y int, x int"), ["image_id"]).collect()
    want = set()
    for k, m in images.items():
        fresh = int(m.max())
        for n in (1, 2, 3):
            at = np.argwhere(m == n)
            if not len(at):
                continue
            low = at.min(0) - 1
            mask = np.zeros(at.max(0) - low + 2, bool)
            mask[tuple((at - low).T)] = True
            start = [tuple(np.subtract(s[3:], low)) for s in seeds if s[:2] == (k, n)]
            start = [s for s in start if all(0 <= c < e for c, e in zip(s, mask.shape, strict=True))]
            part = np.maximum(editing.flood(-editing.squared_distance(mask), mask, start), 1)[tuple((at - low).T)]
            new = {1: n} | {p: fresh + j for j, p in enumerate(sorted(set(part.tolist()) - {1}), 1)}
            fresh += len(new) - 1
            want |= {(k, *map(int, p), new[q]) for p, q in zip(at, part.tolist(), strict=True)}
    assert len(got) == len(want) and {(r["image_id"], r["y"], r["x"], r["label"]) for r in got} == want


@pytest.mark.parametrize("shape", [(30, 5, 5), (9, 1, 7), (6, 4, 5, 3), (1, 8), (0, 4, 4)])
def test_a_stack_is_labelled_as_each_array(shape):
    values = np.random.default_rng(33).integers(0, 3, shape)
    values[::4] = 0
    got = tiles.label_stack(values)
    assert got.shape == values.shape
    for own, array in zip(got, values, strict=True):
        assert np.array_equal(own, tiles.label_array(array))


@pytest.mark.parametrize("cells", [1, 60, 1 << 21])
def test_blocks_are_labelled_as_stacks(spark, monkeypatch, cells):
    """Images of several sizes with pixels missing: stacks of blocks of one shape give what each block alone gives, and what whole images give."""
    monkeypatch.setattr(stitching, "CELLS", cells)
    rng = np.random.default_rng(34)
    pixels = [(k, *map(int, p), int(rng.random() < 0.5)) for k in range(9) for p in np.ndindex(4 + k, 12 - k) if rng.random() < 0.9]
    df = spark.createDataFrame(pixels, "image_id int, y int, x int, v int")
    args, blocks = (["image_id"], {"y": 12, "x": 12}), {"size": 5, "overlap": 2}
    rows = lambda d: sorted(map(tuple, d.collect()))
    together = rows(stitching.segment_blocks(df, *args, tiles.label_stack, **blocks, stacked=True))
    assert together and together == rows(stitching.segment_blocks(df, *args, tiles.label_array, **blocks))
    whole = rows(components.binary_to_labels(df))
    assert rows(stitching.segment_stitched(df, ["image_id"], ["y", "x"], tiles.label_stack, **blocks, share=0.0, stacked=True)) == whole


def test_a_model_of_stacks_keeps_their_shape(spark):
    df = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 1, 1)], "image_id int, y int, x int, v int")
    with pytest.raises(Exception, match="of a stack of"):
        stitching.segment_stitched(df, ["image_id"], ["y", "x"], lambda s: s[:, :1], stacked=True).collect()


@pytest.mark.parametrize(("most", "smooth"), [(0, 0), (2, 0), (0, 1), (3, 2)])
def test_regions_of_a_stack_are_constrained_as_each_alone(most, smooth):
    rng = np.random.default_rng(35)
    region, seed, free = (rng.random((40, 9, 12)) < share for share in (0.5, 0.05, 0.8))
    seed[3], region[4], free[5], seed[6] = False, False, False, True
    got = editing.constrained(region, seed, free, most, smooth)
    for k in range(len(seed)):
        assert np.array_equal(got[k], editing.constrained(region[k], seed[k], free[k], most, smooth))


@pytest.mark.parametrize("cells", [1, 300, 1 << 21])
def test_images_of_a_batch_are_constrained_as_each_alone(spark, monkeypatch, cells):
    """Images of several sizes, some without a seed or region, flags that are null: as a plane by itself."""
    monkeypatch.setattr(editing, "CELLS", cells)
    rng = np.random.default_rng(36)
    rows, want = [], set()
    for k in range(14):
        planes = [rng.random((6 + k % 5, 9 + k % 3)) < share for share in (0.4, 0.05, 0.8)]
        if k in (3, 4):
            planes[1][:] = False
        if k == 4:
            planes[0][:] = False
        rows += [(f"i{k}", y, x, *[bool(p[y, x]) or (None if (y + x) % 2 else False) for p in planes]) for y, x in np.ndindex(planes[0].shape)]
        if k != 4:
            at = np.argwhere(planes[0] | planes[1])
            box = tuple(slice(max(0, lo - 3), hi + 4) for lo, hi in zip(at.min(0), at.max(0), strict=True))
            alone = editing.constrained(*[p[box] for p in planes], 3, 1)
            want |= {(f"i{k}", int(y) + box[0].start, int(x) + box[1].start) for y, x in np.argwhere(alone)}
    got = editing.constrain_regions(spark.createDataFrame(rows, "image_id string, y int, x int, region boolean, seed boolean, free boolean"), ["image_id"], 3, 1)
    assert got.columns == ["image_id", "y", "x"] and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["region_constraint", "split_by_seeds", "segment_by_blocks"])
def test_python_is_not_called_for_each_group(spark, sf_dir, monkeypatch, name):
    from voxelmill.functions import graph

    plans, cut = [], graph.Scratch.cut

    def seen(self, df):
        plans.append(df._jdf.queryExecution().toString())
        return cut(self, df)

    monkeypatch.setattr(graph.Scratch, "cut", seen)
    plans.append(queries()[name](spark, sf_dir)._jdf.queryExecution().toString())
    assert any("MapInArrow" in p for p in plans) and not any("FlatMapGroups" in p for p in plans)
