import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import types as T
from tessera.operators import constraints as C
from tessera.operators.store import create_store, from_numpy
from tessera.plans import tiles


def cells(df, n, m=None):
    """{color: {coordinates: value}}"""
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[f"c{k}"] for k in range(n)), {})[tuple(r[f"d{k}"] for k in range(m or n))] = r.v
    return out


@pytest.mark.parametrize(("shape", "tile", "low", "high"), [((10,), (3,), (2,), (4,)), ((9, 9), (4, 2), (2, 3), (3, 4)), ((5, 5, 5), (2, 3, 5), (2, 3, 4), (4, 3, 2))])
@pytest.mark.parametrize("parts", [1, 7])
def test_bloat(spark, shape, tile, low, high, parts):
    a = np.arange(int(np.prod(shape))).reshape(shape)
    s = from_numpy(spark, a)
    s.root.df = s.root.df.repartition(parts)
    cut = s.partition_by_tiling(tile)
    got = cells(C.bloat(cut, s, low, high), len(shape))
    for color in np.ndindex(*cut.colors):
        box = [range(max(0, c * t - lo), min(n, (c + 1) * t + hi)) for c, t, n, lo, hi in zip(color, tile, shape, low, high)]
        assert got[color] == {at: a[at] for at in np.ndindex(*shape) if all(x in r for x, r in zip(at, box))}
    with pytest.raises(ValueError):
        C.bloat(cut, s, low[:-1], high)


@pytest.mark.parametrize(("func", "target"), [((9,), (100,)), ((4, 4), (10, 10)), ((2, 3, 4), (5, 5, 5))])
@pytest.mark.parametrize("hint", list(C.Hint))
@pytest.mark.parametrize("rects", [False, True])
def test_image(spark, func, target, hint, rects):
    rng, n = np.random.default_rng(1), len(target)
    lo = np.stack([rng.integers(0, m, func) for m in target], -1)
    hi = lo + rng.integers(-1, 3, lo.shape)
    t = T.rect(n) if rects else T.point(n)
    p = np.zeros(func, t.numpy)
    for at in np.ndindex(*func):
        p[at] = (tuple(lo[at]), tuple(hi[at])) if rects else tuple(lo[at])
    a = np.arange(int(np.prod(target))).reshape(target)
    cut = from_numpy(spark, p, t).partition_by_tiling((2,) * len(func))
    got = cells(C.image(cut, from_numpy(spark, a), hint), len(func), n)
    for color in np.ndindex(*cut.colors):
        inside = [at for at in np.ndindex(*func) if tuple(x // 2 for x in at) == color]
        boxes = [(lo[at], hi[at] if rects else lo[at]) for at in inside]
        boxes = [(x, y) for x, y in boxes if (x <= y).all()]
        if hint is not C.Hint.NO_HINT and boxes:
            if hint is C.Hint.FIRST_LAST and not rects:
                ends = [lo[min(inside)], lo[max(inside)]]
                boxes = [(np.minimum(*ends), np.maximum(*ends))]
            else:
                boxes = [(np.min([x for x, _ in boxes], 0), np.max([y for _, y in boxes], 0))]
        want = {at: a[at] for at in np.ndindex(*target) if any((x <= np.array(at)).all() and (np.array(at) <= y).all() for x, y in boxes)}
        assert got.get(color, {}) == want
    with pytest.raises(ValueError):
        C.image(from_numpy(spark, a).partition_by_tiling((2,) * n), from_numpy(spark, a))


@pytest.mark.parametrize(("factors", "small", "big"), [((3,), (10,), (29,)), ((4, 5), (2, 7), (10, 30)), ((2, 3, 4), (3, 2, 2), (5, 5, 5))])
def test_scale(spark, factors, small, big):
    a = np.arange(int(np.prod(big))).reshape(big)
    cut = create_store(spark, T.int8, small).partition_by_tiling((2,) * len(small))
    got = cells(C.scale(factors, cut, from_numpy(spark, a)), len(big))
    for color in np.ndindex(*cut.colors):
        box = [range(c * 2 * f, min((c + 1) * 2, n) * f) for c, f, n in zip(color, factors, small)]
        assert got.get(color, {}) == {at: a[at] for at in np.ndindex(*big) if all(x in r for x, r in zip(at, box))}
    with pytest.raises(ValueError):
        C.scale(factors[:-1], cut, from_numpy(spark, a))


def test_align_and_broadcast(spark):
    a = np.arange(24).reshape(4, 6)
    x, y = from_numpy(spark, a), from_numpy(spark, a * 2)
    both = C.zip_aligned(*C.align(x, y, pieces=4, threshold=1))
    assert both.where("v1 != 2 * v0").isEmpty() and both.count() == 24
    with pytest.raises(ValueError):
        C.align(x, from_numpy(spark, a[:3]))
    cut = x.partition_by_tiling((2, 3))
    assert all(len(v) == 24 for v in cells(C.broadcast(y, cut), 2).values())
    rows = cells(C.broadcast(y, cut, (1,)), 2)
    assert all({at[0] // 2 for at in v} == {c[0]} and len(v) == 12 for c, v in rows.items())
    with pytest.raises(ValueError):
        C.broadcast(y, cut, ())


@pytest.mark.parametrize("dim", [0, 1])
def test_stencil_in_tiles(spark, dim):
    a = np.random.default_rng(2).random((9, 11))
    got = C.stencil(from_numpy(spark, a), dim, 2, 1, F.max, tile=4)
    want = np.empty_like(a)
    for at in np.ndindex(9, 11):
        window = [slice(x, x + 1) for x in at]
        window[dim] = slice(max(0, at[dim] - 2), at[dim] + 2)
        want[at] = a[tuple(window)].max()
    rows = got.collect()
    assert len(rows) == 99 and all(r.v == want[r.d0, r.d1] for r in rows)


def test_tile_planner():
    assert tiles.launch_shape((10,), 8) == (1,)
    assert tiles.launch_shape((1 << 20,), 8) == (8,) and tiles.tile_shape((1 << 20,), (8,)) == (1 << 17,)
    assert tiles.launch_shape((1 << 10, 1 << 10), 16) == (4, 4)
    assert tiles.launch_shape((1 << 20, 8), 12) == (16, 1)
    for shape in ((1 << 33,), (3_000_001, 700), (5, 1 << 30)):  # a tile is bounded by its cells, whatever the number of tasks
        tile = tiles.tile_shape(shape, tiles.launch_shape(shape, 8))
        assert tiles.CELLS // 4 < np.prod(tile) <= tiles.CELLS
    assert tiles.tile_shape((100, 10), (10, 1), (30, 5)) == (30, 10)
    with pytest.raises(ValueError):
        tiles.tile_shape((100, 10), (10, 1), (30,))


@pytest.mark.parametrize("hint", [C.Hint.MIN_MAX, C.Hint.FIRST_LAST])
def test_boxes_of_one_slab_are_dealt_over_tasks(spark, hint):
    points = np.zeros(20_000, T.point(1).numpy)
    points["p0"] = np.random.default_rng(2).integers(0, 1000, len(points))
    ends = points["p0"].reshape(-1, 10)
    ends = ends[:, [0, -1]] if hint is C.Hint.FIRST_LAST else ends
    got = C.image(from_numpy(spark, points, T.point(1)).partition_by_tiling((10,)), from_numpy(spark, np.arange(1000)), hint)
    rows = [r["count"] for r in got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    assert sum(rows) == int((ends.max(1) - ends.min(1) + 1).sum())
    assert len(rows) > 2 and max(rows) < 0.75 * sum(rows), rows


def test_first_and_last_points_are_found_without_a_sort(spark):
    points = np.zeros((6, 5), T.point(1).numpy)
    points["p0"] = np.random.default_rng(3).integers(0, 20, points.shape)
    got = C.image(from_numpy(spark, points, T.point(1)).partition_by_tiling((4, 2)), from_numpy(spark, np.arange(20)), C.Hint.FIRST_LAST)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    for color, seen in cells(got, 2, 1).items():
        tile = points["p0"][color[0] * 4 : color[0] * 4 + 4, color[1] * 2 : color[1] * 2 + 2]
        a, b = sorted((tile[0, 0], tile[-1, -1]))
        assert sorted(seen) == [(x,) for x in range(a, b + 1)]
