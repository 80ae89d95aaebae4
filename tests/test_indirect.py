import numpy as np
import pytest

from tessera.functions import types as T
from tessera.functions.reductions import Kind
from tessera.operators import indirect as I
from tessera.operators.store import create_store, from_numpy, from_scalar

CASES = [((5,), (7, 11), np.int64), ((3, 7), (3, 2, 5), np.uint32), ((2, 5, 4), (5,), np.float64), ((4, 5), (10, 11), np.int32), ((6, 6, 6), (20, 9), np.float32)]


def points(rng, shape, within, unique=False):
    n, size = int(np.prod(shape)), int(np.prod(within))
    flat = rng.permutation(size)[:n] if unique else rng.integers(0, size, n)
    at = np.unravel_index(flat, within)
    out = np.zeros(n, T.point(len(within)).numpy)
    for k, x in enumerate(at):
        out[f"p{k}"] = x
    return out.reshape(shape), tuple(x.reshape(shape) for x in at)


def stored(spark, p):
    return from_numpy(spark, p, T.point(len(p.dtype.names)))


@pytest.mark.parametrize(("ind", "src", "dtype"), CASES)
def test_gather(spark, ind, src, dtype):
    rng = np.random.default_rng(1)
    a = (np.arange(int(np.prod(src))) + 1).reshape(src).astype(dtype)
    p, at = points(rng, ind, src)
    target = create_store(spark, T.of_dtype(dtype), ind)
    assert (I.gather(target, from_numpy(spark, a), stored(spark, p)).to_numpy() == a[at]).all()
    old = np.ones(ind, dtype)
    assert (I.gather(from_numpy(spark, old), from_numpy(spark, a), stored(spark, p), Kind.ADD).to_numpy() == old + a[at]).all()


@pytest.mark.parametrize(("ind", "into", "dtype"), [c for c in CASES if np.prod(c[0]) <= np.prod(c[1])])
def test_scatter(spark, ind, into, dtype):
    rng = np.random.default_rng(2)
    p, at = points(rng, ind, into, unique=True)
    a, old = (np.arange(int(np.prod(ind))) + 1).reshape(ind).astype(dtype), np.full(into, 3, dtype)
    want = old.copy()
    want[at] = a
    assert (I.scatter(from_numpy(spark, old), stored(spark, p), from_numpy(spark, a), check=True).to_numpy() == want).all()


def test_scatter_with_reduction_and_repeated_points(spark):
    rng = np.random.default_rng(3)
    p, at = points(rng, (40,), (4, 3))
    a, old = np.arange(40), np.full((4, 3), 100)
    want = old.copy()
    np.add.at(want, at, a)
    assert (I.scatter(from_numpy(spark, old), stored(spark, p), from_numpy(spark, a), Kind.ADD).to_numpy() == want).all()
    with pytest.raises(I.DuplicatePoints):
        I.scatter(from_numpy(spark, old), stored(spark, p), from_numpy(spark, a), check=True)
    want = old.copy()
    for k in range(40):
        want[at[0][k], at[1][k]] = a[k]
    assert (I.scatter(from_numpy(spark, old), stored(spark, p), from_numpy(spark, a)).to_numpy() == want).all()


@pytest.mark.parametrize("redop", [None, Kind.MAX, Kind.ADD])
def test_scatter_gather(spark, redop):
    rng = np.random.default_rng(4)
    tp, ta = points(rng, (6,), (5, 5), unique=True)
    sp, sa = points(rng, (6,), (9,))
    a, old = rng.integers(0, 50, 9), rng.integers(0, 50, (5, 5))
    want = old.copy()
    want[ta] = a[sa] if redop is None else np.maximum(old[ta], a[sa]) if redop is Kind.MAX else old[ta] + a[sa]
    assert (I.scatter_gather(from_numpy(spark, old), stored(spark, tp), from_numpy(spark, a), stored(spark, sp), redop).to_numpy() == want).all()


def test_empty_indirections_and_points_outside(spark):
    old = np.arange(70).reshape(7, 10)
    empty = np.zeros((0, 0), T.point(2).numpy)
    source = from_numpy(spark, np.zeros((0, 0), np.int64))
    assert (I.scatter(from_numpy(spark, old), stored(spark, empty), source, Kind.ADD).to_numpy() == old).all()
    p = np.array([(9, 9), (-1, 0), (1, 1)], T.point(2).numpy)
    got = I.scatter(from_numpy(spark, old), stored(spark, p), from_numpy(spark, np.array([5, 6, 7]))).to_numpy()
    assert got[1, 1] == 7 and (np.delete(got.reshape(-1), 11) == np.delete(old.reshape(-1), 11)).all()
    got = I.gather(from_numpy(spark, np.array([-1, -2, -3])), from_numpy(spark, old), stored(spark, p)).to_numpy()
    assert got.tolist() == [-1, -2, 11]


def test_copies(spark):
    a, b = np.ones((1, 3, 1)), np.zeros((1, 3, 1))
    assert (I.copy(from_numpy(spark, a), from_numpy(spark, b), Kind.ADD).to_numpy() == 1).all()
    assert (I.copy(create_store(spark, T.float64, (3, 3)), from_numpy(spark, np.full((3, 3), 2.0))).to_numpy() == 2).all()
    assert (I.copy(from_numpy(spark, np.full((3, 3), 4)), from_numpy(spark, np.full((3, 3), 2)), Kind.MUL).to_numpy() == 8).all()
    s = from_numpy(spark, np.zeros((4, 4)))
    I.copy(s[:2, :2], from_numpy(spark, np.ones((2, 2))))
    assert s.to_numpy().sum() == 4


def test_what_is_refused(spark):
    a, p1 = from_numpy(spark, np.arange(6)), stored(spark, np.zeros(6, T.point(1).numpy))
    two = stored(spark, np.zeros(6, T.point(2).numpy))
    bad = [
        lambda: I.copy(a, from_numpy(spark, np.arange(5))), lambda: I.copy(a, from_numpy(spark, np.ones(6))), lambda: I.copy(a[1:], a[:5]), lambda: I.copy(create_store(spark, T.int64), a),
        lambda: I.copy(from_scalar(spark, 1), from_scalar(spark, 2), Kind.ADD), lambda: I.gather(a, a, two), lambda: I.gather(a, a, a), lambda: I.gather(from_numpy(spark, np.arange(5)), a, p1),
        lambda: I.scatter(a, p1, from_numpy(spark, np.arange(5))), lambda: I.scatter(from_numpy(spark, np.ones(6)), p1, a), lambda: I.gather(from_numpy(spark, np.ones(6)), from_numpy(spark, np.ones(6)), p1, Kind.XOR), lambda: I.gather(a, a[1:], p1),
    ]
    for f in bad:
        with pytest.raises(ValueError):
            f()
