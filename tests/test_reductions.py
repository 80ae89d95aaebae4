import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import types as T
from tessera.functions.reductions import Kind, Unsupported, lookup, register, supported
from tessera.operators import algorithms as A
from tessera.operators.store import create_store, from_numpy, from_scalar

NUMPY = {Kind.ADD: np.add, Kind.MUL: np.multiply, Kind.MAX: np.maximum, Kind.MIN: np.minimum, Kind.OR: np.bitwise_or, Kind.AND: np.bitwise_and, Kind.XOR: np.bitwise_xor}


@pytest.mark.parametrize("kind", list(Kind))
@pytest.mark.parametrize("t", ["bool", "int8", "int32", "int64", "uint8", "uint32", "uint64", "float32", "float64", "complex64", "complex128"])
def test_kinds_and_types(spark, kind, t):
    t = T.primitive(t)
    if not supported(kind, t):
        with pytest.raises(Unsupported):
            lookup(kind, t)
        return
    rng = np.random.default_rng(1)
    a = rng.integers(1, 4, (4, 5)).astype(t.numpy) if t.name != "bool" else rng.random((4, 5)) < 0.5
    if t.is_complex:
        a = a + 1j * rng.integers(1, 3, (4, 5)).astype(t.numpy)
    start = np.ones(5, t.numpy)
    f = {Kind.ADD: np.logical_or, Kind.MAX: np.logical_or, Kind.OR: np.logical_or, Kind.XOR: np.logical_xor}.get(kind, np.logical_and) if t.name == "bool" else NUMPY[kind]
    want = start
    for row in a.astype(t.numpy):
        want = f(want, row)
    out = A.reduce(A.rows_of(from_numpy(spark, a.astype(t.numpy))), from_numpy(spark, start), kind).to_numpy()
    assert np.allclose(out.astype(want.dtype), want, rtol=1e-5)


def test_bits_of_large_unsigned_numbers(spark):
    a = np.array([[2**64 - 1, 2**63 + 5, 0], [2**40 + 1, 2**63 + 9, 2**64 - 2]], np.uint64)
    for kind in (Kind.OR, Kind.AND, Kind.XOR):
        r = lookup(kind, T.uint64)
        out = A.reduce(A.rows_of(from_numpy(spark, a)), create_store(spark, T.uint64, (3,)).fill(r.identity), kind).to_numpy()
        assert (out == NUMPY[kind].reduce(a)).all()


def test_fixtures(spark):
    five = from_numpy(spark, np.arange(1, 6))
    assert A.reduce(five, from_scalar(spark, 1), "plus").scalar() == 16
    rows = from_numpy(spark, np.repeat(np.arange(3), 4).reshape(3, 4))
    assert A.reduce(A.rows_of(rows), create_store(spark, T.int64, (4,)).fill(0), "plus").to_numpy().tolist() == [3, 3, 3, 3]
    assert A.reduce(A.columns_of(rows), create_store(spark, T.int64, (3,)).fill(0), "plus").to_numpy().tolist() == [0, 4, 8]
    square = lambda v: v * v
    assert A.transform_reduce(five, from_scalar(spark, 0), "plus", square).scalar() == 55
    assert A.transform_reduce(A.rows_of(rows), create_store(spark, T.int64, (4,)).fill(0), "plus", square).to_numpy().tolist() == [5, 5, 5, 5]
    assert A.transform_reduce2(five, five, from_scalar(spark, 0), "plus", lambda a, b: a * b).scalar() == 55
    assert A.reduce(five, from_scalar(spark, 100), "minus").scalar() == 85
    assert A.reduce(from_numpy(spark, np.array([2.0, 5.0])), from_scalar(spark, 100.0), "divides").scalar() == 10
    assert A.reduce(five, from_scalar(spark, 2), A.elementwise(lambda v: v) and "multiplies").scalar() == 240


def test_projections_and_empty_groups(spark):
    a = np.arange(24).reshape(2, 3, 4)
    s = from_numpy(spark, a)
    assert (A.reduce(A.projections_of(s, 0, 2), create_store(spark, T.int64, (3,)).fill(0), Kind.ADD).to_numpy() == a.sum((0, 2))).all()
    assert A.reduce(A.rows_of(from_numpy(spark, np.zeros((0, 3), np.int64))), create_store(spark, T.int64, (3,)).fill(9), Kind.MAX).to_numpy().tolist() == [9, 9, 9]
    assert A.reduce(from_numpy(spark, np.zeros(0)), from_scalar(spark, 2.5), Kind.ADD).scalar() == 2.5
    for bad in ((), (0, 1, 2), (3,), (0, 0)):
        with pytest.raises(ValueError):
            A.projections_of(s, *bad)
    with pytest.raises(ValueError):
        A.reduce(A.rows_of(s), create_store(spark, T.int64, (3, 3)).fill(0), Kind.ADD)
    with pytest.raises(Unsupported):
        A.reduce(from_numpy(spark, np.ones(3)), from_scalar(spark, 1.0), Kind.XOR)


def test_integer_products_are_exact_and_overflow_raises(spark):
    a = np.array([3] * 39)
    assert A.reduce(from_numpy(spark, a), from_scalar(spark, 1), Kind.MUL).scalar() == 3**39
    a = np.array([[-1, 2, 0, 1], [-1, 3, 2**40, 1], [-1, -1, 2**40, 1]])
    assert A.reduce(A.rows_of(from_numpy(spark, a)), create_store(spark, T.int64, (4,)).fill(1), Kind.MUL).to_numpy().tolist() == [-1, -6, 0, 1]
    assert A.reduce(from_numpy(spark, np.array([1, -1] * 500 + [7])), from_scalar(spark, 1), Kind.MUL).scalar() == 7
    with pytest.raises(Exception, match="(?i)overflow|range|precision|represent"):
        A.reduce(from_numpy(spark, np.array([3] * 500)), from_scalar(spark, 1), Kind.MUL).to_numpy()
    with pytest.raises(Exception, match="(?i)overflow|range"):
        A.reduce(from_numpy(spark, np.array([2**40, 2**40])), from_scalar(spark, 1), Kind.MUL).to_numpy()


def test_nan_is_largest(spark):
    a = from_numpy(spark, np.array([1.0, np.nan, 3.0]))
    assert np.isnan(A.reduce(a, from_scalar(spark, 0.0), Kind.MAX).scalar()) and A.reduce(a, from_scalar(spark, 9.0), Kind.MIN).scalar() == 1


def test_custom_reduction(spark):
    register("euclid", T.float64, lambda v: float(np.sqrt((v.astype(float) ** 2).sum())), 0.0)
    out = A.reduce(A.columns_of(from_numpy(spark, np.array([[3.0, 4.0], [6.0, 8.0]]))), create_store(spark, T.float64, (2,)).fill(0.0), "euclid")
    assert out.to_numpy().tolist() == [5, 10]
    with pytest.raises(ValueError):
        register("euclid", T.float64, max)


@pytest.mark.parametrize("n", [1, 2, 7])
def test_tree_reduce_and_distinct(spark, n):
    a = np.repeat(np.arange(50), 6)
    s = from_numpy(spark, a)
    s.root.df = s.root.df.repartition(n)
    assert A.tree_reduce(s, lambda v: v.drop_duplicates()).to_numpy().tolist() == list(range(50))
    assert A.tree_reduce(s, lambda v: v.drop_duplicates(), radix=2).shape == (50,)
    assert A.distinct(s).to_numpy().tolist() == list(range(50))
    with pytest.raises(ValueError):
        A.tree_reduce(from_numpy(spark, np.ones((2, 2))), lambda v: v)


def test_elementwise_algorithms(spark):
    a, b = np.arange(12.0).reshape(3, 4), np.ones((3, 4))
    x, y = from_numpy(spark, a), from_numpy(spark, b)
    A.for_each(lambda u, v: (u + v, u - v), x, y)
    assert (x.to_numpy() == a + b).all() and (y.to_numpy() == a - b).all()
    out = A.transform(x, create_store(spark, T.float64, (3, 4)), F.sqrt)
    assert np.allclose(out.to_numpy(), np.sqrt(a + b))
    part = x[1:, 1:3]
    A.for_each(lambda v: v * 0, part)
    assert x.to_numpy()[1:, 1:3].sum() == 0 and x.to_numpy()[0].sum() > 0
    arrays = spark.createDataFrame([([1, 2], [3, 4])], "a array<int>, b array<int>")
    assert arrays.select(A.elementwise(lambda u, v: u * v)(F.col("a"), F.col("b"))).first()[0] == [3, 8]
    assert [r.v for r in A.elements_of(from_numpy(spark, a.astype(int))).orderBy("i").collect()] == list(range(12))
    with pytest.raises(ValueError):
        A.transform(x, create_store(spark, T.float64, (4, 3)), F.sqrt)
    with pytest.raises(TypeError):
        A.as_typed(x, T.int64, 2)
