import numpy as np
import pytest

from tessera.functions import types as T
from tessera.operators.store import Store, Uninitialized, as_store, create_store, from_numpy, from_scalar, from_tiles

SHAPES = [(1, 3, 1), (3, 1, 3), (2, 64, 1), (100,), (3, 6, 9), (1, 2, 3, 4, 1, 2)]
EMPTY = [(1, 0, 3), (0, 0, 0), (10, 0), (0,)]


def numbers(shape, dtype=np.int64):
    return np.arange(int(np.prod(shape)), dtype=dtype).reshape(shape)


@pytest.mark.parametrize("shape", SHAPES + EMPTY)
def test_round_trip(spark, shape):
    a = numbers(shape)
    s = from_numpy(spark, a)
    assert s.shape == shape and s.ndim == len(shape) and s.volume == a.size and not s.unbound and not s.transformed
    assert (s.to_numpy() == a).all() and s.to_numpy().shape == shape


@pytest.mark.parametrize("dtype", ["?", "i1", "i2", "i4", "i8", "u1", "u2", "u4", "u8", "f2", "f4", "f8", "c8", "c16", "V5"])
def test_types_round_trip(spark, dtype):
    a = np.frombuffer(bytes(range(60)) * 8, "u1")
    d = np.dtype(dtype)
    a = (a % 2).astype(bool)[:20] if dtype == "?" else a[: 20 * d.itemsize].view(d) if d.kind in "iuV" else a[:20].astype(d)
    out = from_numpy(spark, a).to_numpy()
    assert out.dtype == d and (out == a).all()


@pytest.mark.parametrize(("value", "t"), [(True, T.bool_), (1 + 5j, T.complex128), (12.5, T.float16), (3.1415, T.float32), (0.7777777, T.float64), (10, T.int16), (-1, T.int8), (2**64 - 1, T.uint64), (4294967295, T.uint32), (b"abcdefghijklmnopqrstuvwxyz", T.binary_type(26))])
def test_scalars(spark, value, t):
    s = from_scalar(spark, value, t)
    assert s.has_scalar_storage and s.shape == (1,)
    got = s.scalar()
    assert bytes(got) == value if t.name == "binary" else got == t.numpy.type(value)


@pytest.mark.parametrize(("value", "t"), [(300, T.uint8), (-1, T.uint16), (2**31, T.int32), (1.5, T.int64), (b"abc", T.binary_type(2))])
def test_values_out_of_range(spark, value, t):
    with pytest.raises(ValueError):
        from_scalar(spark, value, t)


def test_compound_types(spark):
    p = T.point(2)
    s = create_store(spark, p, (2,)).fill((3, 4))
    assert s.to_numpy().tolist() == [(3, 4), (3, 4)]
    v = create_store(spark, T.array_type(T.int32, 3), (2,)).fill([1, 2, 3])
    assert v.to_numpy().shape == (2,) + () or v.df.first().v == [1, 2, 3]
    assert T.struct_type([T.int8, T.int64], align=True).size == 16 and T.struct_type([T.int8, T.int64]).size == 9
    with pytest.raises(ValueError):
        create_store(spark, T.string_type, (3,))
    with pytest.raises(ValueError):
        T.struct_type([T.string_type])
    with pytest.raises(ValueError):
        T.point(7)
    with pytest.raises(ValueError):
        create_store(spark, T.int64, (1,) * 7)


VIEWS = {
    "promote": (lambda s: s.promote(1, 4), lambda a: np.repeat(a[:, None], 4, 1)),
    "project": (lambda s: s.project(1, 2), lambda a: a[:, 2]),
    "slice": (lambda s: s.slice(2, slice(1, -2)), lambda a: a[:, :, 1:-2]),
    "empty slice": (lambda s: s.slice(0, slice(2, 1)), lambda a: a[2:1]),
    "transpose": (lambda s: s.transpose((2, 0, 1)), lambda a: a.transpose(2, 0, 1)),
    "delinearize": (lambda s: s.delinearize(2, (3, 2)), lambda a: a.reshape(3, 5, 3, 2)),
    "broadcast": (lambda s: s.slice(0, slice(1, 2)).broadcast(0, 3), lambda a: np.repeat(a[1:2], 3, 0)),
    "chain": (lambda s: s.transpose((1, 2, 0)).delinearize(1, (2, 3)).slice(0, slice(1, 4)).project(2, 1).promote(0, 2), lambda a: np.repeat(a.transpose(1, 2, 0).reshape(5, 2, 3, 3)[1:4, :, 1][None], 2, 0)),
    "index": (lambda s: s[1, 1:3, None, 2], lambda a: a[1, 1:3, None, 2]),
    "slices of slices": (lambda s: s[1:, 1:][1:, 1:3], lambda a: a[1:, 1:][1:, 1:3]),
}


@pytest.mark.parametrize("name", VIEWS)
def test_views(spark, name):
    a = numbers((3, 5, 6))
    view, same = VIEWS[name]
    out = view(from_numpy(spark, a))
    assert out.shape == same(a).shape and (out.to_numpy() == same(a)).all()


@pytest.mark.parametrize("name", [n for n in VIEWS if n not in ("promote", "broadcast", "chain")])
def test_fills_and_writes_through_views(spark, name):
    a = numbers((3, 5, 6))
    view, same = VIEWS[name]
    s = from_numpy(spark, a)
    other = s[1:]
    view(s).fill(-7)
    want = a.copy()
    same(want)[...] = -7
    assert (s.to_numpy() == want).all() and (other.to_numpy() == want[1:]).all()
    v = view(s)
    v.write(v.df.selectExpr(*[f"d{k}" for k in range(v.ndim)], "v - d0 as v"))
    new = same(want)
    new -= np.arange(new.shape[0]).reshape(-1, *[1] * (new.ndim - 1))
    assert (s.to_numpy() == want).all()


@pytest.mark.parametrize("bad", [
    lambda s: s.promote(4, 1), lambda s: s.promote(-1, 1), lambda s: s.project(3, 0), lambda s: s.project(0, 3), lambda s: s.slice(0, slice(0, 4)), lambda s: s.slice(3, slice(0, 1)), lambda s: s.slice(0, slice(0, 3, 2)),
    lambda s: s.transpose((0, 0, 1)), lambda s: s.transpose((0, 1)), lambda s: s.delinearize(2, (4, 2)), lambda s: s.broadcast(0, 2), lambda s: s.reinterpret_as(T.int32), lambda s: s.partition_by_tiling((0, 1, 1)), lambda s: s.partition_by_tiling((1, 1)),
    lambda s: s.partition_by_tiling((2, 2, 2)).get_child_store(2, 0, 0),
])
def test_what_is_no_view(spark, bad):
    with pytest.raises(ValueError):
        bad(from_numpy(spark, numbers((3, 5, 6))))


def test_partly_written_stores(spark):
    s = create_store(spark, T.int64, (4, 4))
    with pytest.raises(Uninitialized):
        s.df
    s[1:3, 1:3].fill(5)
    with pytest.raises(Uninitialized):
        s.to_numpy()
    assert (s[1:3, 1:3].to_numpy() == 5).all()
    s.fill(1)
    assert (s.to_numpy() == 1).all()


def test_unbound_stores(spark):
    s = create_store(spark, T.float64, ndim=2)
    assert s.unbound and s.ndim == 2
    with pytest.raises(ValueError):
        s.shape
    with pytest.raises(ValueError):
        s.fill(1.0)
    s.write(from_numpy(spark, np.ones((3, 2))).df)
    assert s.shape == (3, 2) and not s.unbound and (s.to_numpy() == 1).all()


def test_tiles_and_aliasing(spark):
    a = numbers((5, 7))
    tiles = [(a[:3, :4], (0, 0)), (a[:3, 4:], (0, 1)), (a[3:, :4], (1, 0)), (a[3:, 4:], (1, 1))]
    s = from_tiles(spark, (5, 7), (3, 4), T.int64, tiles)
    assert (s.to_numpy() == a).all()
    cut = s.partition_by_tiling((3, 4))
    assert cut.colors == (2, 2) and (cut.get_child_store(1, 1).to_numpy() == a[3:, 4:]).all()
    wide = s.partition_by_tiling((3, 4), (3, 3))
    assert wide.get_child_store(2, 2).volume == 0
    assert s[:2].equal_storage(s[3:]) and not s[:2].overlaps(s[3:]) and s[:4].overlaps(s[3:]) and not s.overlaps(from_numpy(spark, a))
    assert s[:2].transpose((1, 0)).overlaps(s.project(0, 1)) and not s.project(1, 3).overlaps(s.project(1, 4))
    with pytest.raises(ValueError):
        from_tiles(spark, (5, 7), (3, 4), T.int64, [(a[:2, :4], (0, 0))])


def test_bits_and_protocols(spark):
    a = np.array([1.5, -2.0, np.pi])
    s = from_numpy(spark, a)
    assert (s.reinterpret_as(T.int64).to_numpy() == a.view("i8")).all()
    assert (np.from_dlpack(s) == a).all() and (np.asarray(s) == a).all()
    assert (from_numpy(spark, memoryview(a)).to_numpy() == a).all()

    class Thing:
        def store_interface(self, version=1, n=1):
            return {"version": version, "data": {str(k): s for k in range(n)}}

    assert as_store(Thing()) is s
    for wrong, error in ((dict(version=2), NotImplementedError), (dict(n=2), ValueError)):
        t = Thing()
        t.store_interface = lambda wrong=wrong: Thing().store_interface(**wrong)
        with pytest.raises(error):
            as_store(t)
    with pytest.raises(TypeError):
        as_store(5)
    s.offload().offload("NONE").detach()
    with pytest.raises(Uninitialized):
        s.df


def test_full_slices_and_pushed_filters(spark):
    s = from_numpy(spark, numbers((4, 4)))
    assert s[:, :].view == s.view and not s[:2].transformed and s[1:].transformed
    plan = s[1:3].project(1, 2).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") <= 1 and isinstance(s, Store)
