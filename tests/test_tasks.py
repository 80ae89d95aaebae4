import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import types as T
from tessera.functions.reductions import Kind
from tessera.operators import tasks as K
from tessera.operators.constraints import Hint
from tessera.operators.store import create_store, from_numpy
from tessera.streaming.scope import ExceptionMode, NotStreamable, Operation, ParallelPolicy, Scope, StreamingMode, fence, problem, profile_range, streamable_prefix, streaming_groups, timestamp


@pytest.fixture(params=[1, 64])
def scope(spark, request):
    """Tiny thresholds, so that small stores are cut too."""
    with Scope(spark, ParallelPolicy(threshold=request.param)) as s:
        yield s


@K.task
def add(x: K.InputStore, y: K.InputStore, out: K.OutputStore):
    out.array[:] = x.array + y.array


@K.task
def stats(c: K.TaskContext, x: K.InputStore, total: K.ReductionStore[Kind.ADD], most: K.ReductionStore[Kind.MAX], where: K.OutputStore, scale: int | None):
    total.array[0] += x.array.sum() * (scale or 1)
    most.array[0] = max(most.array[0], x.array.max())
    where.array[:] = c.task_index[0]


def test_aligned_inputs_and_outputs(spark, scope):
    a = np.arange(300.0).reshape(10, 30)
    out = create_store(spark, T.float64, (10, 30))
    add(from_numpy(spark, a), from_numpy(spark, a * 2), out)
    assert (out.to_numpy() == 3 * a).all()


def test_reductions_context_and_optional_scalars(spark, scope):
    a = np.arange(1, 501)
    total, most, where = create_store(spark, T.int64, (1,)).fill(1000), create_store(spark, T.int64, (1,)).fill(0), create_store(spark, T.int64, (500,))
    stats(from_numpy(spark, a), total, most, where, None)
    assert total.scalar() == 1000 + a.sum() and most.scalar() == 500
    w = where.to_numpy()
    assert (np.diff(w) >= 0).all() and len(set(w.tolist())) > 1


def test_constraints(spark, scope):
    @K.task(constraints=[K.bloat("x", "halo", (1,), (2,)), K.broadcast("table")])
    def f(x: K.InputStore, halo: K.InputStore, table: K.InputStore, out: K.OutputStore):
        first = out.origin[0] - halo.origin[0]
        for k in range(len(out.array)):
            out.array[k] = halo.array[max(0, first + k - 1) : first + k + 3].max() + table.array.sum()

    a, t = np.random.default_rng(1).random(200), np.ones((2, 2))
    x, out = from_numpy(spark, a), create_store(spark, T.float64, (200,))
    f(x, x, from_numpy(spark, t), out)
    assert np.allclose(out.to_numpy(), [a[max(0, k - 1) : k + 3].max() + 4 for k in range(200)])

    @K.task(constraints=[K.image("p", "data", Hint.NO_HINT)])
    def g(p: K.InputStore, data: K.InputStore, out: K.OutputStore):
        out.array[:] = data.array[p.array["p0"] - data.origin[0]]

    at = np.random.default_rng(2).integers(0, 50, 120)
    p = np.zeros(120, T.point(1).numpy)
    p["p0"] = at
    out = create_store(spark, T.float64, (120,))
    g(from_numpy(spark, p, T.point(1)), from_numpy(spark, a[:50]), out)
    assert (out.to_numpy() == a[at]).all()

    @K.task(constraints=[K.scale((3,), "small", "big")])
    def h(small: K.InputStore, big: K.InputStore, out: K.OutputStore):
        for k in range(len(small.array)):
            out.array[k] = big.array[3 * k : 3 * k + 3].sum()

    small, out = from_numpy(spark, np.zeros(60)), create_store(spark, T.float64, (60,))
    h(small, from_numpy(spark, a[:178]), out)
    assert np.allclose(out.to_numpy(), [a[:178][3 * k : 3 * k + 3].sum() for k in range(60)])

    @K.task(constraints=[K.min_extents("x", (90,))])
    def tiles(c: K.TaskContext, x: K.InputStore, n: K.ReductionStore[Kind.ADD]):
        n.array[0] += 1

    n = create_store(spark, T.int64, (1,)).fill(0)
    tiles(x, n)
    assert n.scalar() == 3


def test_unbound_outputs_join_up(spark, scope):
    @K.task
    def even(x: K.InputStore, out: K.OutputStore, rest: K.OutputStore):
        out.bind_data(x.array[x.array % 2 == 0])
        rest.bind_data(x.array[x.array % 2 == 1] * 1.0)

    a = np.random.default_rng(3).integers(0, 100, 333)
    out, rest = create_store(spark, T.int64, ndim=1), create_store(spark, T.float64, ndim=1)
    even(from_numpy(spark, a), out, rest)
    assert (out.to_numpy() == a[a % 2 == 0]).all() and (rest.to_numpy() == a[a % 2 == 1]).all()


def test_manual_tasks(spark):
    @K.task
    def swap(c: K.TaskContext, x: K.InputStore, out: K.OutputStore, by: int):
        out.array[:] = x.array * by + c.task_index[0]

    a = np.arange(12)
    m = K.ManualTask(swap, (4,))
    m.add_input("x", from_numpy(spark, a).partition_by_tiling((3,)), [K.dimension(0) * -1 + 3])
    out = create_store(spark, T.int64, (12,))
    m.add_output("out", out.partition_by_tiling((3,)))
    m.add_scalar("by", 10)
    m.execute()
    assert out.to_numpy().tolist() == [10 * v + c for c in range(4) for v in a[(3 - c) * 3 : (4 - c) * 3]]

    @K.task
    def count(x: K.InputStore, n: K.ReductionStore[Kind.ADD]):
        n.array[0] += x.array.sum()

    m, n = K.ManualTask(count, (2, 2)), create_store(spark, T.int64, (1,)).fill(0)
    m.add_input("x", from_numpy(spark, a))
    m.add_reduction("n", n)
    m.execute()
    assert n.scalar() == 4 * 66
    with pytest.raises(ValueError):
        m.add_output("out", out.partition_by_tiling((4,)))


def test_signatures():
    def a(x):
        pass

    def b(*x: int):
        pass

    def c(x: K.InputStore, ctx: K.TaskContext):
        pass

    def d(x: int | str):
        pass

    def e(x: K.ReductionStore):
        pass

    for f, error in ((a, TypeError), (b, NotImplementedError), (c, TypeError), (d, NotImplementedError), (e, TypeError)):
        with pytest.raises(error):
            K.task(f)
    with pytest.raises(ValueError):
        K.task(constraints=[K.align("x", "nothing")])(add.f)
    with pytest.raises(NotImplementedError):
        K.task(variants=("gpu",))(add.f)
    with pytest.raises(ValueError):
        K.broadcast("x", ())


def test_calls_are_checked_and_locked(spark):
    x = from_numpy(spark, np.zeros(4))
    for args in ((x, x), (x, x, 5), (x, 3, x)):
        with pytest.raises(TypeError):
            add(*args)
    with pytest.raises(ValueError):
        add(x, from_numpy(spark, np.zeros(5)), create_store(spark, T.float64, (4,)))
    with pytest.raises(TypeError):
        stats(x, x, x, x, "no number")
    call = add.prepare_call(x, x, create_store(spark, T.float64, (4,)))
    call.execute()
    with pytest.raises(RuntimeError):
        call.execute()
    with pytest.raises(RuntimeError):
        call.add_constraint(K.align("x", "y"))


def test_exception_modes(spark):
    @K.task(throws=True)
    def fails(x: K.InputStore, out: K.OutputStore):
        raise ArithmeticError("as planned")

    x = from_numpy(spark, np.zeros(4))
    with pytest.raises(Exception, match="as planned"):
        fails(x, create_store(spark, T.float64, (4,)))
    for mode in ExceptionMode:
        with Scope(spark, exceptions=mode) as s:
            if mode is ExceptionMode.IMMEDIATE:
                with pytest.raises(Exception, match="as planned"):
                    fails(x, create_store(spark, T.float64, (4,)))
            else:
                fails(x, create_store(spark, T.float64, (4,)))
                if mode is ExceptionMode.DEFERRED:
                    with pytest.raises(Exception, match="as planned"):
                        s.raise_pending_exception()
                s.raise_pending_exception()


def op(name, launch=(4,), reads=(), writes=(), reduces=(), pointwise=True, df=None):
    return Operation(name, df, launch, frozenset(reads), frozenset(writes), frozenset(reduces), pointwise)


def test_streaming_verdicts(spark):
    a, b = op("a", reads=[1], writes=[2]), op("b", reads=[2], writes=[3])
    assert problem([a], b) is None
    assert problem([op("r", reduces=[5])], op("x", reads=[5])) and problem([op("r", reduces=[5])], op("x", writes=[5])) and problem([op("r", reduces=[5])], op("x", reduces=[5]))
    assert problem([a], op("x", launch=(8,)))
    assert problem([a], op("x", reads=[2], pointwise=False)) and problem([op("x", reads=[9], pointwise=False)], op("y", writes=[9]))
    run = [a, b, op("r", reduces=[5]), op("c", reads=[5])]
    assert streamable_prefix(run) == 3 and [len(g) for g in streaming_groups(run)] == [3, 1]
    narrow, wide = spark.range(5).selectExpr("id + 1 as x"), spark.range(5).groupBy(F.expr("id % 2")).count()
    assert problem([], op("n", df=narrow)) is None and problem([], op("w", df=wide))
    with Scope(spark, ParallelPolicy(StreamingMode.STRICT, 4)) as s:
        s.submit(a)
        with pytest.raises(NotStreamable):
            s.submit(op("x", launch=(2,)))
        with pytest.raises(NotStreamable):
            s.flush()
    with Scope(spark, ParallelPolicy(StreamingMode.RELAXED)) as s:
        for o in run:
            s.submit(o)
    assert [len(g) for g in s.groups] == [3, 1]
    with pytest.raises(ValueError):
        ParallelPolicy(overdecompose=0)


def test_scopes_fences_and_clocks(spark):
    sc = spark.sparkContext
    with Scope(spark, provenance="outer", priority=3):
        with Scope(spark, provenance="inner"):
            assert sc.getLocalProperty("spark.job.description") == "inner"
        assert sc.getLocalProperty("spark.job.description") == "outer" and sc.getLocalProperty("spark.scheduler.pool") == "priority-3"
    assert sc.getLocalProperty("spark.job.description") is None
    with profile_range(spark, "here"):
        assert sc.getLocalProperty("spark.job.description") == "here"
    first = timestamp(spark, spark.range(3))
    fence(spark, spark.range(3), block=True)
    assert timestamp(spark, unit="us") >= first


def test_failures_of_one_launch_are_joined(spark):
    @K.task(throws=True)
    def picky(x: K.InputStore, out: K.OutputStore):
        if x.array[0] in (2, 6):
            raise ValueError(f"no {x.array[0]}")
        out.array[:] = x.array

    call = K.ManualTask(picky, (4,))
    x, out = from_numpy(spark, np.arange(8)), create_store(spark, T.int64, (8,))
    call.add_input("x", x.partition_by_tiling((2,)))
    call.add_output("out", out.partition_by_tiling((2,)))
    with pytest.raises(K.TaskFailures) as e:
        call.execute()
    assert e.value.failures == [((1,), "ValueError: no 2"), ((3,), "ValueError: no 6")] and e.value.total == 2
