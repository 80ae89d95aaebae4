import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import types as T
from tessera.functions.reductions import Kind, Unsupported
from tessera.operators import collectives, tasks
from tessera.operators.runtime import Machine, Runtime


@pytest.fixture(scope="module")
def runtime(spark):
    return Runtime(spark)


def test_operations(runtime):
    a = runtime.create_store_from_buffer(np.arange(6))
    b = runtime.create_store(T.int64, (6,))
    runtime.issue_fill(b, 7)
    runtime.issue_copy(b, a, Kind.ADD)
    assert b.to_numpy().tolist() == [7, 8, 9, 10, 11, 12]
    ind = np.zeros(6, T.point(1).numpy)
    ind["p0"] = [5, 4, 3, 2, 1, 0]
    ind = runtime.create_store_from_buffer(ind, T.point(1))
    runtime.issue_gather(b, a, ind)
    assert b.to_numpy().tolist() == [5, 4, 3, 2, 1, 0]
    runtime.issue_scatter(b, ind, a)
    assert b.to_numpy().tolist() == [5, 4, 3, 2, 1, 0]
    runtime.issue_scatter_gather(b, ind, a, ind)
    assert b.to_numpy().tolist() == [0, 1, 2, 3, 4, 5]
    assert runtime.tree_reduce(lambda v: v.head(1), a, radix=2).volume == 1
    assert [(s.to_numpy().tolist(), o) for s, o in runtime.batches(a, (4,))] == [([0, 1, 2, 3], (0,)), ([4, 5], (4,))]
    runtime.prefetch_bloated_instances(a.partition_by_tiling((2,)), (1,), (1,), initialize=True)
    runtime.issue_execution_fence(a, block=True)
    assert runtime.create_store_from_scalar(5).scalar() == 5
    assert runtime.create_store_from_tiles((2,), (2,), T.int64, [(np.array([1, 2]), (0,))]).to_numpy().tolist() == [1, 2]


def test_libraries_machine_and_callbacks(runtime, spark):
    lib = runtime.create_library("mine", {"size": 4})
    assert runtime.find_library("mine") is lib and runtime.tunable(lib, "size") == 4
    spark.conf.set("spark.tessera.mine.size", "9")
    assert runtime.tunable(lib, "size") == 9
    with pytest.raises(ValueError):
        runtime.create_library("mine")
    with pytest.raises(KeyError):
        runtime.find_library("yours")

    @tasks.task
    def f(x: tasks.InputStore):
        pass

    lib.register_task(f)
    with pytest.raises(ValueError):
        lib.register_task(f)
    assert lib.register_reduction_operator("least", T.float64, lambda v: float(v.min())) == "mine.least"
    m = runtime.machine
    assert m.count >= 1 and m.slice(0, 2).count == min(2, m.count) and (m & Machine(1, 1)).empty and runtime.node_count == 1
    assert not runtime.is_running_in_task()
    done = []
    other = Runtime(spark)
    other.add_shutdown_callback(lambda: done.append(1))
    other.add_shutdown_callback(lambda: done.append(2))
    other.finish()
    other.finish()
    assert done == [2, 1]
    with runtime.scope(provenance="here") as s:
        assert s.pieces >= 1
        runtime.raise_pending_exception()


def test_collectives(spark):
    df = spark.createDataFrame([(0, 1, 5.0), (0, 2, 6.0), (1, 0, 7.0), (2, 0, 8.0)], "rank int, to int, v double")
    assert collectives.all_gather(df, 3).count() == 12
    got = {(r["rank"], r.sender, r.v) for r in collectives.all_to_all(df).collect()}
    assert got == {(1, 0, 5.0), (2, 0, 6.0), (0, 1, 7.0), (0, 2, 8.0)}
    assert {(r["rank"], r.v) for r in collectives.all_reduce(df, 3, ["v"], Kind.ADD, T.float64).collect()} == {(k, 26.0) for k in range(3)}
    by = collectives.all_reduce(df.withColumn("k", F.col("to") % 2), 2, ["v"], Kind.MAX, T.float64, key="k")
    assert {(r["rank"], r.k, r.v) for r in by.collect()} == {(0, 1, 5.0), (1, 1, 5.0), (0, 0, 8.0), (1, 0, 8.0)}
    assert sorted(r["rank"] for r in collectives.barrier(df, 4).collect()) == [0, 1, 2, 3]
    with pytest.raises(Unsupported):
        collectives.all_reduce(df, 3, ["v"], Kind.XOR, T.float64)


def test_collectives_inside_tasks(spark):
    import numpy as np
    import pyarrow as pa

    from tessera.operators.collectives import launched_together

    def talk(c, rows):
        own = rows["x"].to_numpy()
        c.barrier()
        all_ = c.all_gather(own)
        mine = c.all_to_all([np.array([c.rank * 10 + k]) for k in range(c.size)])
        total = c.all_reduce(np.array([own.sum(), c.rank]), Kind.ADD)
        return pa.table({"rank": [c.rank], "sizes": [[len(a) for a in all_]], "mine": [[int(x[0]) for x in mine]], "total": [int(total[0])], "ranks": [int(total[1])]})

    df = spark.range(10).selectExpr("cast(case when id < 7 then id % 2 else 3 end as int) as rank", "id as x")
    got = sorted(launched_together(df, 4, talk, "rank long, sizes array<long>, mine array<long>, total long, ranks long").collect())
    assert [r["rank"] for r in got] == [0, 1, 2, 3]
    for k, r in enumerate(got):
        assert r.sizes == [4, 3, 0, 3] and r.mine == [10 * j + k for j in range(4)] and (r.total, r.ranks) == (45, 6)
