"""Exchanges between the tasks of one launch: as shuffles, where rows have a rank (which task) and no task waits for another, and inside tasks
that run together."""

from __future__ import annotations

import base64
import io
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import types as T
from ..functions.reductions import Kind, Unsupported, lookup
from .store import grid


def _ranks(df: DataFrame, n: int) -> DataFrame:
    return grid(df.sparkSession, (n,)).selectExpr("cast(d0 as int) as rank")


def all_gather(df: DataFrame, n: int, rank: str = "rank") -> DataFrame:
    """rank, sender, and df's other columns: every task gets every task's rows."""
    own = df.withColumnRenamed(rank, "sender")
    return own.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rank"), "*")


def all_to_all(df: DataFrame, rank: str = "rank", to: str = "to") -> DataFrame:
    """rank, sender, and df's other columns: each row goes to the task that it names. Buffers of any sizes are runs of rows."""
    return df.withColumnRenamed(rank, "sender").withColumnRenamed(to, "rank")


def all_reduce(df: DataFrame, n: int, values: Sequence[str], kind: Kind | str, t: T.ElementType, key: str | None = None, rank: str = "rank") -> DataFrame:
    """rank, key and reduced values: every task gets the reduction over all tasks, element by element of a buffer numbered by `key`."""
    if isinstance(kind, Kind) and kind in (Kind.OR, Kind.AND, Kind.XOR) and (t.is_float or t.is_complex):
        raise Unsupported(f"no bitwise reduction of {t}")
    r = lookup(kind, t)
    own = df.groupBy(*([key] if key else [])).agg(*[r.aggregate(F.col(v)).alias(v) for v in values])
    return own.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rank"), "*")


def barrier(df: DataFrame, n: int) -> DataFrame:
    """rank: one row for each task, once all rows of df are there (an action's stages end before the next begin)."""
    done = df.agg(F.count("*").alias("_rows")).select((F.col("_rows") * 0).cast("int").alias("_zero"))  # one row
    return _ranks(df, n).withColumn("_zero", F.lit(0)).join(F.broadcast(done), "_zero").select("rank")


# --- inside the tasks of one launch ------------------------------------------------------------------------------------------

_UFUNC = {Kind.ADD: np.add, Kind.MUL: np.multiply, Kind.MAX: np.maximum, Kind.MIN: np.minimum, Kind.OR: np.bitwise_or, Kind.AND: np.bitwise_and, Kind.XOR: np.bitwise_xor}


class Communicator:
    """What a task of a joint launch talks through. Buffers go by way of the driver, so they are for small ones; rows go by all_to_all() above."""

    def __init__(self, context: BarrierTaskContext) -> None:
        self._context, self.rank, self.size = context, context.partitionId(), len(context.getTaskInfos())

    def barrier(self) -> None:
        self._context.barrier()

    def all_gather(self, value: np.ndarray) -> list[np.ndarray]:
        """Every task's buffer, in order of rank; they may differ in length."""
        return [x[0] for x in self._exchanged([value])]

    def all_to_all(self, values: Sequence[np.ndarray]) -> list[np.ndarray]:
        """values[k] goes to task k; what the tasks sent here comes back, in order of rank."""
        if len(values) != self.size:
            raise ValueError(f"{len(values)} buffers for {self.size} tasks")
        return [x[self.rank] for x in self._exchanged(values)]

    def all_reduce(self, value: np.ndarray, kind: Kind) -> np.ndarray:
        if kind in (Kind.OR, Kind.AND, Kind.XOR) and np.asarray(value).dtype.kind not in "biu":
            raise Unsupported(f"no bitwise reduction of {np.asarray(value).dtype}")
        return _UFUNC[kind].reduce(np.stack(self.all_gather(value)))

    def _exchanged(self, values: Sequence[np.ndarray]) -> list[list[np.ndarray]]:
        def written(x: np.ndarray) -> str:
            out = io.BytesIO()
            np.save(out, np.asarray(x), allow_pickle=False)
            return base64.b64encode(out.getvalue()).decode()

        said = self._context.allGather(json.dumps([written(x) for x in values]))
        return [[np.load(io.BytesIO(base64.b64decode(x)), allow_pickle=False) for x in json.loads(s)] for s in said]


def launched_together(df: DataFrame, n: int, f: Callable[[Communicator, pa.Table], pa.Table], schema: str, rank: str = "rank") -> DataFrame:
    """f(communicator, the rows of its rank) in n tasks that run at the same time (as many cores have to be free), as a barrier stage."""
    kind = df.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        yield from f(Communicator(BarrierTaskContext.get()), pa.Table.from_batches(own) if own else kind.empty_table()).to_batches()

    return df.repartitionById(n, F.col(rank).cast("int")).mapInArrow(run, schema, barrier=True)
