"""One place for what a program needs: libraries of tasks, reductions and tunables, the machine, and the operations on stores."""

from __future__ import annotations

import atexit
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext as SparkTaskContext
from pyspark.sql import SparkSession

from ..functions import reductions
from ..functions import types as T
from ..functions.reductions import Kind
from ..streaming.scope import Scope, current, fence
from . import algorithms, indirect, store
from .constraints import bloat
from .store import Store, TiledStore
from .tasks import AutoTask, ManualTask, Task


@dataclass(frozen=True)
class Machine:
    """The cores that a launch may use: a range of all there are."""

    low: int
    high: int

    @property
    def count(self) -> int:
        return max(0, self.high - self.low)

    @property
    def empty(self) -> bool:
        return not self.count

    def slice(self, start: int, stop: int) -> Machine:
        return Machine(min(self.low + start, self.high), min(self.low + stop, self.high))

    def __and__(self, other: Machine) -> Machine:
        return Machine(max(self.low, other.low), max(max(self.low, other.low), min(self.high, other.high)))


@dataclass
class Library:
    """A namespace."""

    name: str
    tasks: dict[str, Task] = field(default_factory=dict)
    reductions: set[str] = field(default_factory=set)
    tunables: dict[str, object] = field(default_factory=dict)

    def register_task(self, task: Task) -> Task:
        if task.__name__ in self.tasks:
            raise ValueError(f"task {task.__name__} is already in {self.name}")
        self.tasks[task.__name__] = task
        return task

    def register_reduction_operator(self, name: str, t: T.ElementType, fold: Callable[[np.ndarray], object], identity: object = None) -> str:
        full = reductions.register(f"{self.name}.{name}", t, fold, identity)
        self.reductions.add(full)
        return full


class Runtime:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.libraries: dict[str, Library] = {}
        self._callbacks: list[Callable[[], None]] = []
        self._finished = False
        atexit.register(self.finish)

    # libraries and the machine

    def create_library(self, name: str, tunables: dict[str, object] | None = None) -> Library:
        if name in self.libraries:
            raise ValueError(f"library {name} is already there")
        self.libraries[name] = Library(name, tunables=dict(tunables or {}))
        return self.libraries[name]

    def find_library(self, name: str) -> Library:
        if name not in self.libraries:
            raise KeyError(f"no library {name}")
        return self.libraries[name]

    def tunable(self, library: Library, name: str) -> object:
        """The session's setting `tessera.<library>.<name>`, else what the library says."""
        found = self.spark.conf.get(f"spark.tessera.{library.name}.{name}", None)
        return library.tunables[name] if found is None else type(library.tunables.get(name, ""))(found)

    @property
    def machine(self) -> Machine:
        return Machine(0, self.spark.sparkContext.defaultParallelism)

    @property
    def node_count(self) -> int:
        """Executors, or 1 in local mode."""
        return max(1, self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - (0 if self.spark.sparkContext.master.startswith("local[") else 1))

    @staticmethod
    def is_running_in_task() -> bool:
        return SparkTaskContext.get() is not None

    def finish(self) -> None:
        """Run the shutdown callbacks, the last one first; once."""
        if not self._finished:
            self._finished = True
            for f in reversed(self._callbacks):
                f()

    def add_shutdown_callback(self, f: Callable[[], None]) -> None:
        self._callbacks.append(f)

    # stores and operations

    def create_store(self, t: T.ElementType, shape: Sequence[int] | None = None, ndim: int = 1, optimize_scalar: bool = False) -> Store:
        return store.create_store(self.spark, t, shape, ndim, optimize_scalar)

    def create_store_from_scalar(self, value: object, t: T.ElementType | None = None, shape: Sequence[int] = (1,)) -> Store:
        return store.from_scalar(self.spark, value, t, shape)

    def create_store_from_buffer(self, array: object, t: T.ElementType | None = None) -> Store:
        return store.from_numpy(self.spark, array, t)

    def create_store_from_tiles(self, shape: Sequence[int], tile: Sequence[int], t: T.ElementType, tiles: Sequence[tuple[np.ndarray, Sequence[int]]]) -> Store:
        return store.from_tiles(self.spark, shape, tile, t, tiles)

    def issue_fill(self, lhs: Store, value: object) -> None:
        lhs.fill(value)

    def issue_copy(self, target: Store, source: Store, redop: Kind | str | None = None) -> None:
        indirect.copy(target, source, redop)

    def issue_gather(self, target: Store, source: Store, source_indirect: Store, redop: Kind | str | None = None) -> None:
        indirect.gather(target, source, source_indirect, redop)

    def issue_scatter(self, target: Store, target_indirect: Store, source: Store, redop: Kind | str | None = None) -> None:
        indirect.scatter(target, target_indirect, source, redop)

    def issue_scatter_gather(self, target: Store, target_indirect: Store, source: Store, source_indirect: Store, redop: Kind | str | None = None) -> None:
        indirect.scatter_gather(target, target_indirect, source, source_indirect, redop)

    def tree_reduce(self, task: Callable[[pd.Series], pd.Series], source: Store, radix: int = 4) -> Store:
        return algorithms.tree_reduce(source, task, radix)

    def create_auto_task(self, task: Task) -> AutoTask:
        return AutoTask(task)

    def create_manual_task(self, task: Task, launch: Sequence[int]) -> ManualTask:
        return ManualTask(task, tuple(launch))

    def prefetch_bloated_instances(self, source: TiledStore, low: Sequence[int], high: Sequence[int], initialize: bool = False) -> None:
        """A hint: keep tiles with their ghost cells at hand; with initialize, a store without values gets zeros first."""
        if initialize and source.store.root.df is None:
            source.store.fill(0)
        if self.machine.count > 1:
            bloat(source, source.store, low, high).persist()

    def issue_execution_fence(self, *stores: Store, block: bool = False) -> None:
        fence(self.spark, *[s.df for s in stores], block=block)

    issue_mapping_fence = issue_execution_fence

    def raise_pending_exception(self) -> None:
        if scope := current():
            scope.raise_pending_exception()

    def scope(self, **settings: object) -> Scope:
        return Scope(self.spark, **settings)

    def batches(self, s: Store, chunk: Sequence[int]) -> Iterator[tuple[Store, tuple[int, ...]]]:
        """(store, offsets) of one chunk after the other."""
        cut = s.partition_by_tiling(chunk)
        for color in np.ndindex(*cut.colors):
            yield cut.get_child_store(*color), tuple(c * t for c, t in zip(color, cut.tile))
