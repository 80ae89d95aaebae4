"""Algorithms over stores: fill, for_each, transform, reduce, transform_reduce, tree_reduce, and the views they run over.

Functions are given as functions of Columns, so they stay inside Spark's generated code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import types as T
from ..functions.reductions import Kind, lookup
from .indirect import fold_into
from .store import Store, coords, create_store


@dataclass(frozen=True)
class Range:
    """A store seen as a range of elements, of which each has the cells along all dimensions but `over`."""

    store: Store
    over: tuple[int, ...]

    @property
    def inner(self) -> tuple[int, ...]:
        return tuple(k for k in range(self.store.ndim) if k not in self.over)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.store.shape[k] for k in self.over)


def rows_of(store: Store) -> Range:
    return projections_of(store, 0)


def columns_of(store: Store) -> Range:
    return projections_of(store, 1)


def projections_of(store: Store, *dims: int) -> Range:
    if not dims or len(set(dims)) != len(dims) or len(dims) >= store.ndim or any(not 0 <= d < store.ndim for d in dims):
        raise ValueError(f"{dims} is no proper subset of {store.ndim} dimensions")
    return Range(store, tuple(dims))


def elements_of(store: Store) -> DataFrame:
    """i, v: the cells in C order."""
    place = "0"
    for k, n in enumerate(store.shape):
        place = f"({place}) * {n} + d{k}"
    return store.df.selectExpr(f"cast({place} as bigint) as i", "v")


def fill(out: Store, value: object) -> Store:
    return out.fill(value)


def for_each(f: Callable[..., Column | Sequence[Column]], *stores: Store) -> None:
    """Each cell of the store(s) becomes what f makes of the cells at that place: one column, or one for each store."""
    _alike(*stores)
    rows = _zip(*stores)
    new = f(*[F.col(f"v{k}") for k in range(len(stores))])
    new = [new] if isinstance(new, Column) else list(new)
    if len(new) != len(stores):
        raise ValueError(f"{len(new)} results for {len(stores)} stores")
    for s, c in zip(stores, new):
        _replace(s, rows.select(*coords(s.ndim), c.alias("v")))


def transform(source: Store, out: Store, op: Callable[[Column], Column]) -> Store:
    _alike(source, out)
    return _replace(out, source.df.select(*coords(out.ndim), op(F.col("v")).alias("v")))


def transform2(a: Store, b: Store, out: Store, op: Callable[[Column, Column], Column]) -> Store:
    _alike(a, b, out)
    return _replace(out, _zip(a, b).select(*coords(out.ndim), op(F.col("v0"), F.col("v1")).alias("v")))


def elementwise(op: Callable[..., Column]) -> Callable[..., Column]:
    """A function of elements as one of rows or tiles; in coordinate form they are the same, in array form it is mapped."""

    def lifted(*arrays: Column) -> Column:
        return F.transform(arrays[0], op) if len(arrays) == 1 else F.zip_with(*arrays, op)

    lifted.element = op
    return lifted


def reduce(source: Store | Range, init: Store, op: Kind | str) -> Store:
    """init ⊕ all elements of the range. A range over one dimension of a store of rank n needs an init of rank n - 1; init is changed and returned."""
    r = source if isinstance(source, Range) else Range(source, tuple(range(source.ndim)))
    reduction = lookup(getattr(op, "element", op), init.type)
    if r.store.type != init.type:
        raise ValueError(f"types {r.store.type} and {init.type} differ")
    if isinstance(source, Range):
        if tuple(r.store.shape[k] for k in r.inner) != init.shape:
            raise ValueError(f"an init of shape {init.shape} for elements of {tuple(r.store.shape[k] for k in r.inner)}")
    elif init.volume != 1:
        raise ValueError("a full reduction needs an init of one cell")
    return fold_into(init, _elements(r, init), reduction)


def _elements(r: Range, init: Store, value: Column | None = None) -> DataFrame:
    v = (F.col("v") if value is None else value).alias("v")
    if r.inner:
        return r.store.df.select(*[F.col(f"d{d}").alias(f"d{k}") for k, d in enumerate(r.inner)], v)
    return r.store.df.select(*[F.lit(0).cast("long").alias(c) for c in coords(init.ndim)], v)


def transform_reduce(source: Store | Range, init: Store, op: Kind | str, f: Callable[[Column], Column]) -> Store:
    """reduce over f of the elements, in one pass."""
    r = source if isinstance(source, Range) else Range(source, tuple(range(source.ndim)))
    return fold_into(init, _elements(r, init, f(F.col("v")).cast(init.type.spark)), lookup(op, init.type))


def transform_reduce2(a: Store, b: Store, init: Store, op: Kind | str, f: Callable[[Column, Column], Column]) -> Store:
    """reduce over f of two stores' cells at the same place, e.g. a dot product."""
    _alike(a, b)
    rows = _zip(a, b).select(*[F.lit(0).cast("long").alias(c) for c in coords(init.ndim)], f(F.col("v0"), F.col("v1")).cast(init.type.spark).alias("v"))
    return fold_into(init, rows, lookup(op, init.type))


def tree_reduce(source: Store, task: Callable[[pd.Series], pd.Series], radix: int = 4) -> Store:
    """A store of unknown length from a task that makes a few values of many: first of each batch of rows, then of the results of
    `radix` parts at a time."""
    if source.ndim != 1:
        raise ValueError("tree_reduce works on stores of rank 1")
    if radix < 2:
        raise ValueError("radix has to be 2 or more")
    kind = source.type.spark
    rows = source.df.select("v")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for rows in batches:
            yield pd.DataFrame({"part": part, "v": task(rows.v).to_numpy()})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": int(rows.part.iloc[0]) // radix, "v": task(rows.v).to_numpy()})

    n = max(1, rows.rdd.getNumPartitions())
    out = rows.mapInPandas(first, f"part int, v {kind}")
    while True:
        out = out.groupBy((F.floor(F.col("part") / radix) * radix).cast("int").alias("part")).applyInPandas(run, f"part int, v {kind}")
        n = -(-n // radix)
        if n <= 1:
            break
    made = create_store(source.spark, source.type, ndim=1)
    return made.write(_numbered(out.select("v")))


def distinct(source: Store) -> Store:
    """The values that occur, in order: a set found in two phases, then numbered by ranges."""
    made = create_store(source.spark, source.type, ndim=1)
    return made.write(_numbered(source.df.select("v").distinct()))


def _numbered(df: DataFrame) -> DataFrame:
    """d0, v in order of v, without bringing all rows into one task: ranges are sorted by themselves, and counted before numbering."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, "v").sortWithinPartitions("v").select(F.monotonically_increasing_id().alias("id"), "v")
    ranged = ranged.persist()
    sizes = {r.part: r.n for r in ranged.groupBy(F.shiftright("id", 33).cast("int").alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    first = F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)]) if starts else F.create_map(F.lit(0), F.lit(0))
    return ranged.select((F.element_at(first, F.shiftright("id", 33).cast("int")) + F.col("id").bitwiseAND((1 << 33) - 1)).cast("long").alias("d0"), "v")


def bounding_boxes(points: DataFrame, by: Sequence[str], point: str, rank: int, rects: bool = False) -> DataFrame:
    """by..., lo0, hi0, ...: the smallest box around each group's points, or rectangles (empty ones don't count)."""
    lo, hi = (f"{point}.lo.p{{}}", f"{point}.hi.p{{}}") if rects else (f"{point}.p{{}}",) * 2
    rows = points.where(" and ".join(f"{lo.format(k)} <= {hi.format(k)}" for k in range(rank))) if rects else points
    each = [x for k in range(rank) for x in (F.min(F.col(lo.format(k))).alias(f"lo{k}"), F.max(F.col(hi.format(k))).alias(f"hi{k}"))]
    return rows.groupBy(*by).agg(*each)


def sizes_to_ranges(sizes: DataFrame, key: str, size: str, parts: int | None = None) -> DataFrame:
    """key, lo, hi (inclusive) of consecutive runs with the given sizes, in order of key: partial sums of ranges of keys, then sums within."""
    from pyspark.sql import Window

    n = parts or int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sizes.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()).persist()
    totals = {r.part: r.n for r in ranged.groupBy("part").agg(F.sum("size").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(totals):
        before[p], total = total, total + totals[p]
    start = F.element_at(F.create_map(*[F.lit(x) for p, s in before.items() for x in (p, s)]), F.col("part")) if before else F.lit(0)
    end = start + F.sum("size").over(Window.partitionBy("part").orderBy("key"))
    return ranged.select(F.col("key").alias(key), (end - F.col("size")).cast("long").alias("lo"), (end - 1).cast("long").alias("hi"))


def ranges_to_sizes(ranges: DataFrame, key: str) -> DataFrame:
    return ranges.select(key, F.greatest(F.col("hi") - F.col("lo") + 1, F.lit(0)).cast("long").alias("size"))


def as_typed(store: Store, t: T.ElementType, ndim: int) -> Store:
    if store.type != t or store.ndim != ndim:
        raise TypeError(f"a store of {store.type} and rank {store.ndim} is none of {t} and rank {ndim}")
    return store


def _alike(*stores: Store) -> None:
    if len({s.shape for s in stores}) != 1:
        raise ValueError("the stores differ in shape")


def _zip(*stores: Store) -> DataFrame:
    out = None
    for k, s in enumerate(stores):
        own = s.df.withColumnRenamed("v", f"v{k}")
        out = own if out is None else out.join(own, coords(s.ndim))
    return out


def _replace(s: Store, rows: DataFrame) -> Store:
    return s.replace(rows) if s.writes_all() else s.write(rows)
