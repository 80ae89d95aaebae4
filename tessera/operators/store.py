"""Stores: dense n-dimensional arrays as DataFrames with a row for each coordinate (d0, d1, ... bigint, v).

A Store is a handle: a root, which has the current version of the data, and a view, which says in SQL expressions where its cells lie in the
root. Reading a view is a projection and a filter over the root that Catalyst merges; writing through a view makes a new version of the root,
which every other view of that root then sees. Nothing runs before an action.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import types as T
from ..functions.sql import literal

_ids = itertools.count()


class Uninitialized(ValueError):
    """Cells without a value were read."""


def coords(n: int) -> list[str]:
    return [f"d{k}" for k in range(n)]


@dataclass
class Root:
    spark: SparkSession
    type: T.ElementType
    shape: tuple[int, ...] | None
    rank: int
    df: DataFrame | None = None
    scalar: bool = False
    version: int = 0
    id: int = field(default_factory=lambda: next(_ids))
    partial: bool = False  # some cells may have no value
    read: Callable[[list[tuple[int, int]]], DataFrame] | None = None  # for arrays in files: the rows of the chunks that a box meets

    def put(self, df: DataFrame) -> None:
        self.df, self.version, self.read = df, self.version + 1, None


@dataclass(frozen=True)
class View:
    """shape; axes: for each view dimension SQL over the root's coordinates, or None where a value repeats along it; where: conditions on
    the root's coordinates; back: the root's coordinates in terms of the view's, as templates over {0}, {1}, ..."""

    shape: tuple[int, ...]
    axes: tuple[str | None, ...]
    where: tuple[str, ...]
    back: tuple[str, ...]
    moved: bool = False

    @staticmethod
    def whole(shape: tuple[int, ...]) -> View:
        return View(shape, tuple(coords(len(shape))), (), tuple(f"{{{k}}}" for k in range(len(shape))))

    def renumbered(self, new: dict[int, str]) -> tuple[str, ...]:
        """back with each view dimension replaced by a template over the new ones."""
        return tuple(b.format(*[new[k] for k in range(len(self.shape))]) for b in self.back)


class Store:
    def __init__(self, root: Root, view: View | None) -> None:
        self.root, self._view = root, view

    # --- what it is ----------------------------------------------------------------------------------------------------

    @property
    def view(self) -> View:
        """An unbound store has a view, and a shape, once it is written; finding the shape is an action."""
        if self._view is None:
            if self.root.shape is None:
                if self.root.df is None:
                    raise ValueError("an unbound store has no shape before it is written")
                top = self.root.df.agg(*[F.max(c) for c in coords(self.root.rank)]).first()
                self.root.shape = tuple(0 if x is None else x + 1 for x in top)
            self._view = View.whole(self.root.shape)
        return self._view

    @property
    def spark(self) -> SparkSession:
        return self.root.spark

    @property
    def type(self) -> T.ElementType:
        return self.root.type

    @property
    def shape(self) -> tuple[int, ...]:
        return self.view.shape

    extents = shape

    @property
    def ndim(self) -> int:
        return self.root.rank if self._view is None else len(self.view.shape)

    @property
    def volume(self) -> int:
        return math.prod(self.shape)

    size = volume

    @property
    def unbound(self) -> bool:
        return self._view is None and self.root.shape is None

    @property
    def transformed(self) -> bool:
        return self._view is not None and self._view.moved

    @property
    def has_scalar_storage(self) -> bool:
        return self.root.scalar

    def equal_storage(self, other: Store) -> bool:
        return self.root is other.root

    def overlaps(self, other: Store) -> bool:
        """Whether some root cell is in both views; decided from bounds, so views with gaps may count as overlapping."""
        if self.root is not other.root:
            return False
        if not self.volume or not other.volume:
            return False
        return all(a[0] <= b[1] and b[0] <= a[1] for a, b in zip(self._bounds(), other._bounds()))

    def _bounds(self) -> list[tuple[int, int]]:
        """Least and largest root coordinate on each root dimension."""
        out = []
        for b in self.view.back:
            ends = [eval(b.format(*at), {"__builtins__": {}}) for at in itertools.product(*[(0, n - 1) for n in self.shape])]  # noqa: S307  our own arithmetic
            out.append((min(ends), max(ends)))
        return out

    # --- reading ----------------------------------------------------------------------------------------------------------

    @property
    def df(self) -> DataFrame:
        """d0, ..., v. A repeated axis is made by exploding its range."""
        if self.root.df is None:
            raise Uninitialized("the store has never been written")
        if self._view is None and self.root.shape is None:
            return self.root.df
        v = self.view
        out = self.root.read(self._bounds()) if self.root.read and v.where and self.volume else self.root.df
        for w in v.where:
            out = out.where(w)
        out = out.selectExpr(*[f"{a} as d{k}" if a is not None else f"cast(null as bigint) as d{k}" for k, a in enumerate(v.axes)], "v")
        for k, (a, n) in enumerate(zip(v.axes, v.shape)):
            if a is None:
                out = out.withColumn(f"d{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))) if n else out.where("false").withColumn(f"d{k}", F.lit(0).cast("long"))
        return out

    def to_numpy(self) -> np.ndarray:
        """All cells on the driver; raises if some have no value."""
        out = np.zeros(self.shape, self.type.numpy)
        rows = self.df.toArrow()
        if rows.num_rows != self.volume:
            raise Uninitialized(f"{self.volume - rows.num_rows} of {self.volume} cells have no value")
        if rows.num_rows:
            out[tuple(rows[c].to_numpy() for c in coords(self.ndim))] = _from_arrow(rows["v"], self.type)
        return out

    def scalar(self) -> object:
        if self.volume != 1:
            raise ValueError("not a store of one cell")
        return self.to_numpy().reshape(-1)[0]

    def __dlpack__(self, **kind: object) -> object:
        return self.to_numpy().__dlpack__(**kind)

    def __dlpack_device__(self) -> tuple[int, int]:
        return (1, 0)

    def __array__(self, dtype: object = None, copy: bool | None = None) -> np.ndarray:
        out = self.to_numpy()
        return out if dtype is None else out.astype(dtype)

    # --- views --------------------------------------------------------------------------------------------------------

    def _dim(self, dim: int, most: int | None = None) -> int:
        if not 0 <= dim < (self.ndim if most is None else most):
            raise ValueError(f"dimension {dim} of a store of rank {self.ndim}")
        return dim

    def promote(self, extra_dim: int, dim_size: int) -> Store:
        """A new dimension along which values repeat."""
        k, v = self._dim(extra_dim, self.ndim + 1), self.view
        if dim_size < 0 or self.ndim + 1 > T.MAX_DIM:
            raise ValueError("invalid promotion")
        new = {i: f"{{{i + (i >= k)}}}" for i in range(self.ndim)}
        return Store(self.root, View((*v.shape[:k], dim_size, *v.shape[k:]), (*v.axes[:k], None, *v.axes[k:]), v.where, v.renumbered(new), True))

    def project(self, dim: int, index: int) -> Store:
        k, v = self._dim(dim), self.view
        if not 0 <= index < v.shape[k]:
            raise ValueError(f"index {index} is outside of {v.shape[k]}")
        new = {i: str(index) if i == k else f"{{{i - (i > k)}}}" for i in range(self.ndim)}
        where = v.where if v.axes[k] is None else (*v.where, f"{v.axes[k]} = {index}")
        return Store(self.root, View(v.shape[:k] + v.shape[k + 1 :], v.axes[:k] + v.axes[k + 1 :], where, v.renumbered(new), True))

    def broadcast(self, dim: int, dim_size: int) -> Store:
        k, v = self._dim(dim), self.view
        if v.shape[k] != 1:
            raise ValueError("only a dimension of extent 1 can be broadcast")
        new = {i: "0" if i == k else f"{{{i}}}" for i in range(self.ndim)}
        return Store(self.root, View((*v.shape[:k], dim_size, *v.shape[k + 1 :]), (*v.axes[:k], None, *v.axes[k + 1 :]), v.where, v.renumbered(new), True))

    def slice(self, dim: int, bounds: slice) -> Store:
        """Bounds as in Python, without a step: negative ones count from the end, start >= stop is empty, what lies outside raises."""
        k, v = self._dim(dim), self.view
        if bounds.step not in (None, 1):
            raise ValueError("slices have no step")
        n = v.shape[k]
        start, stop = (d if b is None else b + n if b < 0 else b for b, d in ((bounds.start, 0), (bounds.stop, n)))
        if start >= stop:
            start = stop = 0
        elif start < 0 or stop > n:
            raise ValueError(f"slice {bounds} is out of bounds for extent {n}")
        if (start, stop) == (0, n):
            return Store(self.root, v)
        shape = (*v.shape[:k], stop - start, *v.shape[k + 1 :])
        new = {i: f"({{{i}}} + {start})" if i == k and start else f"{{{i}}}" for i in range(self.ndim)}
        where, axes = v.where, list(v.axes)
        if axes[k] is not None:
            where = (*where, f"{axes[k]} >= {start}", f"{axes[k]} < {stop}")
            axes[k] = f"({axes[k]} - {start})" if start else axes[k]
        elif stop == start:
            where = (*where, "false")
        return Store(self.root, View(shape, tuple(axes), where, v.renumbered(new), v.moved or start > 0))

    def transpose(self, axes: Sequence[int]) -> Store:
        v = self.view
        if sorted(axes) != list(range(self.ndim)):
            raise ValueError(f"{axes} is no permutation of {self.ndim} dimensions")
        new = {a: f"{{{i}}}" for i, a in enumerate(axes)}
        return Store(self.root, View(tuple(v.shape[a] for a in axes), tuple(v.axes[a] for a in axes), v.where, v.renumbered(new), True))

    def delinearize(self, dim: int, sizes: Sequence[int]) -> Store:
        """One dimension as several, the last one fastest."""
        k, v, m = self._dim(dim), self.view, len(sizes)
        if math.prod(sizes) != v.shape[k] or self.ndim - 1 + m > T.MAX_DIM:
            raise ValueError(f"sizes {tuple(sizes)} don't make extent {v.shape[k]}")
        strides = [math.prod(sizes[j + 1 :]) for j in range(m)]
        if v.axes[k] is None:
            axes: tuple[str | None, ...] = (None,) * m
        else:
            axes = tuple(f"(({v.axes[k]} div {s}) % {n})" if n else "cast(0 as bigint)" for s, n in zip(strides, sizes))
        new = {i: f"{{{i if i < k else i + m - 1}}}" for i in range(self.ndim)}
        new[k] = "(" + " + ".join(f"{{{k + j}}} * {s}" for j, s in enumerate(strides)) + ")"
        return Store(self.root, View((*v.shape[:k], *sizes, *v.shape[k + 1 :]), (*v.axes[:k], *axes, *v.axes[k + 1 :]), v.where, v.renumbered(new), True))

    def reinterpret_as(self, t: T.ElementType) -> Store:
        """The same bits as another type of the same size and alignment: a copy, as Spark has no cast of bits."""
        old = self.type
        if t.size != old.size or t.alignment != old.alignment:
            raise ValueError(f"{old} and {t} differ in size or alignment")

        def run(batches):
            for b in batches:
                bits = np.ascontiguousarray(_from_arrow(b.column("v"), old)).view(t.numpy)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _to_arrow(bits, t)], names=b.schema.names)

        names = coords(self.ndim)
        out = self.df.mapInArrow(run, ", ".join([*(f"{c} bigint" for c in names), f"v {t.spark}"]))
        return Store(Root(self.spark, t, self.shape, self.ndim, out, self.root.scalar), None)

    def __getitem__(self, key: object) -> Store:
        """A slice cuts, an int projects, None promotes; each works on the dimension that has come up in the result so far."""
        out, k = self, 0
        for x in key if isinstance(key, tuple) else (key,):
            if x is None:
                out = out.promote(k, 1)
            elif isinstance(x, slice):
                out = out.slice(k, x)
            elif isinstance(x, (int, np.integer)):
                out = out.project(k, int(x) + (out.shape[k] if x < 0 else 0))
                k -= 1
            else:
                raise TypeError(f"{type(x).__name__} is no index")
            k += 1
        return out

    # --- writing ------------------------------------------------------------------------------------------------------------

    def fill(self, value: object) -> Store:
        """Every cell of the view gets the value (or that of a store of one cell)."""
        if self.unbound:
            raise ValueError("an unbound store can't be filled")
        if isinstance(value, Store):
            if value.volume != 1 or value.type != self.type:
                raise ValueError("the fill value has to be a store of one cell of the same type")
            one = value.df.select(F.lit(0).alias("one"), F.col("v").alias("fill"))  # one row
            base = self._base().withColumn("one", F.lit(0)).join(F.broadcast(one), "one").drop("one")
            new = "fill"
        else:
            base, new = self._base(), literal(value, self.type)
        inside = " and ".join(f"({w})" for w in self.view.where) or "true"
        old = f"cast(null as {self.type.spark})" if self.root.df is None else "v"
        out = base.selectExpr(*coords(self.root.rank), f"case when {inside} then {new} else {old} end as v", f"{inside} as hit")
        self.root.put((out.where("hit or v is not null") if self.root.df is None else out).drop("hit"))
        return self

    def _base(self) -> DataFrame:
        """All root cells: the current version, or, before the first write, the bare grid."""
        whole = grid(self.spark, self.root.shape)
        if self.root.df is None:
            return whole
        if not self.view.where and not any(a is None for a in self.view.axes):
            return whole.selectExpr("*", f"cast(null as {self.type.spark}) as v")
        return whole.join(self.root.df, coords(self.root.rank), "left") if self.root.partial else self.root.df

    def write(self, new: DataFrame) -> Store:
        """Cells of the view from rows d0, ..., v; cells without a row keep their value."""
        names = coords(self.ndim)
        if self._view is None and self.root.shape is None:
            self.root.put(new.select(*names, F.col("v").cast(self.type.spark).alias("v")))
            return self
        back = [b.format(*names) for b in self.view.back]
        repeated = [f"d{k}" for k, a in enumerate(self.view.axes) if a is None]
        rows = new.selectExpr(*[f"cast({b} as bigint) as r{k}" for k, b in enumerate(back)], f"cast(v as {self.type.spark}) as w", "true as hit", f"struct({', '.join(repeated)}) as place")
        rows = rows.select(*[F.col(f"r{k}").alias(f"d{k}") for k in range(self.root.rank)], "w", "hit", "place")
        if repeated:  # several view cells are one root cell: the last one along the repeated axes counts
            rows = rows.groupBy(*coords(self.root.rank)).agg(F.max_by("w", "place").alias("w"), F.lit(True).alias("hit"))
        rows = rows.drop("place")
        if self.root.df is None:
            self.root.put(rows.select(*coords(self.root.rank), F.col("w").alias("v")))
            self.root.partial = True
        else:
            both = self.root.df.join(rows, coords(self.root.rank), "full")
            self.root.put(both.selectExpr(*coords(self.root.rank), "case when hit then w else v end as v"))
        return self

    def replace(self, new: DataFrame) -> Store:
        """All cells of an untransformed, whole store from rows d0, ..., v: no join with the old version."""
        self.root.put(new.select(*coords(self.ndim), F.col("v").cast(self.type.spark).alias("v")))
        self.root.partial = False
        return self

    def writes_all(self) -> bool:
        """The view is the whole root, cell for cell."""
        return self._view is None or self._view == View.whole(self.root.shape)

    def detach(self) -> None:
        """Let go of the attached data."""
        if self.root.df is not None:
            self.root.df.unpersist()
        self.root.df = None

    def offload(self, level: str = "MEMORY_AND_DISK") -> Store:
        """A hint: keep the current version in the given storage ("NONE" lets it go)."""
        from pyspark import StorageLevel

        if self.root.df is not None:
            self.root.df = self.root.df.unpersist() if level == "NONE" else self.root.df.persist(getattr(StorageLevel, level))
        return self

    def partition_by_tiling(self, tile_shape: Sequence[int], color_shape: Sequence[int] | None = None) -> TiledStore:
        return TiledStore(self, tuple(tile_shape), None if color_shape is None else tuple(color_shape))


class TiledStore:
    """A store cut into tiles; those at the edges are shorter, and colors beyond them are empty."""

    def __init__(self, store: Store, tile: tuple[int, ...], colors: tuple[int, ...] | None) -> None:
        if len(tile) != store.ndim or any(t <= 0 for t in tile):
            raise ValueError("a tile needs a positive extent for each dimension")
        if colors is not None and (len(colors) != store.ndim or any(c < 0 for c in colors)):
            raise ValueError("colors need an extent for each dimension")
        self.store, self.tile = store, tile
        self.colors = colors if colors is not None else tuple(-(-n // t) for n, t in zip(store.shape, tile))

    @property
    def df(self) -> DataFrame:
        """c0, ..., d0, ..., v: cells with the color of their tile."""
        return self.store.df.selectExpr(*[f"d{k} div {t} as c{k}" for k, t in enumerate(self.tile)], "*").where(" and ".join(f"c{k} < {n}" for k, n in enumerate(self.colors)) or "true")

    def bounds(self, color: Sequence[int]) -> list[tuple[int, int]]:
        if len(color) != len(self.colors) or any(not 0 <= c < n for c, n in zip(color, self.colors)):
            raise ValueError(f"no color {tuple(color)} in {self.colors}")
        return [(min(c * t, n), min((c + 1) * t, n)) for c, t, n in zip(color, self.tile, self.store.shape)]

    def get_child_store(self, *color: int) -> Store:
        out = self.store
        for k, (a, b) in enumerate(self.bounds(color)):
            out = out.slice(k, slice(a, b))
        return out

    def placement(self) -> DataFrame:
        """c0, ..., partition: where Spark holds each tile's rows."""
        return self.df.select(*[f"c{k}" for k in range(self.store.ndim)], F.spark_partition_id().alias("partition")).distinct()


def grid(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """All coordinates of a shape, made by each task for itself."""
    strides = [math.prod(shape[k + 1 :]) for k in range(len(shape))]
    return spark.range(math.prod(shape)).selectExpr(*[f"(id div {s}) % {n} as d{k}" if n and k else f"id div {max(1, s)} as d{k}" for k, (s, n) in enumerate(zip(strides, shape))])


def _from_arrow(column: pa.ChunkedArray | pa.Array, t: T.ElementType) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if t.is_complex:
        re, im = (column.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        return (re + 1j * im).astype(t.numpy)
    if t.name == "binary":
        return np.frombuffer(b"".join(column.to_pylist()), t.numpy)
    if t.name == "array":
        return np.array(column.to_pylist(), t.of[0].numpy)
    if t.name in ("point", "rect", "struct"):
        return np.array([_tuples(x) for x in column.to_pylist()], t.numpy)
    if t.name == "uint64":
        return np.array([int(x) for x in column.to_pylist()], np.uint64)
    return column.to_numpy(zero_copy_only=False).astype(t.numpy)


def _tuples(x: object) -> object:
    return tuple(map(_tuples, x.values())) if isinstance(x, dict) else x


def _to_arrow(values: np.ndarray, t: T.ElementType) -> pa.Array:
    flat = values.reshape(-1) if t.name != "array" else values.reshape(-1, t.n)
    if t.is_complex:
        kind = pa.float32() if t.name == "complex64" else pa.float64()
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat.real), kind), pa.array(np.ascontiguousarray(flat.imag), kind)], names=["re", "im"])
    if t.name == "binary":
        return pa.array([bytes(x) for x in flat], pa.binary())
    if t.name == "array":
        return pa.array(flat.tolist())
    if t.name in ("point", "rect", "struct"):
        return pa.array([_dicts(x) for x in flat], _arrow_type(t))
    if t.name == "uint64":
        from decimal import Decimal

        return pa.array([Decimal(int(x)) for x in flat], pa.decimal128(20, 0))
    return pa.array(flat.astype({"uint8": "i2", "uint16": "i4", "uint32": "i8", "float16": "f4"}.get(t.name, t.numpy)))


def _arrow_type(t: T.ElementType) -> pa.DataType:
    """Field by field: struct casts go by position."""
    if t.name == "point":
        return pa.struct([(f"p{k}", pa.int64()) for k in range(t.n)])
    if t.name == "rect":
        return pa.struct([("lo", _arrow_type(T.point(t.n))), ("hi", _arrow_type(T.point(t.n)))])
    if t.name == "struct":
        return pa.struct([(f"f{k}", _arrow_type(f)) for k, f in enumerate(t.of)])
    return _to_arrow(np.zeros(0, t.numpy), t).type


def _dicts(x: np.void) -> object:
    return {n: _dicts(x[n]) for n in x.dtype.names} if isinstance(x, np.void) and x.dtype.names else x.item()


def _check(shape: Sequence[int] | None, t: T.ElementType) -> None:
    if not t.fixed:
        raise ValueError("a store needs elements of a fixed size")
    if shape is not None and (len(shape) > T.MAX_DIM or any(n < 0 for n in shape)):
        raise ValueError(f"invalid shape {tuple(shape)}")


def create_store(spark: SparkSession, t: T.ElementType, shape: Sequence[int] | None = None, ndim: int = 1, optimize_scalar: bool = False) -> Store:
    """With a shape: a bound store without values. Without: an unbound one of rank ndim."""
    _check(shape, t)
    if shape is None:
        if not 1 <= ndim <= T.MAX_DIM:
            raise ValueError(f"invalid rank {ndim}")
        return Store(Root(spark, t, None, ndim), None)
    shape = tuple(int(n) for n in shape)
    return Store(Root(spark, t, shape, len(shape), scalar=optimize_scalar and math.prod(shape) == 1), View.whole(shape))


def from_scalar(spark: SparkSession, value: object, t: T.ElementType | None = None, shape: Sequence[int] = (1,)) -> Store:
    if math.prod(shape) != 1:
        raise ValueError("a scalar store has one cell")
    out = create_store(spark, t or T.of_value(value), shape, optimize_scalar=True)
    return out.fill(value)


def from_numpy(spark: SparkSession, array: object, t: T.ElementType | None = None) -> Store:
    """A copy of a buffer, a NumPy array or anything with the DLPack or array protocol."""
    a = np.from_dlpack(array) if hasattr(array, "__dlpack__") and not isinstance(array, np.ndarray) else np.asarray(array)
    t = t or T.of_dtype(a.dtype)
    if a.dtype != t.numpy and t.name not in ("array",):
        raise ValueError(f"a buffer of {a.dtype} for {t}")
    shape = a.shape[: a.ndim - 1] if t.name == "array" else a.shape
    out = create_store(spark, t, shape)
    return out.replace(_rows(spark, a, t, shape, (0,) * len(shape)))


def _rows(spark: SparkSession, a: np.ndarray, t: T.ElementType, shape: Sequence[int], offset: Sequence[int]) -> DataFrame:
    names = coords(len(shape))
    schema = ", ".join([*(f"{c} bigint" for c in names), f"v {t.spark}"])
    if not math.prod(shape):
        return spark.createDataFrame([], schema)
    at = np.unravel_index(np.arange(math.prod(shape)), shape) if shape else ()
    rows = pa.table([*(pa.array(x + o, pa.int64()) for x, o in zip(at, offset)), _to_arrow(a, t)], names=[*names, "v"])
    return spark.createDataFrame(rows).selectExpr(*names, f"cast(v as {t.spark}) as v")


def from_tiles(spark: SparkSession, shape: Sequence[int], tile_shape: Sequence[int], t: T.ElementType, tiles: Sequence[tuple[np.ndarray, Sequence[int]]]) -> Store:
    """A store whose tiles come from buffers, each with its color."""
    out = create_store(spark, t, shape)
    cut, df = out.partition_by_tiling(tile_shape), None
    for a, color in tiles:
        bounds = cut.bounds(color)
        if a.shape != tuple(y - x for x, y in bounds):
            raise ValueError(f"a tile of {a.shape} for color {tuple(color)}")
        part = _rows(spark, a, t, a.shape, [x for x, _ in bounds])
        df = part if df is None else df.unionByName(part)
    if df is not None:
        out.replace(df)
        out.root.partial = len(tiles) < math.prod(cut.colors)
    return out


def from_table(df: DataFrame, keys: Sequence[str], value: str, shape: Sequence[int], t: T.ElementType) -> Store:
    """A table with a row for each coordinate as a store: nothing is copied."""
    out = create_store(df.sparkSession, t, shape)
    return out.replace(df.select(*[F.col(k).cast("long").alias(f"d{i}") for i, k in enumerate(keys)], F.col(value).alias("v")))


def as_store(thing: object) -> Store:
    """A store, or what has the data-interface protocol: `store_interface()` gives version and exactly one data item."""
    if isinstance(thing, Store):
        return thing
    if not hasattr(thing, "store_interface"):
        raise TypeError(f"{type(thing).__name__} has no store interface")
    said = thing.store_interface()
    if said.get("version") not in (1,):
        raise NotImplementedError(f"version {said.get('version')!r} of the store interface")
    data = said["data"]
    if len(data) != 1:
        raise ValueError(f"the store interface has to give one store, not {len(data)}")
    return as_store(next(iter(data.values())))


