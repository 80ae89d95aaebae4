"""User tasks: Python functions over tiles, called once for each tile with NumPy blocks.

    @task
    def saxpy(x: InputStore, y: InputStore, out: OutputStore, a: float): ...

Inputs come as Block (array, and where it lies), outputs as Block to be filled, reductions as Block of the identity that is folded into what
is there. Stores of one shape are aligned; constraints change what a tile's task sees of a store. A call makes a lazy plan; an action, or a scope
with IMMEDIATE exceptions, runs it.
"""

from __future__ import annotations

import inspect
import math
import types as pytypes
import typing
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reductions import Kind, lookup
from ..streaming.scope import Operation, current
from . import constraints as C
from .indirect import fold_into
from .store import Store, TiledStore, _from_arrow, _to_arrow, coords


class InputStore:
    """Annotation of a parameter that is read."""


class OutputStore:
    """Annotation of a parameter that is written."""


class ReductionStore:
    """ReductionStore[Kind.ADD]: annotation of a parameter that is reduced into."""

    kind: Kind

    def __class_getitem__(cls, kind: Kind) -> type:
        return type(f"ReductionStore[{kind.name}]", (cls,), {"kind": kind})


@dataclass(frozen=True)
class TaskContext:
    """Which tile a call is for, and what it was given."""

    task_index: tuple[int, ...]
    launch_domain: tuple[int, ...]
    provenance: str | None = None
    scalars: tuple = ()

    @property
    def is_single_task(self) -> bool:
        return math.prod(self.launch_domain) == 1


@dataclass
class Block:
    """array: the tile's cells; origin: the coordinates of its first one; there: which cells have a value (for inputs with gaps)."""

    array: np.ndarray
    origin: tuple[int, ...]
    there: np.ndarray | None = None
    bound: np.ndarray | None = None

    @property
    def domain(self) -> tuple[tuple[int, int], ...]:
        return tuple((o, o + n) for o, n in zip(self.origin, self.array.shape))

    def bind_data(self, array: np.ndarray) -> None:
        """The tile's part of an unbound output, of any length along dimension 0."""
        self.bound = np.asarray(array)


# --- constraints on parameters, by name --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Constraint:
    kind: str
    a: str
    b: str | None = None
    args: tuple = ()


def align(a: str, b: str) -> Constraint:
    return Constraint("align", a, b)


def broadcast(a: str, axes: Sequence[int] | None = None) -> Constraint:
    if axes is not None and not len(axes):
        raise ValueError("broadcast needs some axes")
    return Constraint("broadcast", a, args=(None if axes is None else tuple(axes),))


def image(func: str, target: str, hint: C.Hint = C.Hint.NO_HINT) -> Constraint:
    return Constraint("image", target, func, (hint,))


def scale(factors: Sequence[int], small: str, big: str) -> Constraint:
    return Constraint("scale", big, small, (tuple(factors),))


def bloat(source: str, bloated: str, low: Sequence[int], high: Sequence[int]) -> Constraint:
    return Constraint("bloat", bloated, source, (tuple(low), tuple(high)))


def min_extents(a: str, extents: Sequence[int]) -> Constraint:
    return Constraint("min_extents", a, args=(tuple(extents),))


# --- signatures ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Parameter:
    name: str
    role: str  # input, output, reduction, scalar
    kind: Kind | None = None
    optional: bool = False
    type: object = None


def signature_of(f: Callable) -> tuple[bool, list[Parameter]]:
    """Whether the function wants a TaskContext, and its parameters' roles; what has no annotation, *args and **kwargs raise."""
    hints = typing.get_type_hints(f)
    wants, out = False, []
    for k, (name, p) in enumerate(inspect.signature(f).parameters.items()):
        if p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD):
            raise NotImplementedError(f"{name}: variable parameters aren't supported")
        if name not in hints:
            raise TypeError(f"{name} has no type annotation")
        t, optional = hints[name], False
        if isinstance(t, pytypes.UnionType) or typing.get_origin(t) is typing.Union:
            inner = [x for x in typing.get_args(t) if x is not type(None)]
            if len(inner) != 1 or len(typing.get_args(t)) != 2:
                raise NotImplementedError(f"{name}: only unions with None are supported")
            t, optional = inner[0], True
        if t is TaskContext:
            if k or p.default is not p.empty:
                raise TypeError("the TaskContext has to be the first parameter, without a default")
            wants = True
        elif t is InputStore:
            out.append(Parameter(name, "input", None, optional))
        elif t is OutputStore:
            out.append(Parameter(name, "output", None, optional))
        elif isinstance(t, type) and issubclass(t, ReductionStore):
            if not hasattr(t, "kind"):
                raise TypeError(f"{name}: a reduction needs its kind")
            out.append(Parameter(name, "reduction", t.kind, optional))
        else:
            out.append(Parameter(name, "scalar", None, optional, t))
    return wants, out


class Task:
    """What @task makes of a function."""

    def __init__(self, f: Callable, constraints: Sequence[Constraint] = (), variants: Sequence[str] = ("cpu",), throws: bool = False) -> None:
        if set(variants) - {"cpu"}:
            raise NotImplementedError(f"variants {tuple(variants)}: only cpu is there")
        self.f, self.constraints, self.throws = f, tuple(constraints), throws
        self.wants_context, self.parameters = signature_of(f)
        names = {p.name for p in self.parameters if p.role != "scalar"}
        for c in self.constraints:
            for n in (c.a, c.b):
                if n is not None and n not in names:
                    raise ValueError(f"constraint on {n}, which is no store parameter")
        self.__name__ = f.__name__

    def prepare_call(self, *args: object, **kwargs: object) -> AutoTask:
        wanted = [p for p in inspect.signature(self.f).parameters.values()]
        sig = inspect.Signature(wanted[1:] if self.wants_context else wanted)
        bound = sig.bind(*args, **kwargs)
        bound.apply_defaults()
        out = AutoTask(self)
        for p in self.parameters:
            value = bound.arguments[p.name]
            if value is None and p.optional:
                out.scalars[p.name] = None
            elif p.role == "scalar":
                if isinstance(p.type, type) and p.type is not object and not isinstance(value, p.type) and not (p.type is float and isinstance(value, int)):
                    raise TypeError(f"{p.name} has to be {p.type.__name__}, not {type(value).__name__}")
                out.scalars[p.name] = value
            elif not isinstance(value, Store):
                raise TypeError(f"{p.name} has to be a store, not {type(value).__name__}")
            else:
                out.stores[p.name] = value
        return out

    def __call__(self, *args: object, **kwargs: object) -> None:
        self.prepare_call(*args, **kwargs).execute()


def task(f: Callable | None = None, **options: object) -> Task | Callable[[Callable], Task]:
    return Task(f, **options) if f is not None else lambda g: Task(g, **options)


#: Failed calls of one launch that are named; the others are counted.
MOST_FAILURES = 100


class TaskFailures(RuntimeError):
    """What the calls of one launch raised, joined: (task index, error) of each, in order."""

    def __init__(self, name: str, failures: list[tuple[tuple[int, ...], str]], total: int) -> None:
        self.failures, self.total = failures, total
        super().__init__(f"{total} calls of {name} failed: " + "; ".join(f"{index}: {error}" for index, error in failures))


# --- execution ---------------------------------------------------------------------------------------------------------------


@dataclass
class AutoTask:
    """A prepared call: the launch domain is chosen from the largest store."""

    task: Task
    stores: dict[str, Store] = field(default_factory=dict)
    scalars: dict[str, object] = field(default_factory=dict)
    extra: list[Constraint] = field(default_factory=list)
    done: bool = False

    def add_constraint(self, c: Constraint) -> None:
        if self.done:
            raise RuntimeError("the call has been executed")
        self.extra.append(c)

    def _roles(self) -> dict[str, Parameter]:
        return {p.name: p for p in self.task.parameters if p.name in self.stores}

    def _lead(self, constraints: list[Constraint]) -> str:
        """The store that is cut into tiles: not one that follows from another, the largest one."""
        follows = {c.a for c in constraints if c.kind in ("image", "scale", "bloat", "broadcast")}
        free = [n for n, s in self.stores.items() if n not in follows and not s.unbound and self._roles()[n].role != "reduction"]
        free = free or [n for n, s in self.stores.items() if not s.unbound]
        if not free:
            raise ValueError("some store has to have a shape")
        return max(free, key=lambda n: self.stores[n].volume)

    def execute(self) -> None:
        if self.done:
            raise RuntimeError("the call has been executed")
        self.done = True
        constraints = [*self.task.constraints, *self.extra]
        lead, scope = self._lead(constraints), current()
        least = next((c.args[0] for c in constraints if c.kind == "min_extents" and c.a == lead), None)
        pieces = scope.pieces if scope else self.stores[lead].spark.sparkContext.defaultParallelism
        tiled = C.auto_tiles(self.stores[lead], pieces, least, *([scope.policy.threshold] if scope else []))
        parts = {n: self._part(n, lead, tiled, constraints) for n, p in self._roles().items() if p.role == "input"}
        regions = {n: self._region(n, lead, tiled, constraints) for n, p in self._roles().items() if p.role != "input"}
        _launch(self, tiled, parts, regions)

    def _part(self, name: str, lead: str, tiled: TiledStore, constraints: list[Constraint]) -> DataFrame:
        s = self.stores[name]
        for c in constraints:
            if c.a != name:
                continue
            if c.kind == "broadcast":
                return C.broadcast(s, tiled, c.args[0]) if c.args[0] is not None and s.ndim == tiled.store.ndim else _everywhere(s, tiled)
            if c.kind == "image":
                return C.image(self.stores[c.b].partition_by_tiling(tiled.tile), s, c.args[0])
            if c.kind == "scale":
                return C.scale(c.args[0], self.stores[c.b].partition_by_tiling(tiled.tile), s)
            if c.kind == "bloat":
                return C.bloat(self.stores[c.b].partition_by_tiling(tiled.tile), s, *c.args)
        if s.shape != tiled.store.shape:
            raise ValueError(f"{name} of shape {s.shape} isn't aligned with {lead} of {tiled.store.shape}; a constraint has to say how")
        return s.partition_by_tiling(tiled.tile).df

    def _region(self, name: str, lead: str, tiled: TiledStore, constraints: list[Constraint]) -> str:
        s, role = self.stores[name], self._roles()[name].role
        if s.unbound:
            return "unbound"
        if s.shape == tiled.store.shape and not any(c.kind == "broadcast" and c.a == name for c in constraints):
            return "tile"
        if role == "reduction" or math.prod(tiled.colors) == 1:
            return "whole"
        if any(c.kind == "scale" and c.a == name for c in constraints):
            return "scale:" + ",".join(map(str, next(c.args[0] for c in constraints if c.kind == "scale" and c.a == name)))
        raise ValueError(f"{name} of shape {s.shape} isn't aligned with {lead} of {tiled.store.shape}")


def _everywhere(s: Store, tiled: TiledStore) -> DataFrame:
    out = s.df
    for k, n in enumerate(tiled.colors):
        out = out.withColumn(f"c{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return out.select(*C.colors(len(tiled.colors)), *coords(s.ndim), "v")


def _launch(call: AutoTask | ManualTask, tiled: TiledStore, parts: dict[str, DataFrame], regions: dict[str, str]) -> None:
    """One group for each tile: all inputs' cells as rows (tile, slot, d..., one value column an input); one row of outputs' cells each back."""
    spark, n = tiled.store.spark, len(tiled.colors)
    colors, rank = C.colors(n), max(s.ndim for s in call.stores.values())
    names = list(parts)
    rows = None
    empty = {p: f"cast(null as {call.stores[p].type.spark}) as i{k}" for k, p in enumerate(names)}
    grid = _colors_of(spark, tiled)  # every tile has a call, with or without inputs
    all_parts = [(-1, None, grid)] + [(k, p, parts[p]) for k, p in enumerate(names)]
    for slot, p, df in all_parts:
        r = call.stores[p].ndim if p else 0
        own = df.selectExpr(*colors, f"{slot} as slot", *[f"d{k}" if k < r else f"cast(0 as bigint) as d{k}" for k in range(rank)], *[f"v as i{k}" if q == p else empty[q] for k, q in enumerate(names)])
        rows = own if rows is None else rows.unionByName(own)
    outs = list(regions)
    types = {p: call.stores[p].type for p in call.stores}
    shapes = {p: call.stores[p].shape for p in call.stores if not call.stores[p].unbound}
    roles = {p.name: p for p in call.task.parameters}
    identity = {p: lookup(roles[p].kind, types[p]).identity for p in outs if roles[p].role == "reduction"}
    ndims = {p: call.stores[p].ndim for p in call.stores}
    f, wants, scalars, tile, launch = call.task.f, call.task.wants_context, dict(call.scalars), tiled.tile, tiled.colors
    lead_shape, provenance = tiled.store.shape, None if current() is None else current().provenance
    order, throws = [p.name for p in call.task.parameters], call.task.throws
    names_out = [*colors, "slot", *[f"d{j}" for j in range(rank)], *[f"o{j}" for j in range(len(outs))], "error"]

    def block_of(t: pa.Table, p: str, k: int) -> Block:
        own = t.filter(pa.compute.equal(t["slot"], k))
        at = [own[f"d{j}"].to_numpy() for j in range(ndims[p])]
        if not own.num_rows:
            return Block(np.zeros((0,) * ndims[p], types[p].numpy), (0,) * ndims[p], np.zeros((0,) * ndims[p], bool))
        low = [int(a.min()) for a in at]
        array = np.zeros([int(a.max()) - o + 1 for a, o in zip(at, low)], types[p].numpy)
        there = np.zeros(array.shape, bool)
        where = tuple(a - o for a, o in zip(at, low))
        array[where], there[where] = _from_arrow(own[f"i{k}"], types[p]), True
        return Block(array, tuple(low), there)

    def new_block(p: str, color: tuple[int, ...]) -> Block:
        if regions[p] == "unbound":
            return Block(np.zeros((0,) * ndims[p], types[p].numpy), (0,) * ndims[p])
        lo, hi = [0] * ndims[p], list(shapes[p])
        if regions[p] != "whole":
            lo = [c * t for c, t in zip(color, tile)]
            hi = [min(a + t, s) for a, t, s in zip(lo, tile, lead_shape)]
            if regions[p].startswith("scale:"):
                by = [int(x) for x in regions[p][6:].split(",")]
                lo, hi = [a * b for a, b in zip(lo, by)], [min(a * b, s) for a, b, s in zip(hi, by, shapes[p])]
        start = identity.get(p)
        return Block(np.full([b - a for a, b in zip(lo, hi)], 0 if start is None else start, types[p].numpy), tuple(lo))

    def empty_of(p: str) -> pa.Array:
        t = types[p]
        return pa.array([], pa.list_(_to_arrow(np.zeros(0, t.of[0].numpy), t.of[0]).type)) if t.name == "array" else _to_arrow(np.zeros(0, t.numpy), t)

    def run(t: pa.Table) -> pa.Table:
        color = tuple(int(t[c][0].as_py()) for c in colors)
        given = {p: block_of(t, p, k) for k, p in enumerate(names)} | {p: new_block(p, color) for p in outs}
        values = [given[p] if p in given else scalars[p] for p in order]
        context = [TaskContext(color, launch, provenance, tuple(scalars.values()))] if wants else []
        try:
            f(*context, *values)
        except Exception as e:  # noqa: BLE001  of a task that says it throws: told with its index, and joined with the others'
            if not throws:
                raise
            columns = [pa.array([c], pa.int64()) for c in color] + [pa.array([-2], pa.int32())] + [pa.array([0], pa.int64())] * rank
            columns += [pa.nulls(1, empty_of(q).type) for q in outs] + [pa.array([f"{type(e).__name__}: {e}"])]
            return pa.Table.from_arrays(columns, names=names_out)
        tables = []
        for k, p in enumerate(outs):
            b = given[p]
            a = b.bound if regions[p] == "unbound" and b.bound is not None else b.array
            a = np.asarray(a, types[p].numpy)
            m = math.prod(a.shape[: ndims[p]])
            at = np.unravel_index(np.arange(m), a.shape[: ndims[p]]) if m else [np.zeros(0, np.int64)] * ndims[p]
            columns = [pa.array(np.full(m, color[j]), pa.int64()) for j in range(n)] + [pa.array(np.full(m, k), pa.int32())]
            columns += [pa.array((at[j] + b.origin[j]) if j < ndims[p] else np.zeros(m, np.int64), pa.int64()) for j in range(rank)]
            for j, q in enumerate(outs):
                columns.append(_to_arrow(a, types[p]) if j == k else pa.nulls(m, empty_of(q).type))
            tables.append(pa.Table.from_arrays([*columns, pa.nulls(m, pa.string())], names=names_out))
        return pa.concat_tables(tables)

    schema = ", ".join([*(f"{c} bigint" for c in colors), "slot int", *(f"d{k} bigint" for k in range(rank)), *(f"o{k} {types[p].spark}" for k, p in enumerate(outs)), "error string"])
    made = rows.groupBy(*colors).applyInArrow(run, schema)
    def judge() -> None:
        failed = made.where("slot = -2")
        if total := failed.count():
            raise TaskFailures(call.task.__name__, [(tuple(r[c] for c in colors), r.error) for r in failed.orderBy(*colors).limit(MOST_FAILURES).collect()], total)

    scope = current()
    immediate = bool(call.task.throws and scope is None)
    if len(outs) > 1 or immediate or scope is not None:
        made = made.persist()
    if scope is not None:
        ids = {p: call.stores[p].root.id for p in call.stores}
        by_role = lambda r: frozenset(ids[p] for p in call.stores if roles[p].role == r)
        scope.submit(Operation(call.task.__name__, None, launch, by_role("input"), by_role("output"), by_role("reduction"), all(r == "tile" or roles[p].role == "reduction" for p, r in regions.items())))
        if call.task.throws:
            scope.guarded(judge)
    elif immediate:
        judge()
    for k, p in enumerate(outs):
        s = call.stores[p]
        own = made.where(f"slot = {k}").select(*coords(s.ndim), F.col(f"o{k}").alias("v"), *colors)
        if roles[p].role == "reduction":
            fold_into(s, own.select(*coords(s.ndim), "v"), lookup(roles[p].kind, s.type))
        elif regions[p] == "unbound":
            s.write(_joined_up(own, colors, s.ndim))
        else:
            own = own.select(*coords(s.ndim), "v")
            s.replace(own) if s.writes_all() else s.write(own)


def _joined_up(own: DataFrame, colors: list[str], ndim: int) -> DataFrame:
    """Parts of an unbound output one behind the other along dimension 0, in order of color; only the parts' lengths reach the driver."""
    own = own.persist()
    sizes = sorted((tuple(r[c] for c in colors), r.n) for r in own.groupBy(*colors).agg((F.max("d0") + 1).alias("n")).collect())
    starts, total = {}, 0
    for color, n in sizes:
        starts[",".join(map(str, color))], total = total, total + n
    if not starts:
        return own.select(*coords(ndim), "v")
    first = F.create_map(*[F.lit(x) for c, s in starts.items() for x in (c, s)])
    key = F.concat_ws(",", *[F.col(c).cast("string") for c in colors])
    return own.select((F.col("d0") + F.element_at(first, key)).cast("long").alias("d0"), *coords(ndim)[1:], "v")


def _colors_of(spark: object, tiled: TiledStore) -> DataFrame:
    from .store import grid

    return grid(spark, tiled.colors).selectExpr(*[f"d{k} as c{k}" for k in range(len(tiled.colors))], "null as v")


# --- manual tasks ------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SymbolicExpr:
    """weight * dim + offset, of a launch point."""

    dim: int = -1
    weight: int = 1
    offset: int = 0

    def __add__(self, x: int) -> SymbolicExpr:
        return SymbolicExpr(self.dim, self.weight, self.offset + x)

    def __mul__(self, x: int) -> SymbolicExpr:
        return SymbolicExpr(self.dim, self.weight * x, self.offset * x)

    def sql(self) -> str:
        return str(self.offset) if self.dim < 0 else f"({self.weight} * c{self.dim} + {self.offset})"


def dimension(k: int) -> SymbolicExpr:
    return SymbolicExpr(k)


def constant(c: int) -> SymbolicExpr:
    return SymbolicExpr(offset=c)


@dataclass
class ManualTask:
    """A call with an explicit launch domain and, for each input, the tile that each launch point sees."""

    task: Task
    launch: tuple[int, ...]
    stores: dict[str, Store] = field(default_factory=dict)
    scalars: dict[str, object] = field(default_factory=dict)
    parts: dict[str, DataFrame] = field(default_factory=dict)
    tiles: dict[str, TiledStore] = field(default_factory=dict)

    def add_input(self, name: str, tiled: TiledStore | Store, projection: Sequence[SymbolicExpr] | None = None) -> None:
        """A partition, seen through a projection (by default point c sees tile c), or a whole store."""
        from .store import grid

        store = tiled if isinstance(tiled, Store) else tiled.store
        points = grid(store.spark, self.launch).selectExpr(*[f"d{k} as c{k}" for k in range(len(self.launch))])
        colors = C.colors(len(self.launch))
        self.stores[name] = store
        if isinstance(tiled, Store):
            self.parts[name] = _everywhere(store, _Launch(store, self.launch, self.launch))
            return
        exprs = projection or [dimension(k) for k in range(store.ndim)]
        seen = points.selectExpr(*colors, *[f"cast({e.sql()} as bigint) as t{k}" for k, e in enumerate(exprs)])
        cells = tiled.df.selectExpr(*[f"c{k} as t{k}" for k in range(store.ndim)], *coords(store.ndim), "v")
        self.parts[name] = seen.join(cells, [f"t{k}" for k in range(store.ndim)]).select(*colors, *coords(store.ndim), "v")

    def add_output(self, name: str, tiled: TiledStore | Store) -> None:
        """A partition with a tile for each launch point, or an unbound store."""
        self.stores[name] = tiled if isinstance(tiled, Store) else tiled.store
        if isinstance(tiled, TiledStore):
            if tiled.colors != self.launch:
                raise ValueError(f"colors {tiled.colors} for a launch of {self.launch}")
            self.tiles[name] = tiled

    def add_reduction(self, name: str, store: Store) -> None:
        self.stores[name] = store

    def add_scalar(self, name: str, value: object) -> None:
        self.scalars[name] = value

    def execute(self) -> None:
        roles = {p.name: p.role for p in self.task.parameters}
        lead = next(iter(self.tiles.values()), None)
        if lead is None:
            store = next(iter(self.stores.values()))
            lead = _Launch(store, self.launch, tuple(1 for _ in self.launch))
        if any(t.tile != lead.tile for t in self.tiles.values()):
            raise ValueError("outputs of one call need tiles of the same shape")
        regions = {n: "unbound" if s.unbound else "whole" if roles[n] == "reduction" else "tile" for n, s in self.stores.items() if roles[n] != "input"}
        _launch(self, lead, self.parts, regions)


class _Launch(TiledStore):
    """A launch domain that no output's tiles give."""

    def __init__(self, store: Store, launch: tuple[int, ...], tile: tuple[int, ...]) -> None:
        self.store, self.colors, self.tile = store, launch, tile


def inline(f: Task, *blocks: Block, **scalars: object) -> None:
    """A nested call inside a task: the function on blocks at hand."""
    f.f(*blocks, **scalars)


