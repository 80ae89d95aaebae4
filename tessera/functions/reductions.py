"""Reduction operators: how values of one kind are combined in an aggregate and how a result is folded into what was there."""

from __future__ import annotations

import enum
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import types as T


class Kind(enum.Enum):
    ADD = "add"
    MUL = "mul"
    MAX = "max"
    MIN = "min"
    OR = "or"
    AND = "and"
    XOR = "xor"


#: Names of common function objects as kinds; minus and divides subtract, or divide, one value after the other.
FUNCTIONS = {"plus": Kind.ADD, "multiplies": Kind.MUL, "logical_or": Kind.OR, "logical_and": Kind.AND, "minus": "minus", "divides": "divides", "maximum": Kind.MAX, "minimum": Kind.MIN, "bit_xor": Kind.XOR}


@dataclass(frozen=True)
class Reduction:
    """aggregate(column) over a group; fold(old, new) of two columns; identity as a Python value, or None."""

    kind: object
    type: T.ElementType
    aggregate: Callable[[Column], Column]
    fold: Callable[[Column, Column], Column]
    identity: object
    #: What has to be done to rows (group columns, v) before they are aggregated.
    prepare: Callable[[DataFrame, list[str]], DataFrame] | None = None


class Unsupported(ValueError):
    pass


_custom: dict[tuple[str, str], Reduction] = {}


def supported(kind: Kind, t: T.ElementType) -> bool:
    if t.name == "bool" or t.is_integer:
        return True
    if t.is_float:
        return kind in (Kind.ADD, Kind.MUL, Kind.MAX, Kind.MIN)
    if t.name == "complex64":
        return kind in (Kind.ADD, Kind.MUL)
    return t.name == "complex128" and kind is Kind.ADD


def lookup(kind: Kind | str, t: T.ElementType) -> Reduction:
    """The reduction of a kind, a function object's name, or a registered name; raises here, before anything runs, if there is none."""
    if isinstance(kind, str):
        if (kind, str(t)) in _custom:
            return _custom[kind, str(t)]
        kind = FUNCTIONS.get(kind) or (Kind[kind.upper()] if kind.upper() in Kind.__members__ else None)
    if kind in ("minus", "divides"):
        return _one_after_the_other(kind, t)
    if not isinstance(kind, Kind) or not supported(kind, t):
        raise Unsupported(f"no reduction {kind} of {t}")
    return _of_bool(kind, t) if t.name == "bool" else _of_complex(kind, t) if t.is_complex else _of_number(kind, t)


def register(name: str, t: T.ElementType, fold: Callable[[np.ndarray], object], identity: object = None) -> str:
    """A custom reduction: `fold` makes one value of an array of values, in any grouping and order. It runs in Arrow batches."""

    def total(v: pd.Series) -> object:
        return fold(v.to_numpy())

    total.__annotations__ = {"v": pd.Series, "return": {"float64": float, "int64": int}.get(t.name, float)}
    udf = F.pandas_udf(total, t.spark)

    @F.pandas_udf(t.spark)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fold(np.array([x, y])) for x, y in zip(a, b)])

    if (name, str(t)) in _custom:
        raise ValueError(f"reduction {name} of {t} is already registered")
    _custom[name, str(t)] = Reduction(name, t, lambda v: udf(v), lambda a, b: two(a, b), identity)
    return name


def _of_bool(kind: Kind, t: T.ElementType) -> Reduction:
    """Addition and maximum are or, multiplication and minimum are and."""
    if kind is Kind.XOR:
        return Reduction(kind, t, lambda v: F.count_if(v) % 2 == 1, lambda a, b: a != b, False)
    if kind in (Kind.ADD, Kind.MAX, Kind.OR):
        return Reduction(kind, t, F.bool_or, lambda a, b: a | b, False)
    return Reduction(kind, t, F.bool_and, lambda a, b: a & b, True)


def _of_complex(kind: Kind, t: T.ElementType) -> Reduction:
    def pair(re: Column, im: Column) -> Column:
        return F.struct(re.alias("re"), im.alias("im")).cast(t.spark)

    def times(a: Column, b: Column) -> Column:
        return pair(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])

    if kind is Kind.ADD:
        return Reduction(kind, t, lambda v: pair(F.sum(v["re"]), F.sum(v["im"])), lambda a, b: pair(a["re"] + b["re"], a["im"] + b["im"]), 0j)
    # In polar form a product is a sum of logarithms and of angles, so partial results combine.
    size, angle = lambda v: F.sqrt(v["re"] ** 2 + v["im"] ** 2), lambda v: F.atan2(v["im"], v["re"])
    return Reduction(kind, t, lambda v: pair(F.product(size(v)) * F.cos(F.sum(angle(v))), F.product(size(v)) * F.sin(F.sum(angle(v)))), times, 1 + 0j)


def _of_number(kind: Kind, t: T.ElementType) -> Reduction:
    wide = t.spark

    def cast(f: Callable[..., Column]) -> Callable[..., Column]:
        return lambda *v: f(*v).cast(wide)

    if kind is Kind.ADD:
        return Reduction(kind, t, cast(F.sum), cast(lambda a, b: a + b), 0)
    if kind is Kind.MUL:
        if t.is_float:
            return Reduction(kind, t, cast(F.product), cast(lambda a, b: a * b), 1)
        # Exact for integers, over the few factors that _few_factors leaves.
        exact = lambda v: F.aggregate(F.collect_list(v), F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x.cast("decimal(20,0)")).cast("decimal(38,0)"))
        return Reduction(kind, t, cast(exact), cast(lambda a, b: a * b), 1, _few_factors)
    if kind in (Kind.MAX, Kind.MIN):
        # NaN is the largest value in both, as in Spark's order.
        bounds = (float("-inf"), float("inf")) if t.is_float else t.limits()
        return Reduction(kind, t, F.max if kind is Kind.MAX else F.min, F.greatest if kind is Kind.MAX else F.least, bounds[kind is Kind.MIN])
    if t.name == "uint64":
        return _of_halves(kind, t)
    bits = {Kind.OR: (F.bit_or, "bitwiseOR", 0), Kind.AND: (F.bit_and, "bitwiseAND", t.limits()[1] if t.name[0] == "u" else -1), Kind.XOR: (F.bit_xor, "bitwiseXOR", 0)}[kind]
    return Reduction(kind, t, bits[0], lambda a, b: getattr(a, bits[1])(b), bits[2])


def _of_halves(kind: Kind, t: T.ElementType) -> Reduction:
    """Bitwise reductions of uint64, which is held as a decimal: its two halves are reduced as integers."""
    total, name, identity = {Kind.OR: (F.bit_or, "bitwiseOR", 0), Kind.AND: (F.bit_and, "bitwiseAND", (1 << 64) - 1), Kind.XOR: (F.bit_xor, "bitwiseXOR", 0)}[kind]
    base = F.lit(1 << 32).cast("decimal(20,0)")

    def halves(v: Column) -> tuple[Column, Column]:
        high = F.floor(v / base).cast("bigint")
        return high, (v - high.cast("decimal(20,0)") * base).cast("bigint")

    def joined(high: Column, low: Column) -> Column:
        return (high.cast("decimal(20,0)") * base + low.cast("decimal(20,0)")).cast(t.spark)

    return Reduction(kind, t, lambda v: joined(*(total(x) for x in halves(v))), lambda a, b: joined(*(getattr(x, name)(y) for x, y in zip(halves(a), halves(b)))), identity)


def _few_factors(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the same product and at most 67 of them a group: 64 factors of 2 or more overflow any integer type, so more can't matter;
    of the others, a zero, or a sign, says it all. Spark limits each group before the shuffle too."""
    v = F.col("v")
    turn = F.row_number().over(Window.partitionBy(*names).orderBy("v")) if names else F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("v"))
    zero = rows.where(v == 0).select(*names, "v").distinct()
    signs = rows.where(v == -1).groupBy(*names).agg((F.count("*") % 2).alias("odd")).select(*names, F.when(F.col("odd") == 1, -1).otherwise(1).cast(rows.schema["v"].dataType).alias("v"))
    ones = rows.where(v == 1).select(*names, "v").distinct()
    large = rows.where(F.abs(v) > 1).withColumn("turn", turn).where("turn <= 64").select(*names, "v")
    if names:  # a product that holds a zero can't overflow
        large = large.join(zero.select(*names), names, "left_anti")
    return zero.unionByName(signs).unionByName(ones).unionByName(large)


def _one_after_the_other(name: str, t: T.ElementType) -> Reduction:
    """What is there less, or divided by, every value: the values' sum, or product, is taken first."""
    if t.name == "bool" or t.is_complex or not (t.is_float or t.is_integer):
        raise Unsupported(f"no reduction {name} of {t}")
    inner = _of_number(Kind.ADD if name == "minus" else Kind.MUL, t)
    if name == "minus":
        return Reduction(name, t, inner.aggregate, lambda a, b: (a - b).cast(t.spark), 0)
    return Reduction(name, t, inner.aggregate, lambda a, b: (a / b).cast(t.spark), 1, inner.prepare)
