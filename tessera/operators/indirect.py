"""Copies, gathers and scatters: every lookup is an equi-join on coordinates.

Points that lie outside are left out: a gather keeps what was there, a scatter ignores the row. With outside="raise" they raise instead,
which takes an action that looks at the points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reductions import Kind, Reduction, lookup
from .store import Store, coords


class DuplicatePoints(ValueError):
    pass


def _same_type(a: Store, b: Store) -> None:
    if a.type != b.type:
        raise ValueError(f"types {a.type} and {b.type} differ")


def _plain(*stores: Store) -> None:
    for s in stores:
        if s.unbound:
            raise ValueError("an unbound store can't be copied")
        if s.transformed:
            raise ValueError("a transformed store can't be copied")


def _indirect(ind: Store, into: Store, like: Store) -> None:
    _plain(ind, into, like)
    if ind.type.name != "point" or ind.type.n != into.ndim:
        raise ValueError(f"indirection of {ind.type} for a store of rank {into.ndim}")
    if ind.shape != like.shape:
        raise ValueError(f"indirection of shape {ind.shape} for {like.shape}")
    if into.has_scalar_storage or like.has_scalar_storage:
        raise ValueError("scalar stores can't be gathered or scattered")


def _put(target: Store, rows: DataFrame, redop: Kind | str | None) -> Store:
    """rows d0, ..., v with one row a cell: they replace, or are folded into, what is there."""
    if redop is None:
        if target.root.df is None or not target.writes_all():
            return target.write(rows)
        fold = None
    else:
        fold = lookup(redop, target.type).fold
    names = coords(target.ndim)
    new = rows.select(*names, F.col("v").cast(target.type.spark).alias("w"), F.lit(True).alias("hit"))
    both = target.df.join(new, names, "left")
    value = F.col("w") if fold is None else fold(F.col("v"), F.col("w"))
    out = both.select(*names, F.when(F.col("hit"), value).otherwise(F.col("v")).alias("v"))
    return target.replace(out) if target.writes_all() else target.write(out)


def copy(target: Store, source: Store, redop: Kind | str | None = None) -> Store:
    """target = source, cell by cell; with redop, target = target ⊕ source."""
    _plain(target, source)
    _same_type(target, source)
    if target.shape != source.shape:
        raise ValueError(f"shapes {target.shape} and {source.shape} differ")
    if redop is None:
        return target.replace(source.df) if target.writes_all() and not source.root.partial else target.write(source.df)
    if target.has_scalar_storage:
        raise ValueError("a scalar store can't be the target of a copy with a reduction")
    return _put(target, source.df, redop)


def _points(ind: Store, prefix: str) -> DataFrame:
    """d0, ... of the indirection with the point's parts as prefix0, ..."""
    return ind.df.select(*coords(ind.ndim), *[F.col(f"v.p{k}").alias(f"{prefix}{k}") for k in range(ind.type.n)])


def _gathered(source: Store, ind: Store) -> DataFrame:
    data = source.df.select(*[F.col(c).alias(f"s{k}") for k, c in enumerate(coords(source.ndim))], "v")
    return _points(ind, "s").join(data, [f"s{k}" for k in range(source.ndim)]).select(*coords(ind.ndim), "v")


def _judge(ind: Store, into: Store, outside: str) -> None:
    if outside not in ("skip", "raise"):
        raise ValueError(f"outside is skip or raise, not {outside!r}")
    if outside == "raise":
        beyond = " or ".join(f"v.p{k} < 0 or v.p{k} >= {n}" for k, n in enumerate(into.shape))
        if not ind.df.where(beyond).isEmpty():
            raise IndexError(f"points lie outside of shape {into.shape}")


def gather(target: Store, source: Store, ind: Store, redop: Kind | str | None = None, outside: str = "skip") -> Store:
    """target[i] = source[ind[i]]; points may repeat."""
    _same_type(target, source)
    _indirect(ind, source, target)
    _judge(ind, source, outside)
    return _put(target, _gathered(source, ind), redop)


def _within(rows: DataFrame, target: Store) -> DataFrame:
    return rows.where(" and ".join(f"t{k} >= 0 and t{k} < {n}" for k, n in enumerate(target.shape)))


def scatter(target: Store, ind: Store, source: Store, redop: Kind | str | None = None, check: bool = False, outside: str = "skip") -> Store:
    """target[ind[i]] = source[i]. Without redop, the source's last cell (in C order) counts where points repeat; check raises then."""
    _same_type(target, source)
    _indirect(ind, target, source)
    _judge(ind, target, outside)
    return _scattered(target, _points(ind, "t").join(source.df, coords(ind.ndim)), ind.shape, redop, check)


def _scattered(target: Store, rows: DataFrame, shape: tuple[int, ...], redop: Kind | str | None, check: bool) -> Store:
    at = [f"t{k}" for k in range(target.ndim)]
    rows = _within(rows, target)
    if redop is not None:
        r = lookup(redop, target.type)
        rows = rows if r.prepare is None else r.prepare(rows.select(*at, "v"), at)
        value = r.aggregate(F.col("v"))
    else:
        if check and not rows.groupBy(*at).count().where("count > 1").isEmpty():
            raise DuplicatePoints("several source cells go to one target cell")
        place = "0L"
        for k, n in enumerate(shape):
            place = f"({place}) * {n}L + d{k}"
        value = F.max_by("v", F.expr(place))
    rows = rows.groupBy(*at).agg(value.alias("v"))
    return _put(target, rows.select(*[F.col(a).alias(f"d{k}") for k, a in enumerate(at)], "v"), redop)


def scatter_gather(target: Store, target_ind: Store, source: Store, source_ind: Store, redop: Kind | str | None = None, check: bool = False, outside: str = "skip") -> Store:
    """target[target_ind[k]] = source[source_ind[k]]."""
    _same_type(target, source)
    if target_ind.shape != source_ind.shape:
        raise ValueError("the indirections differ in shape")
    _indirect(source_ind, source, target_ind)
    _indirect(target_ind, target, source_ind)
    _judge(source_ind, source, outside)
    _judge(target_ind, target, outside)
    rows = _points(target_ind, "t").join(_gathered(source, source_ind), coords(target_ind.ndim))
    return _scattered(target, rows, target_ind.shape, redop, check)


def fold_into(target: Store, rows: DataFrame, reduction: Reduction) -> Store:
    """rows d0, ..., v with any number of rows a cell: aggregated, then folded into what is there; cells without rows stay."""
    names = coords(target.ndim)
    rows = rows if reduction.prepare is None else reduction.prepare(rows, names)
    new = rows.groupBy(*names).agg(reduction.aggregate(F.col("v")).alias("w")) if names else rows.agg(reduction.aggregate(F.col("v")).alias("w"), F.count("*").alias("n")).where("n > 0").drop("n")
    both = target.df.join(new.withColumn("hit", F.lit(True)), names, "left") if names else target.df.join(F.broadcast(new.withColumn("hit", F.lit(True))), how="left")
    out = both.select(*names, F.when(F.col("hit"), reduction.fold(F.col("v"), F.col("w").cast(target.type.spark))).otherwise(F.col("v")).alias("v"))
    return target.replace(out) if target.writes_all() else target.write(out)
