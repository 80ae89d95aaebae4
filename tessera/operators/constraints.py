"""Which cells each tile's task sees: aligned, broadcast, image, scaled and bloated partitions as DataFrames (c0, ..., d0, ..., v)."""

from __future__ import annotations

import enum
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import tiles as plan
from .algorithms import bounding_boxes
from .store import Store, TiledStore, coords


#: Cells of a target that share a key when boxes look for the cells inside.
SLAB = 1 << 14
#: Boxes that share a key then; of more in a slab, each part of them looks on its own.
BOXES = 1 << 8


class Hint(enum.Enum):
    NO_HINT = "exact"
    MIN_MAX = "bounds of all points"
    FIRST_LAST = "bounds of the first and last point"


def auto_tiles(store: Store, pieces: int, least: Sequence[int] | None = None, threshold: int = plan.THRESHOLD) -> TiledStore:
    """Tiles of a store for so many tasks, not smaller than `least` (min_extents)."""
    return store.partition_by_tiling(plan.tile_shape(store.shape, plan.launch_shape(store.shape, pieces, threshold), least))


def colors(n: int) -> list[str]:
    return [f"c{k}" for k in range(n)]


def align(*stores: Store, pieces: int = 8, threshold: int = plan.THRESHOLD) -> list[TiledStore]:
    """The same tiles for stores of the same shape; the first one's decide."""
    if len({s.shape for s in stores}) != 1:
        raise ValueError("aligned stores have to have the same shape")
    first = auto_tiles(stores[0], pieces, threshold=threshold)
    return [first, *(s.partition_by_tiling(first.tile) for s in stores[1:])]


def zip_aligned(*tiled: TiledStore) -> DataFrame:
    """c0, ..., d0, ..., v0, v1, ...: cells of aligned stores side by side, dealt by tile."""
    out = None
    for k, t in enumerate(tiled):
        own = t.df.withColumnRenamed("v", f"v{k}")
        out = own if out is None else out.join(own, [*colors(len(t.tile)), *coords(len(t.tile))])
    return out


def broadcast(store: Store, tiled: TiledStore, axes: Sequence[int] | None = None) -> DataFrame:
    """The whole store for each tile; with axes, only those are whole and the others are cut like the tiles."""
    n = len(tiled.colors)
    if axes is not None and (not len(axes) or any(not 0 <= a < store.ndim for a in axes)):
        raise ValueError(f"broadcast needs some axes of {store.ndim}, not {axes}")
    whole = set(range(n)) if axes is None else set(axes)
    out = store.df
    for k in range(n):
        if k in whole:
            out = out.withColumn(f"c{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiled.colors[k] - 1).cast("long"))))
        else:
            out = out.withColumn(f"c{k}", F.expr(f"d{k} div {tiled.tile[k]}"))
    return out.select(*colors(n), *coords(store.ndim), "v")


def image(func: TiledStore, target: Store, hint: Hint = Hint.NO_HINT) -> DataFrame:
    """For each tile of func, the cells of target that its points, or rectangles, refer to; with a hint, all in the box around them."""
    t, n = func.store.type, len(func.tile)
    if t.name not in ("point", "rect") or t.n != target.ndim:
        raise ValueError(f"an image needs points or rectangles of rank {target.ndim}, not {t}")
    if target.unbound or func.store.unbound:
        raise ValueError("an image needs bound stores")
    if hint is Hint.NO_HINT:
        points = func.df.select(*colors(n), "v")
        if t.name == "rect":
            for k in range(t.n):
                points = points.where(f"v.lo.p{k} <= v.hi.p{k}")
            names = [F.explode(F.sequence(F.greatest(F.col(f"v.lo.p{k}"), F.lit(0)), F.least(F.col(f"v.hi.p{k}"), F.lit(target.shape[k] - 1)))) for k in range(t.n)]
            points = points.where(" and ".join(f"v.hi.p{k} >= 0 and v.lo.p{k} < {target.shape[k]}" for k in range(t.n)))
            for k, e in enumerate(names):
                points = points.withColumn(f"d{k}", e)
            points = points.drop("v")
        else:
            points = points.select(*colors(n), *[F.col(f"v.p{k}").alias(f"d{k}") for k in range(t.n)])
        return points.distinct().join(target.df, coords(t.n)).select(*colors(n), *coords(t.n), "v")
    if hint is Hint.FIRST_LAST and t.name == "point":
        # The place in C order and the point's coordinates one by one: of numbers alone the aggregate hashes, of structs it would sort all points.
        place = "0"
        for k, m in enumerate(func.store.shape):
            place = f"({place}) * {m} + d{k}"
        order = F.expr(f"cast({place} as bigint)")
        ends = func.df.groupBy(*colors(n)).agg(*[x for k in range(t.n) for x in (F.min_by(f"v.p{k}", order).alias(f"a{k}"), F.max_by(f"v.p{k}", order).alias(f"b{k}"))])
        boxes = ends.select(*colors(n), *[x for k in range(t.n) for x in (F.least(f"a{k}", f"b{k}").alias(f"lo{k}"), F.greatest(f"a{k}", f"b{k}").alias(f"hi{k}"))])
    else:
        boxes = bounding_boxes(func.df, colors(n), "v", t.n, t.name == "rect")
    # A box has a row for each slab (of about SLAB cells) along dimension 0 that it meets, so boxes meet cells by an equi-join.
    slab = max(1, SLAB // max(1, math.prod(target.shape[1:])))
    boxes = boxes.where(f"hi0 >= 0 and lo0 < {target.shape[0]}").withColumn("slab", F.explode(F.sequence(F.expr(f"greatest(lo0, 0) div {slab}"), F.expr(f"least(greatest(hi0, 0), {max(0, target.shape[0] - 1)}) div {slab}"))))
    # Boxes may be few bytes and yet have very many cells: their number says how the work is dealt, not their size.
    sizes = boxes.groupBy("slab").agg(F.ceil(F.count("*") / BOXES).alias("parts"))
    spark = target.spark
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    boxes = boxes.join(sizes, "slab").withColumn("part", F.pmod(F.xxhash64(*colors(n)), "parts"))
    cells = target.df.withColumn("slab", F.expr(f"d0 div {slab}")).join(sizes, "slab").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    boxes, cells = (side.withColumn("key", F.shiftleft("slab", 24) + F.col("part")).drop("slab", "parts", "part").repartition(tasks, "key") for side in (boxes, cells))
    inside = " and ".join(f"d{k} between lo{k} and hi{k}" for k in range(t.n))
    return boxes.join(cells, "key").where(inside).select(*colors(n), *coords(t.n), "v")


def scale(factors: Sequence[int], small: TiledStore, big: Store) -> DataFrame:
    """For each tile of the small store, the cells of the big one that `factors` times its cells cover."""
    if len(factors) != small.store.ndim or small.store.ndim != big.ndim or any(f <= 0 for f in factors):
        raise ValueError("scale needs a positive factor for each dimension of two stores of the same rank")
    out = big.df.selectExpr(*[f"(d{k} div {f}) div {t} as c{k}" for k, (f, t) in enumerate(zip(factors, small.tile))], "*")
    return out.where(" and ".join(f"d{k} < {f * n}" for k, (f, n) in enumerate(zip(factors, small.store.shape))))


def bloat(source: TiledStore, store: Store, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    """For each tile of the source, the cells of the store in it and up to low, high cells around it."""
    if not len(low) == len(high) == store.ndim == source.store.ndim or any(x < 0 for x in (*low, *high)):
        raise ValueError("bloat needs an offset of 0 or more for each dimension of two stores of the same rank")
    out = store.df
    for k, (t, n) in enumerate(zip(source.tile, source.colors)):
        first, last = F.greatest(F.floor((F.col(f"d{k}") - high[k]) / t), F.lit(0)), F.least(F.floor((F.col(f"d{k}") + low[k]) / t), F.lit(n - 1))
        out = out.withColumn(f"c{k}", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return out.select(*colors(store.ndim), *coords(store.ndim), "v")


def stencil(store: Store, dim: int, low: int, high: int, f: object, tile: int = 1 << 16) -> DataFrame:
    """d0, ..., v: f (an aggregate of a Column) over the cells from low before to high behind each cell along one dimension.

    A long axis is cut into tiles with ghost cells, so no task gets a whole axis.
    """
    names = coords(store.ndim)
    cut = [n if k != dim else min(n, tile) for k, n in enumerate(store.shape)]
    ghost = bloat(store.partition_by_tiling([max(1, c) for c in cut]), store, [low if k == dim else 0 for k in range(store.ndim)], [high if k == dim else 0 for k in range(store.ndim)])
    over = Window.partitionBy(f"c{dim}", *[c for k, c in enumerate(names) if k != dim]).orderBy(f"d{dim}").rangeBetween(-low, high)
    value: Column = f(F.col("v")).over(over)
    return ghost.select(f"c{dim}", *names, value.alias("v")).where(f"d{dim} div {max(1, cut[dim])} = c{dim}").select(*names, "v")
