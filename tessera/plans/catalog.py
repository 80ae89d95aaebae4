"""Catalog of queries over the driver's tables: each applies an operator of the engine, with SQL that says the same."""

from __future__ import annotations

import math
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import types as T
from ..functions.reductions import Kind, lookup, register
from ..operators import algorithms as A
from ..operators import collectives
from ..operators import constraints as C
from ..operators import indirect as I
from ..operators import tasks as K
from ..operators.store import Store, create_store, from_numpy, from_scalar, from_table, from_tiles
from ..sources import raw, zarr

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items() if s}


# --- stores of the tables --------------------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _extent(df: DataFrame, key: str) -> int:
    """From the Parquet files' statistics: only one aggregate row comes back."""
    return (df.agg(F.max(key)).first()[0] or 0) + 1


def vector(spark: SparkSession, sf_dir: str, name: str, key: str, value: str, t: T.ElementType) -> Store:
    df = _table(spark, sf_dir, name)
    return from_table(df, [key], value, (_extent(df, key),), t)


def embeddings(spark: SparkSession, sf_dir: str) -> Store:
    df = _table(spark, sf_dir, "embeddings")
    cells = df.select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    longest = df.agg(F.max(F.size("embedding"))).first()[0] or 0
    return from_table(cells, ["vec_id", "pos"], "x", (_extent(df, "vec_id"), longest), T.float64)


def _points(spark: SparkSession, sf_dir: str, name: str, key: str, *values: str) -> Store:
    df = _table(spark, sf_dir, name)
    cells = df.withColumn("p", F.struct(*[F.col(v).cast("long").alias(f"p{k}") for k, v in enumerate(values)]))
    return from_table(cells, [key], "p", (_extent(df, key),), T.point(len(values)))


def _zeros(spark: SparkSession, shape: tuple[int, ...], t: T.ElementType, value: object = 0) -> Store:
    return create_store(spark, t, shape).fill(value)


def _lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """lineitem with a dense place: the rows numbered within each order."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(order) - 1).alias("k"), *columns)


def _r(column: str, name: str | None = None, digits: int = 6) -> F.Column:
    return F.round(F.col(column), digits).alias(name or column)


_EMB = "(select vec_id as d0, i - 1 as d1, cast(embedding[i] as double) as v from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings))"

# --- views ----------------------------------------------------------------------------------------------------------------------


@query(f"select d0 as vec_id, round(sum(v * v), 6) as energy from {_EMB} group by d0")
def row_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transform_reduce over the rows."""
    e = embeddings(spark, sf_dir)
    out = A.transform_reduce(A.columns_of(e), _zeros(spark, (e.shape[0],), T.float64), Kind.ADD, lambda v: v * v)
    return out.df.select(F.col("d0").alias("vec_id"), _r("v", "energy"))


@query(f"select d1 - 2 as d0, d0 - 10 as d1, round(v, 6) as v from {_EMB} where d0 between 10 and 19 and d1 between 2 and 4")
def slice_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir)[10:20, 2:5].transpose((1, 0)).df.select("d0", "d1", _r("v"))


@query(f"select d0, round(v, 6) as v from {_EMB} where d1 = 7")
def project_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).project(1, 7).df.select("d0", _r("v"))


@query("select n_nationkey as d0, j as d1, n_regionkey as v from nation, (select unnest(range(3)) as j)")
def promote_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", T.int32).promote(1, 3).df


@query("select j as d0, r_regionkey as d1, r_regionkey * 10 as v from region, (select unnest(range(4)) as j)")
def broadcast_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vector(spark, sf_dir, "region", "r_regionkey", "r_regionkey", T.int32)
    row = create_store(spark, T.int32, (1, s.shape[0]))
    row.project(0, 0).write(s.df.selectExpr("d0", "v * 10 as v"))
    return row.broadcast(0, 4).df


@query("select event_id // 40 as d0, (event_id // 8) % 5 as d1, event_id % 8 as d2, round(value, 6) as v from events")
def delinearize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vector(spark, sf_dir, "events", "event_id", "value", T.float64)
    return s.delinearize(0, (s.shape[0] // 40, 5, 8)).df.select("d0", "d1", "d2", _r("v"))


@query(f"select d1 // 16 as d0, d0 as d1, d1 % 16 as d2, round(v, 6) as v from {_EMB} where d0 >= 100 and d0 < 130")
def views_of_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return e.delinearize(1, (4, 16)).slice(0, slice(100, 130)).transpose((1, 0, 2)).df.select("d0", (F.col("d1") + 100).alias("d1"), "d2", _r("v"))


@query("select p_partkey as d0, 0 as d1, cast(p_size as bigint) as v from part where p_partkey between 50 and 99")
def index_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store[50:100, None]"""
    s = vector(spark, sf_dir, "part", "p_partkey", "p_size", T.int64)
    return s[50:100, None].df.selectExpr("d0 + 50 as d0", "cast(d1 as int) as d1", "v")


# --- fills and copies -------------------------------------------------------------------------------------------------------------


@query(f"select d0, d1, case when d0 >= 5 and d0 < 9 and d1 >= 3 then -1.0 else round(v, 6) end as v from {_EMB}")
def fill_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    e[5:9, 3:].fill(-1.0)
    return e.df.select("d0", "d1", _r("v"))


@query("select s_suppkey as d0, (select max(p_size) from part) as v from supplier")
def fill_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = A.reduce(vector(spark, sf_dir, "part", "p_partkey", "p_size", T.int32), from_scalar(spark, 0, T.int32), Kind.MAX)
    s = vector(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", T.int32)
    return s.fill(most).df


@query("select c_custkey as d0, round(2 * c_acctbal, 4) as v from customer")
def copy_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (vector(spark, sf_dir, "customer", "c_custkey", "c_acctbal", T.float64) for _ in range(2))
    return I.copy(a, b, Kind.ADD).df.select("d0", _r("v", digits=4))


@query("select p_partkey as d0, p_size as v from part")
def copy_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vector(spark, sf_dir, "part", "p_partkey", "p_size", T.int32)
    return I.copy(create_store(spark, T.int32, s.shape), s).df


# --- indirection --------------------------------------------------------------------------------------------------------------------


def _line_stores(spark: SparkSession, sf_dir: str, key: str, value: str, t: T.ElementType) -> tuple[Store, Store]:
    """lineitem as two stores over orders and places: where a key points, and a value."""
    rows = _lines(spark, sf_dir, key, value).withColumn("p", F.struct(F.col(key).cast("long").alias("p0")))
    shape = (_extent(rows, "l_orderkey"), _extent(rows, "k"))
    place = ["l_orderkey", "k"]
    return from_table(rows, place, "p", shape, T.point(1)), from_table(rows, place, value, shape, t)


_NUMBERED = "(select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as k from lineitem)"


@query(f"select l_orderkey as d0, k as d1, round(p_retailprice, 4) as v from {_NUMBERED} join part on l_partkey = p_partkey")
def gather_part_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    ind, _ = _line_stores(spark, sf_dir, "l_partkey", "l_quantity", T.float64)
    prices = vector(spark, sf_dir, "part", "p_partkey", "p_retailprice", T.float64)
    target = create_store(spark, T.float64, ind.shape)
    return I.gather(target, prices, ind).df.select("d0", "d1", _r("v", digits=4))


@query("select o_orderkey as d0, round(o_totalprice + c_acctbal, 4) as v from orders join customer on o_custkey = c_custkey")
def gather_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = vector(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", T.float64)
    ind = _points(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return I.gather(totals, vector(spark, sf_dir, "customer", "c_custkey", "c_acctbal", T.float64), ind, Kind.ADD).df.select("d0", _r("v", digits=4))


@query("select c_custkey as d0, coalesce(k, -1) as v from customer left join (select o_custkey, max(o_orderkey) as k from orders group by 1) on o_custkey = c_custkey")
def scatter_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several orders go to one customer: the last one counts."""
    keys = vector(spark, sf_dir, "orders", "o_orderkey", "o_orderkey", T.int64)
    target = _zeros(spark, (_extent(_table(spark, sf_dir, "customer"), "c_custkey"),), T.int64, -1)
    return I.scatter(target, _points(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), keys).df


@query("select p_partkey as d0, coalesce(s, 0) as v from part left join (select l_partkey, sum(l_quantity) as s from lineitem group by 1) on l_partkey = p_partkey")
def scatter_add_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a list of points and quantities, added into a store over the parts."""
    parts = _extent(_table(spark, sf_dir, "part"), "p_partkey")
    ind, qty = _line_stores(spark, sf_dir, "l_partkey", "l_quantity", T.float64)
    return I.scatter(_zeros(spark, (parts,), T.float64), ind, qty, Kind.ADD).df


@query("select s_suppkey as d0, coalesce(m, -1.0) as v from supplier left join (select l_suppkey, max(l_quantity) as m from lineitem group by 1) on l_suppkey = s_suppkey")
def scatter_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    ind, qty = _line_stores(spark, sf_dir, "l_suppkey", "l_quantity", T.float64)
    target = _zeros(spark, (_extent(_table(spark, sf_dir, "supplier"), "s_suppkey"),), T.float64, -1.0)
    return I.scatter(target, ind, qty, Kind.MAX).df


@query("select r_regionkey as d0, coalesce(k, -1) as v from region left join (select n_regionkey, max_by(c_nationkey, o_orderkey) as k from orders join customer on o_custkey = c_custkey join nation on n_nationkey = c_nationkey group by 1) on n_regionkey = r_regionkey")
def scatter_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer's nation, found by the order's customer, goes to the region of the order's customer; the last order counts."""
    o = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = _extent(_table(spark, sf_dir, "orders"), "o_orderkey")
    target_ind = from_table(o.withColumn("p", F.struct(F.col("n_regionkey").cast("long").alias("p0"))), ["o_orderkey"], "p", (n,), T.point(1))
    source_ind = _points(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    target = _zeros(spark, (_extent(_table(spark, sf_dir, "region"), "r_regionkey"),), T.int32, -1)
    return I.scatter_gather(target, target_ind, vector(spark, sf_dir, "customer", "c_custkey", "c_nationkey", T.int32), source_ind).df


@query("select n_nationkey as d0, round(100 + coalesce(s, 0), 2) as v from nation left join (select c_nationkey, sum(c_acctbal) as s from orders join customer on o_custkey = c_custkey group by 1) on c_nationkey = n_nationkey")
def scatter_gather_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = _extent(_table(spark, sf_dir, "orders"), "o_orderkey")
    target_ind = from_table(o.withColumn("p", F.struct(F.col("c_nationkey").cast("long").alias("p0"))), ["o_orderkey"], "p", (n,), T.point(1))
    target = _zeros(spark, (_extent(_table(spark, sf_dir, "nation"), "n_nationkey"),), T.float64, 100.0)
    return I.scatter_gather(target, target_ind, vector(spark, sf_dir, "customer", "c_custkey", "c_acctbal", T.float64), _points(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), Kind.ADD).df.select("d0", _r("v", digits=2))


# --- reductions -----------------------------------------------------------------------------------------------------------------------


def _axis(kind: Kind, axis: int, start: float, digits: int = 6) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = embeddings(spark, sf_dir)
        view = A.rows_of(e) if axis == 0 else A.columns_of(e)
        out = A.reduce(view, _zeros(spark, (e.shape[1 - axis],), T.float64, start), kind)
        return out.df.select("d0", _r("v", digits=digits))

    return run


for _name, _axis_, _kind, _start, _sql in (
    ("sum_rows", 0, Kind.ADD, 1.0, "round(1.0 + sum(v), 6)"), ("sum_columns", 1, Kind.ADD, 0.0, "round(sum(v), 6)"), ("max_rows", 0, Kind.MAX, -9.0, "round(max(v), 6)"),
    ("min_columns", 1, Kind.MIN, 9.0, "round(min(v), 6)"),
):
    _f = _axis(_kind, _axis_, _start)
    _f.__name__ = _name
    query(f"select d{1 - _axis_} as d0, {_sql} as v from {_EMB} group by 1")(_f)


@query(f"select d0, round(product(1 + v), 6) as v from {_EMB} group by d0")
def product_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return A.transform_reduce(A.columns_of(e), _zeros(spark, (e.shape[0],), T.float64, 1.0), Kind.MUL, lambda v: v + 1).df.select("d0", _r("v"))


def _supplier_bits(kind: Kind, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = _extent(_table(spark, sf_dir, "supplier"), "s_suppkey")
        ind, parts = _line_stores(spark, sf_dir, "l_suppkey", "l_partkey", T.int64)
        return I.scatter(_zeros(spark, (n,), T.int64, lookup(kind, T.int64).identity), ind, parts, kind).df

    run.__name__ = f"{kind.value}_reduce"
    query(f"select s_suppkey as d0, coalesce(x, {0 if kind is not Kind.AND else -1}) as v from supplier left join (select l_suppkey, {sql}(l_partkey) as x from lineitem group by 1) on l_suppkey = s_suppkey")(run)


for _kind, _sql in ((Kind.XOR, "bit_xor"), (Kind.OR, "bit_or"), (Kind.AND, "bit_and")):
    _supplier_bits(_kind, _sql)


@query("select n_nationkey as d0, coalesce(a, false) as any_rich, coalesce(b, true) as all_rich, coalesce(c, false) as odd_rich from nation left join (select c_nationkey, bool_or(c_acctbal > 5000) as a, bool_and(c_acctbal > 5000) as b, count_if(c_acctbal > 5000) % 2 = 1 as c from customer group by 1) on c_nationkey = n_nationkey")
def bool_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _extent(_table(spark, sf_dir, "nation"), "n_nationkey")
    ind = _points(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    rich = from_table(_table(spark, sf_dir, "customer").withColumn("rich", F.col("c_acctbal") > 5000), ["c_custkey"], "rich", ind.shape, T.bool_)
    out = None
    for kind, name in ((Kind.ADD, "any_rich"), (Kind.MUL, "all_rich"), (Kind.XOR, "odd_rich")):
        own = I.scatter(_zeros(spark, (n,), T.bool_, lookup(kind, T.bool_).identity), ind, rich, kind).df.withColumnRenamed("v", name)
        out = own if out is None else out.join(own, "d0")
    return out


@query("select round(sum(c_acctbal * c_custkey), 2) as v from customer")
def dot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = vector(spark, sf_dir, "customer", "c_custkey", "c_acctbal", T.float64)
    b = vector(spark, sf_dir, "customer", "c_custkey", "c_custkey", T.float64)
    return A.transform_reduce2(a, b, from_scalar(spark, 0.0), Kind.ADD, lambda x, y: x * y).df.select(_r("v", digits=2))


@query("select 1000000 - sum(p_size) as v from part")
def minus_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vector(spark, sf_dir, "part", "p_partkey", "p_size", T.int64)
    return A.reduce(s, from_scalar(spark, 1_000_000), "minus").df.select("v")


@query("select row_number() over (order by l_suppkey) - 1 as d0, l_suppkey as v from (select distinct l_suppkey from lineitem)")
def unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("d0"), F.col("l_suppkey").alias("v"))
    s = create_store(spark, T.int64, ndim=1).write(df)
    return A.distinct(s).df


@query("select row_number() over (order by p_size) - 1 as d0, p_size as v from (select distinct p_size from part)")
def tree_reduce_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vector(spark, sf_dir, "part", "p_partkey", "p_size", T.int32)
    return A.tree_reduce(s, lambda v: v.drop_duplicates().sort_values()).df


@query("select l_orderkey // 100 as c0, min(l_partkey) as lo0, max(l_partkey) as hi0 from lineitem group by 1")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 100").alias("c0"), F.struct(F.col("l_partkey").alias("p0")).alias("p"))
    return A.bounding_boxes(points, ["c0"], "p", 1)


@query("select l_orderkey, sum(n) over (order by l_orderkey) - n as lo, sum(n) over (order by l_orderkey) - 1 as hi from (select l_orderkey, count(*) as n from lineitem group by 1)")
def offsets_to_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return A.sizes_to_ranges(sizes, "l_orderkey", "n")


@query("select l_orderkey, count(*) as size from lineitem group by 1")
def ranges_to_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ranges_to_sizes(offsets_to_ranges(spark, sf_dir), "l_orderkey")


@query("select c_nationkey as d0, round(sum(c_acctbal), 2) as re, round(-2 * sum(c_acctbal), 2) as im from customer group by 1")
def complex_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _extent(_table(spark, sf_dir, "nation"), "n_nationkey")
    ind = _points(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    z = F.struct(F.col("c_acctbal").alias("re"), (-2 * F.col("c_acctbal")).alias("im"))
    both = from_table(_table(spark, sf_dir, "customer").withColumn("z", z), ["c_custkey"], "z", ind.shape, T.complex128)
    out = I.scatter(_zeros(spark, (n,), T.complex128, 0j), ind, both, Kind.ADD).df
    used = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("d0")).distinct()
    return out.join(used, "d0", "left_semi").select("d0", _r("v.re", "re", 2), _r("v.im", "im", 2))


# --- element-wise -------------------------------------------------------------------------------------------------------------------------


@query("select p_partkey as d0, round(sqrt(p_retailprice), 6) as v from part")
def transform_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vector(spark, sf_dir, "part", "p_partkey", "p_retailprice", T.float64)
    return A.transform(s, create_store(spark, T.float64, s.shape), F.sqrt).df.select("d0", _r("v"))


@query("select p_partkey as d0, round(p_retailprice * p_size, 4) as v from part")
def transform_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = vector(spark, sf_dir, "part", "p_partkey", "p_retailprice", T.float64)
    b = vector(spark, sf_dir, "part", "p_partkey", "p_size", T.float64)
    return A.transform2(a, b, create_store(spark, T.float64, a.shape), lambda x, y: x * y).df.select("d0", _r("v", digits=4))


@query("select p_partkey as d0, p_size * 2 + 1 as v from part")
def for_each_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vector(spark, sf_dir, "part", "p_partkey", "p_size", T.int32)
    A.for_each(lambda v: v * 2 + 1, s)
    return s.df


@query("select p_partkey as d0, cast(p_size as double) as a, p_retailprice as b from part")
def for_each_zip_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = vector(spark, sf_dir, "part", "p_partkey", "p_retailprice", T.float64)
    b = vector(spark, sf_dir, "part", "p_partkey", "p_size", T.float64)
    A.for_each(lambda x, y: (y, x), a, b)
    return a.df.withColumnRenamed("v", "a").join(b.df.withColumnRenamed("v", "b"), "d0")


@query(f"select d0 * (select max(len(embedding)) from embeddings) + d1 as i, round(v, 6) as v from {_EMB}")
def elements_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.elements_of(embeddings(spark, sf_dir)).select("i", _r("v"))


# --- partitions -----------------------------------------------------------------------------------------------------------------------------


@query(f"select d0 // 100 as c0, d1 // 16 as c1, round(sum(v), 6) as v, count(*) as n from {_EMB} group by 1, 2")
def tiling_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).partition_by_tiling((100, 16)).df.groupBy("c0", "c1").agg(F.sum("v").alias("s"), F.count("*").alias("n")).select("c0", "c1", _r("s", "v"), "n")


@query(f"select d0 - 100 as d0, d1 - 48 as d1, round(v, 6) as v from {_EMB} where d0 >= 100 and d0 < 200 and d1 >= 48")
def child_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).partition_by_tiling((100, 16)).get_child_store(1, 3).df.select("d0", "d1", _r("v"))


@query("select o_orderkey // 1000 as c0, round(sum(o_totalprice * o_custkey), 2) as v from orders group by 1")
def align_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = vector(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", T.float64)
    b = vector(spark, sf_dir, "orders", "o_orderkey", "o_custkey", T.float64)
    both = C.zip_aligned(a.partition_by_tiling((1000,)), b.partition_by_tiling((1000,)))
    return both.groupBy("c0").agg(F.round(F.sum(F.col("v0") * F.col("v1")), 2).alias("v"))


@query("select c as c0, r_regionkey as d0, r_regionkey as v from region, (select unnest(range((select (max(n_nationkey) + 10) // 10 from nation))) as c)")
def broadcast_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiled = vector(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", T.int32).partition_by_tiling((10,))
    return C.broadcast(vector(spark, sf_dir, "region", "r_regionkey", "r_regionkey", T.int32), tiled)


@query("select distinct o_orderkey // 500 as c0, c_custkey as d0, c_nationkey as v from orders join customer on o_custkey = c_custkey")
def image_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each tile of orders, the customers it refers to."""
    func = _points(spark, sf_dir, "orders", "o_orderkey", "o_custkey").partition_by_tiling((500,))
    return C.image(func, vector(spark, sf_dir, "customer", "c_custkey", "c_nationkey", T.int32))


@query("select c0, c_custkey as d0, c_nationkey as v from customer join (select o_orderkey // 500 as c0, min(o_custkey) as lo, max(o_custkey) as hi from orders group by 1) on c_custkey between lo and hi")
def image_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    func = _points(spark, sf_dir, "orders", "o_orderkey", "o_custkey").partition_by_tiling((500,))
    return C.image(func, vector(spark, sf_dir, "customer", "c_custkey", "c_nationkey", T.int32), C.Hint.MIN_MAX)


@query("select distinct s_suppkey // 3 as c0, n_nationkey as d0, n_regionkey as v from supplier join nation on n_nationkey between s_nationkey - 1 and s_nationkey + 1")
def image_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "supplier")
    p = lambda d: F.struct((F.col("s_nationkey") + d).cast("long").alias("p0"))
    func = from_table(df.withColumn("r", F.struct(p(-1).alias("lo"), p(1).alias("hi"))), ["s_suppkey"], "r", (_extent(df, "s_suppkey"),), T.rect(1))
    return C.image(func.partition_by_tiling((3,)), vector(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", T.int32))


@query(f"select d0, d1, round(max(v) over (partition by d0 order by d1 rows between 1 preceding and 2 following), 6) as v from {_EMB}")
def halo_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stencil(embeddings(spark, sf_dir), 1, 1, 2, F.max).select("d0", "d1", _r("v"))


@query("select event_id as d0, round(sum(value) over (order by event_id rows between 3 preceding and 1 following), 6) as v from events")
def halo_sum_long_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single long axis in tiles with ghost cells."""
    return C.stencil(vector(spark, sf_dir, "events", "event_id", "value", T.float64), 0, 3, 1, F.sum, tile=1 << 12).select("d0", _r("v"))


@query("select c as c0, event_id as d0, round(value, 6) as v from events, (select unnest(range((select (max(event_id) + 1000) // 1000 from events))) as c) where event_id >= c * 1000 - 2 and event_id < (c + 1) * 1000 + 5")
def bloat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vector(spark, sf_dir, "events", "event_id", "value", T.float64)
    return C.bloat(s.partition_by_tiling((1000,)), s, (2,), (5,)).select("c0", "d0", _r("v"))


@query("select event_id // 8 as d0, cast(sum(case when value > 50 then 1 << (event_id % 8) else 0 end) as smallint) as v from events group by 1")
def scale_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight cells of the big store for each cell of the small one: bits become bytes."""
    s = vector(spark, sf_dir, "events", "event_id", "value", T.float64)
    small = create_store(spark, T.uint8, (-(-s.shape[0] // 8),)).partition_by_tiling((64,))
    big = C.scale((8,), small, s)
    packed = big.groupBy(F.expr("d0 div 8").alias("d0")).agg(F.sum(F.when(F.col("v") > 50, F.expr("shiftleft(1, cast(d0 % 8 as int))")).otherwise(0)).cast("smallint").alias("v"))
    return packed


# --- tasks -------------------------------------------------------------------------------------------------------------------------------------


@K.task
def _saxpy(x: K.InputStore, y: K.InputStore, out: K.OutputStore, a: float):
    out.array[:] = a * x.array + y.array


@K.task
def _histogram(x: K.InputStore, out: K.ReductionStore[Kind.ADD], bins: int):
    out.array[:] += np.bincount((x.array.reshape(-1) * bins / 51).astype(int).clip(0, bins - 1), minlength=bins)


@K.task(constraints=[K.bloat("x", "halo", (1,), (1,))])
def _smooth(x: K.InputStore, halo: K.InputStore, out: K.OutputStore):
    first = out.origin[0] - halo.origin[0]
    padded = np.concatenate([[0.0] * (1 - first), halo.array, [0.0]])
    n = len(out.array)
    out.array[:] = padded[:n] + padded[1 : n + 1] + padded[2 : n + 2]


@K.task
def _above(x: K.InputStore, out: K.OutputStore, least: int):
    out.bind_data(x.array[x.array >= least])


@query("select p_partkey as d0, round(2.5 * p_size + p_retailprice, 4) as v from part")
def task_saxpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vector(spark, sf_dir, "part", "p_partkey", "p_size", T.float64)
    y = vector(spark, sf_dir, "part", "p_partkey", "p_retailprice", T.float64)
    out = create_store(spark, T.float64, x.shape)
    _saxpy(x, y, out, 2.5)
    return out.df.select("d0", _r("v", digits=4))


@query("select b as d0, count(p_partkey) as v from (select unnest(range(17)) as b) left join part on least(p_size * 17 // 51, 16) = b group by 1")
def task_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vector(spark, sf_dir, "part", "p_partkey", "p_size", T.int64)
    out = _zeros(spark, (17,), T.int64)
    _histogram(x, out, 17)
    return out.df


@query("select event_id as d0, round(sum(value) over (order by event_id rows between 1 preceding and 1 following), 6) as v from events")
def task_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.scope import ParallelPolicy, Scope

    x = vector(spark, sf_dir, "events", "event_id", "value", T.float64)
    out = create_store(spark, T.float64, x.shape)
    with Scope(spark, ParallelPolicy(threshold=64)):
        _smooth(x, x, out)
    return out.df.select("d0", _r("v"))


@query("select row_number() over (order by p_partkey) - 1 as d0, p_size as v from part where p_size >= 30")
def task_unbound_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.scope import ParallelPolicy, Scope

    x = vector(spark, sf_dir, "part", "p_partkey", "p_size", T.int32)
    out = create_store(spark, T.int32, ndim=1)
    with Scope(spark, ParallelPolicy(threshold=64)):
        _above(x, out, 30)
    return out.df


# --- files ----------------------------------------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    import atexit
    import shutil
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    base = "/" + base.removeprefix("file:").lstrip("/") if base.startswith("file:") else base
    if "://" in base:
        raise ValueError(f"raw files are written in place, which needs a shared POSIX folder, not {base}")
    path = f"{base}/arrays-{uuid.uuid4().hex}"
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


@query("select p_partkey as d0, p_retailprice as v from part")
def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, path = vector(spark, sf_dir, "part", "p_partkey", "p_retailprice", T.float64), _folder(spark)
    raw.to_file(f"{path}/prices", s)
    return raw.from_file(spark, f"{path}/prices", T.float64).df


@query(f"select d0, d1, round(v, 6) as v from {_EMB}")
def tiles_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a store filled up to whole tiles, of which a view holds the table."""
    s, path, tile = embeddings(spark, sf_dir), _folder(spark), (500, 32)
    whole = _zeros(spark, tuple(-(-n // t) * t for n, t in zip(s.shape, tile)), T.float64)
    whole[: s.shape[0], : s.shape[1]].write(s.df)
    raw.to_tiles(path, whole, tile)
    back = raw.from_tiles(spark, path, whole.shape, T.float64, tile)
    return back[: s.shape[0], : s.shape[1]].df.select("d0", "d1", _r("v"))


@query(f"select d0, d1, round(v, 6) as v from {_EMB}")
def zarr_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, path = embeddings(spark, sf_dir), _folder(spark)
    zarr.write_array(s, path + "/z", (97, 25))
    return zarr.read_array(spark, path + "/z").df.select("d0", "d1", _r("v"))


@query("select p_partkey as d0, cast(p_size as double) as v from part")
def reinterpret_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """float64 as int64 and back."""
    s = vector(spark, sf_dir, "part", "p_partkey", "p_size", T.float64)
    return s.reinterpret_as(T.int64).reinterpret_as(T.float64).df


@query("select n_nationkey as d0, n_regionkey as v from nation")
def attach_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store to the driver and back, through NumPy."""
    return from_numpy(spark, vector(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", T.int32).to_numpy()).df


@query("select n_nationkey as d0, n_regionkey as v from nation")
def attach_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers of seven cells each as the tiles of one store."""
    a = vector(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", T.int32).to_numpy()
    return from_tiles(spark, a.shape, (7,), T.int32, [(a[k : k + 7], (k // 7,)) for k in range(0, len(a), 7)]).df


@query("select (g - 1 - p_partkey // t) * t + p_partkey % t as d0, p_retailprice as v from part, (select gcd(n, 8) as g, n // gcd(n, 8) as t from (select max(p_partkey) + 1 as n from part))")
def read_at_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's tiles, the last one first."""
    s, path = vector(spark, sf_dir, "part", "p_partkey", "p_retailprice", T.float64), _folder(spark)
    raw.to_file(f"{path}/prices", s)
    g = math.gcd(s.shape[0], 8)
    tile = s.shape[0] // g
    return raw.from_offsets(spark, f"{path}/prices", s.shape, T.float64, [k * tile * 8 for k in reversed(range(g))], (tile,)).df


@query(f"select d0, d1, round(v, 6) as v from {_EMB}")
def zarr_default_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, path = embeddings(spark, sf_dir), _folder(spark)
    zarr.write_array(s, path + "/z")
    return zarr.read_array(spark, path + "/z").df.select("d0", "d1", _r("v"))


@query(f"select d0 - 100 as d0, d1 - 8 as d1, round(v, 6) as v from {_EMB} where d0 between 100 and 149 and d1 between 8 and 23")
def zarr_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of an array in files reads the chunks that it meets."""
    s, path = embeddings(spark, sf_dir), _folder(spark)
    zarr.write_array(s, path + "/z", (50, 8))
    return zarr.read_array(spark, path + "/z")[100:150, 8:24].df.select("d0", "d1", _r("v"))


# --- rarer operators ----------------------------------------------------------------------------------------------------------------------------


@query("select o_orderkey as d0, round(case when o_custkey % 2 = 0 then c_acctbal else o_totalprice end, 4) as v from orders join customer on o_custkey = c_custkey")
def gather_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points outside of the source leave the target's cell as it is."""
    df = _table(spark, sf_dir, "orders").withColumn("p", F.struct(F.when(F.expr("o_custkey % 2 = 0"), F.col("o_custkey")).otherwise(-1).cast("long").alias("p0")))
    totals = vector(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", T.float64)
    ind = from_table(df, ["o_orderkey"], "p", totals.shape, T.point(1))
    return I.gather(totals, vector(spark, sf_dir, "customer", "c_custkey", "c_acctbal", T.float64), ind).df.select("d0", _r("v", digits=4))


@query(f"select d0 as vec_id, d1 as pos, round(v * 2 + 1, 6) as v from {_EMB}")
def elementwise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of elements, lifted to whole rows in array form."""
    twice = A.elementwise(lambda v: v.cast("double") * 2 + 1)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(twice(F.col("embedding"))).alias("pos", "v")).select("vec_id", "pos", _r("v"))


@query(f"select d1 // 16 as d0, round(sum(v), 6) as v from {_EMB} group by 1")
def sum_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reduction over two axes of three."""
    e = embeddings(spark, sf_dir)
    planes = e.delinearize(1, (e.shape[1] // 16, 16))
    return A.reduce(A.projections_of(planes, 0, 2), _zeros(spark, (planes.shape[1],), T.float64), Kind.ADD).df.select("d0", _r("v"))


def _norm(v: np.ndarray) -> float:
    return float(np.sqrt((v * v).sum()))


@query(f"select d0, round(sqrt(sum(v * v)), 6) as v from {_EMB} group by 1")
def custom_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    try:
        name = register("norm", T.float64, _norm, 0.0)
    except ValueError:  # by an earlier call
        name = "norm"
    return A.reduce(A.columns_of(e), _zeros(spark, (e.shape[0],), T.float64), name).df.select("d0", _r("v"))


@query("select r as rank, l_linenumber, s as qty from (select l_linenumber, sum(l_quantity) as s from lineitem group by 1), (select unnest(range(4)) as r)")
def all_reduce_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of four tasks gets the sums over all tasks, by the place in their buffers."""
    rows = _table(spark, sf_dir, "lineitem").select(F.expr("cast(l_suppkey % 4 as int)").alias("rank"), "l_linenumber", F.col("l_quantity").alias("qty"))
    return collectives.all_reduce(rows, 4, ["qty"], Kind.ADD, T.float64, "l_linenumber")


@query(f"select d0 // 100 as c0, c as c1, round(sum(v), 6) as v, count(*) as n from {_EMB}, (select unnest(range((select (max(len(embedding)) + 15) // 16 from embeddings))) as c) group by 1, 2")
def broadcast_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that see one axis whole and the other one cut."""
    e = embeddings(spark, sf_dir)
    seen = C.broadcast(e, e.partition_by_tiling((100, 16)), (1,))
    return seen.groupBy("c0", "c1").agg(F.sum("v").alias("s"), F.count("*").alias("n")).select("c0", "c1", _r("s", "v"), "n")


@query("select event_id // t as c0, round(sum(value), 4) as v, count(*) as n from events, (select greatest((n + 7) // 8, least(1000, n)) as t from (select max(event_id) + 1 as n from events)) group by 1")
def least_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight tiles, unless they would be shorter than a thousand cells."""
    tiled = C.auto_tiles(vector(spark, sf_dir, "events", "event_id", "value", T.float64), 8, (1000,), threshold=1)
    return tiled.df.groupBy("c0").agg(F.sum("v").alias("s"), F.count("*").alias("n")).select("c0", _r("s", "v", 4), "n")


@query("select c0, c_custkey as d0, c_nationkey as v from customer join (select o_orderkey // 500 as c0, arg_min(o_custkey, o_orderkey) as a, arg_max(o_custkey, o_orderkey) as b from orders group by 1) on c_custkey between least(a, b) and greatest(a, b)")
def image_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    func = _points(spark, sf_dir, "orders", "o_orderkey", "o_custkey").partition_by_tiling((500,))
    return C.image(func, vector(spark, sf_dir, "customer", "c_custkey", "c_nationkey", T.int32), C.Hint.FIRST_LAST)


@query("select p_partkey // 10 as d0, cast(product(p_size % 3 + 1) as bigint) as v from part group by 1")
def product_of_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact products of integers, scattered into tens of parts."""
    df = _table(spark, sf_dir, "part").select("p_partkey", F.struct(F.expr("p_partkey div 10").alias("p0")).alias("p"), F.expr("cast(p_size % 3 + 1 as bigint)").alias("v"))
    n = _extent(df, "p_partkey")
    target = _zeros(spark, (-(-n // 10),), T.int64, 1)
    return I.scatter(target, from_table(df, ["p_partkey"], "p", (n,), T.point(1)), from_table(df, ["p_partkey"], "v", (n,), T.int64), Kind.MUL).df


@query("select round(1e18 / product(n_regionkey + 1), 3) as v from nation")
def divides_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vector(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", T.float64)
    A.for_each(lambda v: v + 1, s)
    return A.reduce(s, from_scalar(spark, 1e18), "divides").df.select(_r("v", digits=3))


@K.task
def _twice(x: K.InputStore, out: K.OutputStore):
    out.array[:] = 2 * x.array


@query("select (g - 1 - p_partkey // t) * t + p_partkey % t as d0, 2.0 * p_retailprice as v from part, (select gcd(n, 4) as g, n // gcd(n, 4) as t from (select max(p_partkey) + 1 as n from part))")
def manual_launch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Launch points that see the tiles from the last one on, through a symbolic projection."""
    x = vector(spark, sf_dir, "part", "p_partkey", "p_retailprice", T.float64)
    out, g = create_store(spark, T.float64, x.shape), math.gcd(x.shape[0], 4)
    call = K.ManualTask(_twice, (g,))
    call.add_input("x", x.partition_by_tiling((x.shape[0] // g,)), [K.dimension(0) * -1 + (g - 1)])
    call.add_output("out", out.partition_by_tiling((x.shape[0] // g,)))
    call.execute()
    return out.df


@K.task
def _with_index(ctx: K.TaskContext, x: K.InputStore, out: K.OutputStore):
    out.array[:] = x.array + 1000 * ctx.task_index[0] + 100_000 * ctx.launch_domain[0]


@query("select p_partkey as d0, p_size + 1000 * (p_partkey // t) + 100000 * g as v from part, (select gcd(n, 4) as g, n // gcd(n, 4) as t from (select max(p_partkey) + 1 as n from part))")
def task_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that know their place in the launch."""
    x = vector(spark, sf_dir, "part", "p_partkey", "p_size", T.int64)
    out, g = create_store(spark, T.int64, x.shape), math.gcd(x.shape[0], 4)
    call = K.ManualTask(_with_index, (g,))
    call.add_input("x", x.partition_by_tiling((x.shape[0] // g,)))
    call.add_output("out", out.partition_by_tiling((x.shape[0] // g,)))
    call.execute()
    return out.df


@query("select p_partkey as d0, round(0.5 * p_retailprice + p_size, 4) as v from part")
def prepared_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call that is prepared, constrained and executed in steps."""
    x = vector(spark, sf_dir, "part", "p_partkey", "p_retailprice", T.float64)
    y = vector(spark, sf_dir, "part", "p_partkey", "p_size", T.float64)
    out = create_store(spark, T.float64, x.shape)
    call = _saxpy.prepare_call(x, y, out=out, a=0.5)
    call.add_constraint(K.min_extents("x", (64,)))
    call.execute()
    return out.df.select("d0", _r("v", digits=4))


@query("select s_suppkey as d0, round(s_acctbal, 2) as v from supplier")
def file_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/balances"
    with raw.FileHandle(spark, path, "w") as f:
        f.write(vector(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal", T.float64))
    with raw.FileHandle(spark, path) as f:
        return f.read(T.float64).df.select("d0", _r("v", digits=2))


@query("select n_nationkey as d0, n_regionkey * 2 as v from nation")
def dlpack_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store out and in through the DLPack protocol."""
    a = np.from_dlpack(vector(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", T.int32))
    return from_numpy(spark, a * np.int32(2)).df


@query("select a.k as a, b.k as b, abs(a.k - b.k) < 3 as meet, a.k = b.k as same from (select unnest(range(5)) as k) a, (select unnest(range(5)) as k) b")
def overlapping_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which views of three rows share cells, and which lie in the same place."""
    e = embeddings(spark, sf_dir)
    views = [e[k : k + 3] for k in range(5)]
    said = [(a, b, x.overlaps(y), x.equal_storage(y) and x.view == y.view) for a, x in enumerate(views) for b, y in enumerate(views)]
    return spark.createDataFrame(said, "a long, b long, meet boolean, same boolean")


@query("select r as rank, l_suppkey % 4 as sender, count(*) as n, sum(l_quantity) as qty from lineitem, (select unnest(range(4)) as r) group by 1, 2")
def all_gather_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every one of four tasks gets the others' rows."""
    rows = _table(spark, sf_dir, "lineitem").select(F.expr("cast(l_suppkey % 4 as int)").alias("rank"), F.col("l_quantity").alias("qty"))
    return collectives.all_gather(rows, 4).groupBy("rank", "sender").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query("select l_partkey % 3 as rank, l_suppkey % 4 as sender, count(*) as n, sum(l_quantity) as qty from lineitem group by 1, 2")
def all_to_all_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that name the task which they go to."""
    rows = _table(spark, sf_dir, "lineitem").select(F.expr("cast(l_suppkey % 4 as int)").alias("rank"), F.expr("cast(l_partkey % 3 as int)").alias("to"), F.col("l_quantity").alias("qty"))
    return collectives.all_to_all(rows).groupBy("rank", "sender").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))
