"""Connected components of a table of links by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stage, unstage


def _local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of one batch as stars: each node with the smallest of its part there."""
    for rows in parts:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(p, p)
            return x

        for a, b in zip(rows.a.tolist(), rows.b.tolist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in list(up) if (r := root(x)) != x]
        yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def components(links: DataFrame, a: str = "a", b: str = "b", native: bool = False) -> DataFrame:
    """node, component (smallest node reachable) for every node that has a link to another.

    Links with a null end or to itself join nothing. native: no Python on the executors.
    """
    ready(links.sparkSession)
    start = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a != b")
    if not native:
        start = start.mapInPandas(_local, "a long, b long")  # fewer links, same components
    edges = stage(start.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours go to the smallest
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a != b").distinct()
        new = stage(small, "links")
        # Done when every node points to one node and that node points to none.
        open_ = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        unstage(edges)
        edges = new
        if not open_:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
