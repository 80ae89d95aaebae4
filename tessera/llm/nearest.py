"""Approximate nearest neighbours (op5): multiprobe p-stable hashing with exact reranking.

The measure is the inner product. Candidates are in BANDS by their norms, so that a few long ones don't put all others into one bucket; in
each, they get one more component, sqrt(M^2 - |x|^2) with M the band's largest norm, and queries are scaled to norm M with a 0 there: Euclidean distance in that space orders candidates as the inner product does. Each of TABLES tables hashes a
vector by floor((a.x + b) / w) for a few normal directions a. A query visits its own bucket and then perturbed ones, in order of
estimated success: the sum of squared distances to the walls that the perturbation crosses. Candidates from all tables are
ranked by their exact inner product in double precision.

The number of directions, the width and the number of probes are fitted on at most SAMPLE vectors and TRIAL queries: the fewest
probes that find AIM of the trial queries' nearest neighbours in the band's sample (which are farther than the table's, so harder). Every vector is
indexed. A query that finds fewer than `k` candidates is compared with all vectors, in blocks of queries; so are all queries where
MOST_PROBES don't find AIM.

Equal vectors are one entry with their k + 1 smallest ids, which is all that a query can need of them. Buckets are spread over groups of
tasks, and a bucket of more than HOT entries over several tasks.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id; vectors of
different lengths aren't compared; equal rows (id and vector) count once; an empty table gives no rows; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready, stage, table

TABLES, DIRECTIONS, WIDTH, FAR = 6, 4, 0.9, 5
SAMPLE, TRIAL, AIM, MOST_PROBES = 8000, 120, 0.97, 1500
#: Bands of norms, each up to twice that of the next one; the last one holds all that are shorter.
BANDS = 8
PER_GROUP, HOT, QUERY_BLOCK = 40_000, 20_000, 2048


class Hashing:
    """The directions and offsets of all tables for vectors of one length; norm is M."""

    def __init__(self, dim: int, norm: float) -> None:
        rng = np.random.Generator(np.random.PCG64(dim))
        self.norm = norm or 1.0
        self.a = rng.standard_normal((TABLES, DIRECTIONS, dim + 1))
        self.b = rng.uniform(0, WIDTH, (TABLES, DIRECTIONS))
        self.mult = rng.integers(1, 1 << 62, (DIRECTIONS,), dtype=np.int64) * 2 + 1

    def spots(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """(table, vector, direction): place in units of the width."""
        size = np.sqrt((x * x).sum(1))
        if queries:
            full = np.concatenate([x / size[:, None], np.zeros((len(x), 1))], 1)
        else:
            x = x / self.norm
            full = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]], 1)
        return (np.einsum("tkd,nd->tnk", self.a, full) + self.b[:, None, :]) / WIDTH

    def keys(self, cells: np.ndarray) -> np.ndarray:
        return (cells * self.mult).sum(-1)

    def probes(self, spot: np.ndarray, most: int) -> np.ndarray:
        """Cells of one query in one table: its own, then perturbed ones in order of their scores. A direction may move FAR cells."""
        cell = np.floor(spot).astype(np.int64)
        moves = np.arange(-FAR, FAR + 1)
        inside = (spot - cell)[:, None]
        wall = np.where(moves < 0, inside - moves - 1, np.where(moves > 0, moves - inside, 0.0)) ** 2  # how far beyond the wall each cell lies
        score = wall[0]
        for d in range(1, DIRECTIONS):
            score = np.add.outer(score, wall[d])
        score = score.reshape(-1)
        most = min(most, len(score))
        best = np.argpartition(score, most - 1)[:most]
        best = best[np.lexsort((best, score[best]))]
        return cell + np.stack(np.unravel_index(best, (len(moves),) * DIRECTIONS), 1) - FAR


def fit_probes(h: Hashing, sample: np.ndarray, ids: np.ndarray, trial: np.ndarray, trial_ids: np.ndarray, k: int) -> int | None:
    """Probes a table so that AIM of the trial queries' neighbours in the sample are met in some table; None if MOST_PROBES don't get there."""
    if len(sample) < 2:
        return 1
    near = trial @ sample.T
    near[trial_ids[:, None] == ids[None, :]] = -np.inf
    k = min(k, len(sample) - 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    keys, spots = h.keys(np.floor(h.spots(sample, False)).astype(np.int64)), h.spots(trial, True)
    first = np.full(best.shape, 1 << 30)
    limit = MOST_PROBES
    for q in range(len(trial)):
        for t in range(TABLES):
            visited = h.keys(h.probes(spots[t, q], limit))
            order = np.argsort(visited, kind="stable")
            want = keys[t, best[q]]
            at = np.minimum(np.searchsorted(visited[order], want), len(visited) - 1)
            met = visited[order][at] == want
            first[q] = np.where(met, np.minimum(first[q], order[at]), first[q])
    ranks = np.sort(first.reshape(-1))
    wanted = int(ranks[min(len(ranks) - 1, int(AIM * len(ranks)))]) + 1
    return wanted if wanted <= limit else None


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, x (binary doubles), of rows that take part."""
    v = F.col("v")
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.where(~bad & F.exists(v, lambda x: x != 0))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield pd.DataFrame({"id": rows["id"], "dim": rows.v.map(len), "x": [(np.asarray(v, "<f8") + 0.0).tobytes() for v in rows.v], "norm": [float(np.sqrt((np.asarray(v, float) ** 2).sum())) for v in rows.v]})

    return own.mapInPandas(run, "id long, dim int, x binary, norm double")


def ranked(q_ids: np.ndarray, scores: list[np.ndarray], ids: list[np.ndarray], k: int) -> pd.DataFrame:
    """The k best of each query's candidates (score, then smaller id)."""
    out_q, out_v, out_s = [], [], []
    for q, s, v in zip(q_ids.tolist(), scores, ids):
        own = v != q
        s, v = s[own], v[own]
        order = np.lexsort((v, -s))[:k]
        out_q.append(np.full(len(order), q))
        out_v.append(v[order])
        out_s.append(s[order])
    if not out_q:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def expand(entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all entries in a row, and where each entry's begin."""
    return (np.concatenate(entries) if entries else np.zeros(0, np.int64)), np.cumsum([0, *map(len, entries)])


def exactly(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """All candidates of a few queries, in blocks of queries."""
    spark, out = vectors.sparkSession, None
    blocks = queries.select("id", "dim", "x").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(1 + queries.count() // QUERY_BLOCK)))
    for b in [r.block for r in blocks.select("block").distinct().collect()]:
        sent = spark.sparkContext.broadcast(blocks.where(F.col("block") == b).toPandas())

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in parts:
                for dim, own in rows.groupby("dim"):
                    q = sent.value[sent.value.dim == dim]
                    if len(q):
                        score = matrix(q.x) @ matrix(own.x).T
                        yield ranked(q["id"].to_numpy(), list(score), [own["id"].to_numpy()] * len(q), k)

        part = vectors.select("id", "dim", "x").mapInPandas(run, "query_id long, vec_id long, score double")
        out = part if out is None else out.union(part)
    return out


def nearest(df: DataFrame, id_col: str, vector_col: str, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row whose id is divisible by `every`."""
    spark = ready(df.sparkSession)
    vectors = stage(valid(df, id_col, vector_col).distinct(), "vectors")
    # Spark limits each group before the shuffle too, so no task gets all ids of a common vector.
    turn = F.row_number().over(Window.partitionBy("dim", "x", "norm").orderBy("id"))
    least = vectors.withColumn("turn", turn).where(F.col("turn") <= k + 1)
    entries = stage(least.groupBy("dim", "x", "norm").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("id")), "entries")
    queries = stage(vectors.where(F.col("id") % every == 0).select("id", "dim", "x"), "queries")
    top = entries.groupBy("dim").agg(F.max("norm").alias("most"))
    band = F.least(F.floor(F.log2(F.col("most") / F.col("norm"))), F.lit(BANDS - 1)).cast("int")
    entries = stage(entries.join(F.broadcast(top), "dim").select("dim", "x", "norm", "ids", "id", band.alias("band")), "banded")
    shapes = entries.groupBy("dim", "band").agg(F.max("norm").alias("norm"), F.count("*").alias("n")).collect()
    if not shapes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan: dict[int, dict[int, tuple[Hashing, int, int]]] = {}
    exact = set()
    trials = {d: entries.where(F.col("dim") == d).select("id", "x").orderBy(F.xxhash64("id", F.lit(3))).limit(TRIAL).toPandas() for d in {r.dim for r in shapes}}
    for r in shapes:
        h = Hashing(r.dim, r.norm)
        own = entries.where((F.col("dim") == r.dim) & (F.col("band") == r.band)).select("id", "x").orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas()
        trial = trials[r.dim]
        probes = fit_probes(h, matrix(own.x), own["id"].to_numpy(), matrix(trial.x), trial["id"].to_numpy(), k)
        if probes is None:  # all queries of this length go the exact way
            exact.add(r.dim)
        plan.setdefault(r.dim, {})[r.band] = (h, probes, 1 + r.n // PER_GROUP)
    plan = {d: bands for d, bands in plan.items() if d not in exact}
    sent = spark.sparkContext.broadcast(plan)

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for (dim, band), own in rows.groupby(["dim", "band"]):
                if dim not in sent.value:
                    continue
                h, _, groups = sent.value[dim][band]
                keys = h.keys(np.floor(h.spots(matrix(own.x), False)).astype(np.int64))
                for t in range(TABLES):
                    yield pd.DataFrame({"dim": dim, "t": band * TABLES + t, "g": (keys[t] >> 7) % groups, "key": keys[t], "ids": own.ids, "x": own.x})

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for dim, own in rows.groupby("dim"):
                out = []
                for band, (h, probes, groups) in sent.value.get(dim, {}).items():
                    spots = h.spots(matrix(own.x), True)
                    for q, (i, x) in enumerate(zip(own["id"].tolist(), own.x)):
                        for t in range(TABLES):
                            keys = np.unique(h.keys(h.probes(spots[t, q], probes)))
                            g = (keys >> 7) % groups
                            out += [(dim, band * TABLES + t, int(s), i, x, keys[g == s].tobytes()) for s in np.unique(g)]
                yield pd.DataFrame(out, columns=["dim", "t", "g", "id", "x", "keys"])

    indexed = stage(entries.mapInPandas(index, "dim int, t int, g int, key long, ids array<long>, x binary"), "index")
    sizes = indexed.groupBy("dim", "t", "g").agg(F.ceil(F.count("*") / (PER_GROUP + HOT)).cast("int").alias("tasks"))
    asked = queries.mapInPandas(probe, "dim int, t int, g int, id long, x binary, keys binary")
    place = ["dim", "t", "g"]
    sizes = stage(sizes, "sizes")
    indexed = indexed.join(sizes, place).select(*place, F.pmod(F.xxhash64("ids"), F.col("tasks")).cast("int").alias("task"), "key", "ids", "x")
    copies = spark.read.schema(sizes.schema).parquet(sizes.staged_path)
    asked = asked.join(copies, place).select(*place, F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "id", "x", "keys")

    def meet(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(asked):
            return ranked(np.zeros(0), [], [], k)
        entries = entries.sort_values("key", kind="stable")
        key, x = entries.key.to_numpy(), matrix(entries.x)
        ids, first = expand([np.asarray(i) for i in entries.ids])
        size = np.diff(first)
        scores, found = [], []
        for q, keys in zip(asked.x, asked["keys"]):
            keys = np.frombuffer(keys, np.int64)
            lo, hi = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s = x[at] @ np.frombuffer(q, "<f8")
            if len(at) > 4 * k:  # entries below the best k + 1 can't be among the nearest
                top = s >= np.partition(s, -(k + 1))[-(k + 1)]
                at, s = at[top], s[top]
            m = size[at]
            scores.append(np.repeat(s, m))
            found.append(ids[np.repeat(first[at], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)])
        return ranked(asked["id"].to_numpy(), scores, found, k)

    by = [*place, "task"]
    found = indexed.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, score double")
    found = stage(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    per = found.groupBy("query_id").agg(F.count("*").alias("n"))
    few = stage(queries.join(per, queries.id == per.query_id, "left").where(F.coalesce("n", F.lit(0)) < k).select("id", "dim", "x"), "few")
    if not few.isEmpty():
        found = found.join(few.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").union(exactly(vectors, few, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    best = F.struct((-F.col("score")).alias("less"), "vec_id", "score")
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(best)), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op5_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20, 20)
