import numpy as np
import pytest

SF = "/root/testdata/sf0.01"


def brute(ids, x, queries, k):
    score = x @ x.T
    out = {}
    for q in queries:
        s = [(-score[q, j], ids[j]) for j in range(len(ids)) if ids[j] != ids[q]]
        out[ids[q]] = [(i, -v) for v, i in sorted(s)[:k]]
    return out


def test_recall_on_embeddings(spark):
    from tessera.llm.nearest import op5_approximate_nearest_neighbours

    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], float)
    want = brute(ids, x, [k for k, i in enumerate(ids) if i % 20 == 0], 20)
    got = {}
    for r in op5_approximate_nearest_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == want.keys() and all(sorted(g) == list(range(1, 21)) for g in got.values())
    hit = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 20 * len(want)
    for q, g in got.items():
        assert all(abs(s - x[ids.index(q)] @ x[ids.index(v)]) < 1e-12 for v, s in g.values())
        assert [v for _, v in sorted((-s, v) for v, s in g.values())] == [g[k][0] for k in range(1, 21)]


def test_odd_vectors_and_few_candidates(spark):
    from tessera.llm.nearest import nearest

    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 0.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0]), (40, []), (9, [1.0, 1.0]), (60, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as dim", "3 as x")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, "vec_id", "embedding", 20, 20).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 9, 1.0), (0, 3, 20, 0.0), (20, 1, 3, 2.0), (20, 2, 9, 2.0), (20, 3, 0, 0.0)]
    assert nearest(df.limit(0), "vec_id", "embedding", 20, 20).collect() == []


def test_many_equal_vectors_and_different_norms(spark):
    from tessera.llm.nearest import nearest

    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 16)) * rng.uniform(0.2, 3, (900, 1))
    x[300:700] = x[5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(list(range(900)), x, range(0, 900, 20), 20)
    got = {}
    for r in nearest(df, "vec_id", "embedding", 20, 20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sum(len(set(got[q]) & {v for v, _ in w}) for q, w in want.items()) >= 0.9 * 20 * len(want)


def test_probes_come_in_order():
    from tessera.llm.nearest import Hashing

    h = Hashing(8, 1.0)
    spot = h.spots(np.random.default_rng(2).standard_normal((1, 8)), True)[0, 0]
    cells = h.probes(spot, 50)
    assert (cells[0] == np.floor(spot)).all() and len({tuple(c) for c in cells}) == 50
    gap = np.maximum(0, np.maximum(cells - spot, spot - cells - 1))
    assert (np.diff((gap**2).sum(1)) > -1e-9).all()


def test_one_long_vector_among_more_rows_than_the_sample(spark):
    from tessera.llm import nearest as m

    rng = np.random.default_rng(4)
    n = m.SAMPLE + 2000
    x = rng.standard_normal((n, 16)) + 2 * rng.standard_normal((40, 16))[np.arange(n) % 40]
    x[7] *= 50
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in m.nearest(df, "vec_id", "embedding", 100, 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, n, 100):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hit >= 0.9 * 20 * len(range(0, n, 100))
    short = np.delete(x, 7, 0)
    keys = m.Hashing(16, float(np.sqrt((short * short).sum(1)).max())).spots(short, False)
    cells = np.unique(np.floor(keys[0]), axis=0, return_counts=True)[1]
    assert cells.max() < n / 4


def test_the_exact_way_where_probes_are_too_few(spark, monkeypatch):
    from tessera.llm import nearest as m

    x = np.random.default_rng(6).standard_normal((400, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(m, "MOST_PROBES", 2)
    want = brute(list(range(400)), x, range(0, 400, 20), 20)
    got = {}
    for r in m.nearest(df, "vec_id", "embedding", 20, 20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert {q: [g[k] for k in range(1, 21)] for q, g in got.items()} == {q: [v for v, _ in w] for q, w in want.items()}
