import zlib

import numpy as np

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    from tessera.llm.toxicity import op8_toxicity

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in op8_toxicity(spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(r.score, labels[i]) for i, r in got.items() if r.held_out and labels.get(i) is not None]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(s > t) + 0.5 * (s == t) for s in good for t in bad])
    print("auc", auc, len(good), len(bad), np.mean(np.array(good) >= 0.3), np.mean(np.array(bad) >= 0.3))
    assert auc > 0.85 and np.mean(np.array(good) >= 0.3) > 0.7 and np.mean(np.array(bad) >= 0.3) < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_index_gives_what_comparing_all_gives():
    from tessera.llm.toxicity import Index, Vectors, alike

    rng = np.random.default_rng(5)
    often = 1 / np.arange(1, 301)

    def vectors(n):
        rows = [np.sort(rng.choice(300, rng.integers(1, 30), replace=False, p=often / often.sum())) for _ in range(n)]
        weights = [rng.integers(1, 4, len(f)).astype(float) for f in rows]
        return Vectors(np.cumsum([0, *map(len, rows)]), np.concatenate(rows).astype(np.int32), np.concatenate([w / np.sqrt((w * w).sum()) for w in weights]))

    def dense(v):
        out = np.zeros((len(v), 300))
        out[v.owner(), v.feature] = v.weight
        return out

    own, asked = vectors(900), vectors(300)
    ids = rng.permutation(5000)[:900]
    index = Index(ids, np.arange(900) % 2, own, 300)
    assert 0 < (index.head >= 0).sum() < 300
    all_ = (dense(asked) @ dense(own).T).round(12)
    skipped = (index.cosines(asked.rows(0, 100), 25) < 0).mean()
    assert 0 < skipped < 1
    for s, (at, near) in zip(all_, index.nearest(asked, 25)):
        want = [i for i in np.lexsort((ids, -s))[:25] if s[i] > 0]
        assert np.allclose(near, s[want]) and index.ids[at].tolist() == ids[want].tolist()
    for k, (at, _) in enumerate(index.nearest(own, 25, np.arange(900))):
        assert k not in at
    groups = alike(index.dense[:900], 4)
    assert set(groups.tolist()) <= set(range(4)) and len(groups) == 900


def plain_scores(docs, labels):
    """The score by its definition, one text after the other."""
    import math
    import re
    from collections import Counter

    word = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")

    def terms(text):
        out = Counter()
        for w in word.findall((text or "").lower()):
            out["w", w.encode()] += 1
            if len(w.encode()) > 5:
                out["s", w.encode()[:5]] += 1
        return out

    rows = sorted((i, labels[i], terms(t)) for i, t in docs if labels.get(i) is not None and zlib.crc32(str(i).encode()) % 4 != 2)
    n, n1 = len(rows), sum(y for _, y, _ in rows)
    base = n1 / n
    df, df1 = Counter(), Counter()
    for _, y, c in rows:
        df.update(c.keys())
        df1.update(c.keys() if y else ())
    weight = {f: (math.log((1 + n) / (1 + k)) + 1) * (0.1 + max(0.0, math.log((df1[f] + 20 * base) / (k + 20) / base)) ** 2) for f, k in df.items() if k >= 2}

    def vector(c):
        v = {f: (1 + math.log(k)) * weight[f] for f, k in c.items() if f in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / size for f, x in v.items()}

    own = [(i, y, vector(c)) for i, y, c in rows]
    none = [y for _, y, v in own if not v]
    own = [(i, y, v) for i, y, v in own if v]
    lists = {}
    for k, (_, _, v) in enumerate(own):
        for f, x in v.items():
            lists.setdefault(f, []).append((k, x))

    def vote(v, without=-1):
        cosine = Counter()
        for f, x in v.items():
            for k, z in lists.get(f, ()):
                cosine[k] += x * z
        near = sorted((-round(s, 12), own[k][0], own[k][1]) for k, s in cosine.items() if k != without and s > 1e-12)[:25]
        return (sum(-s * y for s, _, y in near) + 0.5 * base) / (sum(-s for s, _, y in near) + 0.5)

    pairs = sorted((vote(v, k), y) for k, (_, y, v) in enumerate(own))
    values = sorted({x for x, _ in pairs})
    rate = {}
    pools = [[x, sum(y for z, y in pairs if z == x), sum(z == x for z, _ in pairs)] for x in values]
    k = 0
    while k + 1 < len(pools):
        if pools[k][1] / pools[k][2] >= pools[k + 1][1] / pools[k + 1][2]:
            x, a, b = pools.pop(k + 1)
            pools[k] = [x, pools[k][1] + a, pools[k][2] + b]  # a pool stands at its largest vote
            k = max(0, k - 1)
        else:
            k += 1
    at, rates = [p[0] for p in pools], [(p[1] + base) / (p[2] + 1) for p in pools]
    return {i: float(np.interp(vote(v), at, rates)) if (v := vector(terms(t))) else (sum(none) + base) / (len(none) + 1) for i, t in docs}


def test_score_is_that_of_the_definition(spark):
    from tessera.llm.toxicity import toxicity

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 700").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    want = plain_scores([(r.doc_id, r.text) for r in docs.collect()], {r.doc_id: r.toxic for r in labels.collect()})
    got = toxicity(docs, labels).collect()
    off = sum(abs(r.score - want[r.doc_id]) > 1e-6 for r in got)
    assert len(got) == len(want) and off == 0 and len({round(r.score, 9) for r in got}) > 50
    assert np.mean([not r.evidence for r in got]) < 0.01


def test_odd_rows(spark):
    from tessera.llm.toxicity import toxicity

    docs = spark.createDataFrame([(i, ("vile " if i % 3 == 0 else "kind ") + "word%d" % i) for i in range(200)] + [(None, "vile"), (500, None), (501, ""), (502, "x " * 3000), (0, "vile word0")], "doc_id long, text string").selectExpr("*", "1 as score", "'q' as label", "2 as held_out")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(501, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 205
    by = {r.doc_id: r for r in got}
    assert by[3].predicted == 1 and by[4].predicted == 0 and by[None].predicted == 1 and not by[None].held_out and by[3].evidence
    taught = [int(i % 3 == 0) for i in [*range(200), 0] if zlib.crc32(str(i).encode()) % 4 != 2]
    assert by[500].score == by[501].score and abs(by[500].score - np.mean(taught)) < 1e-9 and not by[500].evidence  # no such example: the base rate
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity(docs.limit(0), labels).collect() == []


def test_texts_are_compared_in_runs_of_few_postings(monkeypatch):
    import numpy as np

    from tessera.llm import bpe
    from tessera.llm import toxicity as m

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 400)) for _ in range(90)]
    space = m.Space(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 90, 9)
    keys, n = np.unique(np.concatenate([np.unique(m.features([t])[1]) for t in texts]), return_counts=True)
    space = m.Space(keys, n.astype(float), np.minimum(n, 2).astype(float), 90, 9)
    examples = m.Examples(space, np.arange(90), np.arange(90) % 10 == 0, *space.counts(texts))
    v = examples.own
    many = np.where(examples.index.head[v.feature] < 0, np.diff(examples.index.start)[v.feature], 0)
    whole = examples.index.votes(v, space.base)
    monkeypatch.setattr(m, "POSTINGS", 20_000)
    cuts, asked, kept = examples.index.cuts(v), [], m.Index.cosines
    monkeypatch.setattr(m.Index, "cosines", lambda self, some, *a: asked.append(len(some)) or kept(self, some, *a))
    assert examples.index.votes(v, space.base) == whole
    assert sum(asked) == 90 and len(asked) > 2 and cuts == [0, *np.cumsum(asked).tolist()]
    assert all(b - a == 1 or many[v.start[a] : v.start[b]].sum() <= 20_000 for a, b in zip(cuts, cuts[1:]))
    monkeypatch.setattr(m, "POSTINGS", 1)
    assert examples.index.votes(v, space.base) == whole
    assert examples.index.votes(v.rows(0, 0), space.base) == []
    bpe._made["path", True] = "an encoder's memory"
    m.forget_encoders()
    assert not bpe._made and not hasattr(examples.scoring(), "own")


def test_many_texts_are_compared_at_a_time_in_little_memory(monkeypatch):
    import tracemalloc

    from tessera.llm import toxicity as m

    rng = np.random.default_rng(6)
    texts = [" ".join(f"{x:05d}" for x in rng.integers(0, 2000, 250)) for _ in range(800)]
    keys, n = np.unique(np.concatenate([np.unique(m.features([t])[1]) for t in texts]), return_counts=True)
    space = m.Space(keys, n.astype(float), np.minimum(n, 9).astype(float), 800, 80)
    recipe = m.Recipe(space, np.arange(800), (np.arange(800) % 10 == 0).astype(int), *(x.astype(kind) for x, kind in zip(space.counts(texts), (np.int64, np.int32, "<u4"))))
    monkeypatch.setattr(m, "HEAD_PART", 2)  # all features are rare
    examples = recipe.examples()
    own, v = examples.own, space.vectors(*space.counts(texts[:128]))
    assert not (examples.index.head >= 0).any() and len(own) == 800
    rows = [examples.rows(a, min(800, a + 300)) for a in range(0, 800, 300)]
    assert np.array_equal(np.concatenate([r.feature for r in rows]), own.feature) and np.array_equal(np.concatenate([r.weight for r in rows]), own.weight)
    plain = space.vectors(*space.counts([texts[i] for i in examples.index.ids]))
    assert np.array_equal(plain.start, own.start) and np.array_equal(plain.feature, own.feature) and np.allclose(plain.weight, own.weight, rtol=1e-15)
    assert np.diff(examples.index.start)[v.feature].sum() > 2 << 20  # at 50 bytes each, over 100 MB
    asked, kept = [], m.Index.cosines
    monkeypatch.setattr(m.Index, "cosines", lambda self, some, *a: asked.append(len(some)) or kept(self, some, *a))
    tracemalloc.start()
    whole = examples.index.votes(v, space.base)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert asked == [m.TEXTS] * 2 and peak < 12e6
    monkeypatch.setattr(m, "SUMMED", 1)  # a list at a time
    assert np.allclose([x for x, _ in examples.index.votes(v, space.base)], [x for x, _ in whole], rtol=1e-9)


def test_driver_makes_the_recipe_without_64_bits_an_entry(monkeypatch):
    import tracemalloc

    from tessera.llm import toxicity as m

    rng = np.random.default_rng(7)
    size, rows = 300, 6000
    feature = np.concatenate([np.sort(rng.choice(size, 200, replace=False)) for _ in range(rows)]).astype(np.int32)
    n, start = rng.integers(1, 4, len(feature)).astype("<u4"), np.arange(rows + 1) * 200
    space = m.Space(np.arange(size, dtype=np.uint64), np.bincount(feature).astype(float), np.full(size, 5.0), rows, 60)
    monkeypatch.setattr(m, "MOST_HEAD", 8)  # the table that groups examples is small
    ids, labels = rng.permutation(rows), (np.arange(rows) % 100 == 0).astype(int)
    tracemalloc.start()
    recipe = m.Recipe(space, ids, labels, start, feature, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(feature)
    examples = recipe.examples()
    place = np.argsort(ids)[np.searchsorted(np.sort(ids), examples.index.ids)]
    want, own = space.vectors(start, feature, n), examples.own
    assert np.array_equal(examples.index.labels, labels[place])
    for k in range(0, rows, 500):
        a, b = start[place[k]], start[place[k] + 1]
        assert np.array_equal(own.rows(k, k + 1).feature, want.feature[a:b]) and np.array_equal(own.rows(k, k + 1).weight, want.weight[a:b])
