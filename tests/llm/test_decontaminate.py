import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def norm(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())


def brute(text, item):
    w, x = norm(text), norm(item)
    if len(x) < 4:
        return len(x) > 0 and w == x
    span = min(13, len(x))
    most = 2 if span == 13 else span // 8
    for a in range(len(x) - span + 1):
        for b in range(len(w) - span + 1):
            if sum(p != q for p, q in zip(x[a : a + span], w[b : b + span])) <= most:
                return True
    return False


def test_masks_find_any_two_substitutions():
    from tessera.llm.decontaminate import MASKS, SPAN, SUBSTITUTIONS

    for wrong in itertools.combinations(range(SPAN), SUBSTITUTIONS):
        assert any(not {o + p for p in m} & set(wrong) for m in MASKS for o in range(SPAN - m[-1]))


@pytest.mark.parametrize("slice_chars", [10**7, 300])
def test_against_brute_force(spark, slice_chars):
    from tessera.llm.decontaminate import contaminated

    rng = random.Random(1)
    word = lambda: rng.choice(["alpha", "Beta", "x1", "é", "the"]) + str(rng.randrange(9))
    items = [" ".join(word() for _ in range(rng.choice([2, 4, 6, 9, 12, 13, 15, 30]))) for _ in range(30)] + [None, "", "the the the the the the the"]
    docs = []
    for _ in range(200):
        w = [word() for _ in range(rng.randrange(60))]
        if rng.random() < 0.8:
            x = norm(rng.choice(items)) or ["z"]
            for _ in range(rng.randrange(5)):
                x[rng.randrange(len(x))] = "changed"
            a = rng.randrange(len(x)) if rng.random() < 0.5 else 0
            k = rng.randrange(len(w) + 1)
            w[k:k] = x[a:] if rng.random() < 0.5 else [y.upper() + "," for y in x[a:]]
        docs.append(" ".join(w))
    docs += ["", None, "x" * 4000, "the " * 500, *(x + "." for x in items if len(norm(x)) == 2)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").selectExpr("*", "'q' as items", "1 as id", "2 as contaminated")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r["items"] for r in contaminated(df, bench, slice_chars=slice_chars).collect()}
    assert got == {i: [j for j, x in enumerate(items) if brute(d, x)] for i, d in enumerate(docs)}
    again = bench.union(bench).unionByName(spark.createDataFrame([(None, items[3])], bench.schema))  # repeated items, and one without an id
    rows = df.union(df.limit(3)).unionByName(df.where("doc_id = 199").withColumn("doc_id", F.lit(None).cast("long")))
    more = contaminated(rows, again, slice_chars=slice_chars).collect()
    assert len(more) == len(docs) + 4
    for r in more:
        i = 199 if r.doc_id is None else r.doc_id
        assert r["items"] == ([None] if brute(docs[i], items[3]) else []) + got[i] and r.n_items == len(r["items"])
    assert not any(r.contaminated for r in contaminated(df, bench.limit(0)).collect())
    assert contaminated(df.limit(0), bench).collect() == []


def test_on_documents(spark):
    from tessera.llm.decontaminate import op10_benchmark_decontamination

    got = op10_benchmark_decontamination(spark, SF).collect()
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(x[k : k + 13]) for x in items for k in range(len(x) - 12)}
    exact = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if any(tuple(w[k : k + 13]) in grams for w in [norm(r.text)] for k in range(len(w) - 12))}
    assert exact and exact <= {r.doc_id for r in got if r.contaminated} and len(got) == 1000
