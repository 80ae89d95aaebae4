import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def brute(rows, similar=0.8):
    """Kept texts by row; links between all lines that take part."""
    where = [(i, k, x.strip(" ")) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if x.strip(" ")]
    lines = sorted({x for _, _, x in where})
    sets = [{x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in lines]
    up = list(range(len(lines)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for k, s in enumerate(sets):
        seen = {}
        for g in s:
            for j in by.setdefault(g, []):
                seen[j] = seen.get(j, 0) + 1
            by[g].append(k)
        for j, n in seen.items():
            if n >= similar * (len(s) + len(sets[j]) - n):
                up[max(root(j), root(k))] = min(root(j), root(k))
    number = {x: k for k, x in enumerate(lines)}
    first = {}
    for i, k, x in where:
        c = root(number[x])
        first[c] = min(first.get(c, (i, k)), (i, k))
    gone = {(i, k) for i, k, x in where if (i, k) > first[root(number[x])]}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_against_brute_force(spark):
    from tessera.llm.line_dedup import line_dedup

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 9)))
    base = [" ".join(word() for _ in range(rng.randrange(6, 60))) for _ in range(25)]
    rows = []
    for i in range(80):
        out = []
        for _ in range(rng.randrange(6)):
            x = rng.choice(base).split(" ")
            if rng.random() < 0.4:
                x[rng.randrange(len(x))] = word()
            out.append(rng.choice(["", " "]) + " ".join(x))
        rows.append((i, "\n".join([*out, "short", ""])))
    rows += [(80, None), (81, ""), (82, "x" * 5000), (83, "x" * 5000 + "\n" + "x" * 6000), (84, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as `drop`", "1 as a", "2 as line")
    got = {r.doc_id: r.text for r in line_dedup(df).collect()}
    want = brute(rows)
    wrong = {i for i in want if got[i] != want[i]}
    assert len(got) == len(rows) and len(wrong) <= 1, wrong  # banding finds 99.7 % of pairs that are just at the bound
    assert line_dedup(df).columns == [*df.columns, "n_lines", "n_removed"]
    assert line_dedup(df.limit(0)).collect() == []


def test_equal_rows_null_ids_and_the_shuffled_way(spark, monkeypatch):
    from tessera.llm import line_dedup as m

    line = "a line that is long enough to take part"
    df = spark.createDataFrame([(1, line), (1, line), (2, line + "\nx"), (None, line)], "doc_id long, text string")
    for most in (m.BROADCAST_BYTES, -1):
        monkeypatch.setattr(m, "BROADCAST_BYTES", most)
        monkeypatch.setattr(m, "BLOCK", 2)
        got = sorted((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in m.line_dedup(df).collect())
        assert got == [(0, "", 1, 1), (1, line, 1, 0), (1, line, 1, 0), (2, "x", 2, 1)]


def test_on_documents(spark):
    from tessera.llm.line_dedup import op4_line_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    import hashlib

    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in brute(rows).items()}
    got = {r.doc_id: r.kept_sha256 for r in op4_line_dedup(spark, SF).collect()}
    assert sum(got[i] != want[i] for i in want) <= 3
    plan = op4_line_dedup(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_short_pairs_just_at_the_bound_are_found(spark):
    from tessera.llm.line_dedup import line_dedup

    rng = random.Random(7)
    made = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for i in range(1000):  # 18 shingles each, 16 of them shared: 16 of 20
        stem = made(23)
        rows += [(2 * i, stem + "01"), (2 * i + 1, stem + "23")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sum(r.n_removed for r in line_dedup(df).collect())
    assert found >= 996, found


def test_shuffle_files_go_while_it_runs(spark):
    import time

    from tessera.llm import common
    from tessera.llm import line_dedup as m

    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    common.sweep(spark)
    time.sleep(2)
    before, seen, kept = held(), [], m.stage

    def watched(df, name, blobs=False):
        seen.append(held())
        return kept(df, name, blobs)

    m.stage = watched
    try:
        m.dropped(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    finally:
        m.stage = kept
    time.sleep(2)
    assert held() <= before + 8 and max(seen) <= before + 60, (before, seen, held())


def test_the_last_round_shuffles_two_bytes_a_shingle(spark):
    from tessera.llm import line_dedup as m

    line = "".join(chr(97 + k * k % 23) for k in range(3000))
    units = spark.createDataFrame([(line,)], "line string").select(m.code_units(F.col("line")).alias("units"))
    got = units.select(m.shingle_set(F.col("units")).alias("full"), m.shingle_set(F.col("units"), m.short_hash).alias("set"))
    assert dict(got.dtypes)["set"] == "array<smallint>"
    row = got.first()
    assert len(row.full) == len({line[k : k + 8] for k in range(len(line) - 7)}) >= len(row["set"])


def test_sets_of_a_pair_are_made_once_and_in_linear_time(spark):
    import time

    from tessera.llm import line_dedup as m

    rng = random.Random(3)
    line = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    texts = spark.createDataFrame([(1, line), (2, line[:-30_000] + "."), (3, line[:-90_000])], "id long, line string").select("id", m.code_units(F.col("line")).alias("units"))
    texts.write.format("noop").mode("overwrite").save()
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "p long, id long")
    found = m.confirmed(pairs, texts)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(substring") == 2
    began = time.time()
    assert {(r.a, r.b) for r in found.collect()} == {(1, 2)}
    assert time.time() - began < 30


def test_signatures_don_t_depend_on_how_many_shingles_a_row_holds(spark, monkeypatch):
    from tessera.llm import line_dedup as m

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé\U0001f600") for _ in range(n)) for n in range(1, 60)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[20]])), "doc_id long, text string")
    got = []
    for n in (m.AT_ONCE, 2, 3):
        monkeypatch.setattr(m, "AT_ONCE", n)
        got.append(sorted(tuple(r) for r in m.signed(m.lines_of(docs, "doc_id", "text")).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == len(set(texts)) and sorted(r[1] for r in got[0])[-1] == 2


def test_the_last_round_holds_one_slice_of_its_shuffle_at_a_time(spark, monkeypatch):
    from tessera.llm import line_dedup as m

    rng = random.Random(11)
    made = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = [made(40) + x for stem in [made(30) for _ in range(30)] for x in (stem, stem)]  # all of one group, none alike but in turn
    lines += [x + "." for x in lines]
    df = spark.createDataFrame(list(enumerate(lines)), "n long, line string").select(F.xxhash64("line").alias("a"), "line")
    near = m.signed(df).withColumnRenamed("a", "id").withColumn("keys", F.array(*[F.lit(k).cast("long") for k in range(m.BANDS)]))
    members = df.select(F.lit(0).cast("long").alias("key"), F.col("a").alias("id"), F.col("a").alias("component"))
    texts = df.select(F.col("a").alias("id"), m.code_units(F.col("line")).alias("units"))
    monkeypatch.setattr(m, "BLOCK", 8)
    whole = {frozenset(r) for r in m.close_within(members, near, texts).collect()}
    assert len(whole) == 60
    jobs, kept = [], m.stage

    def watched(frame, name, blobs=False):
        jobs.append(name)
        return kept(frame, name, blobs)

    monkeypatch.setattr(m, "stage", watched)
    monkeypatch.setattr(m, "SLICE_BYTES", 100_000)
    got = [frozenset(r) for r in m.close_within(members, near, texts).collect()]
    assert set(got) == whole and len(got) == 60
    # 60 members of 192 + 126 bytes, 60 of 192 + 128; 15 blocks, so each is there 16 times: 612,480 bytes
    assert jobs.count("line-close") == 7, jobs
