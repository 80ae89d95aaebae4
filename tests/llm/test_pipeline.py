"""The pipeline's stages against brute force, each on the input that it gets."""

import hashlib

import numpy as np

from tests.llm.test_decontaminate import norm
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_text_operators import brute_components, sets_of

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, []
    for k, (name, stage) in enumerate(p.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append((name, before, {r.doc_id: r for r in docs.collect()}))
        assert k == len(p.STAGES) - 1 or docs.columns == columns
    toxic, lines, near, bench, coded = steps
    from tessera.llm.toxicity import op8_toxicity

    rejected = {r.doc_id for r in op8_toxicity(spark, SF).where("predicted = 1").collect()}
    assert rejected and toxic[2].keys() == toxic[1].keys() - rejected
    want = brute_lines([(i, r.text) for i, r in lines[1].items()])
    assert lines[2].keys() == lines[1].keys() and sum(lines[2][i].text != t for i, t in want.items()) <= 3
    assert all(r.n_chars == len(r.text) for r in lines[2].values())
    ids = sorted(near[1])
    component = brute_components(ids, sets_of([near[1][i].text for i in ids]), 80)
    assert near[2].keys() == {i for i in ids if component[i] == i}
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = {i: norm(r.text) for i, r in bench[1].items()}
    number = {}
    code = lambda w: np.array([number.setdefault(x, len(number)) for x in w])

    def held(w, x):
        if len(w) < 13:
            return False
        a, b = np.lib.stride_tricks.sliding_window_view(code(w), 13), np.lib.stride_tricks.sliding_window_view(code(x), 13)
        return any(((a == g).sum(1) >= 11).any() for g in b)

    gone = bench[1].keys() - bench[2].keys()
    assert gone and all(any(held(words[i], x) for x in items) for i in gone)
    clean = sorted(bench[2])[::7]
    assert not any(held(words[i], x) for i in clean for x in items)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert coded[2].keys() == coded[1].keys()
    for i in sorted(coded[2])[::10]:
        ids = t.encode(coded[1][i].text, add_special_tokens=False).ids
        assert coded[2][i].n_tokens == len(ids) and coded[2][i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_is_registered(spark):
    import __spark_entry__ as e

    assert "pipeline" in e.queries() and all(any(k.startswith(f"op{n}_") for k in e.queries()) for n in range(1, 11))
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sql_says_the_same(spark):
    import duckdb

    from tessera.llm import queries as q

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    for name, sql in q.oracle_sql().items():
        df = q.queries()[name](spark, SF)
        said = con.execute(sql)
        columns = [d[0] for d in said.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*columns).collect())) == sorted(said.fetchall())


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null texts, extra columns with names that the operators use, and an empty table."""
    import corpus_pipeline as p

    line = "a line of several words that is long enough for many shingles, and it ends here"
    rows = [(1, line), (1, line), (None, line), (2, None), (3, ""), (None, None), (4, "other words " * 40), (5, "other words " * 40)]
    extra = ["1 as kept", "'q' as items", "2 as score", "3 as component", "4 as id", "5 as row_a", "6 as label", "7 as drop", "length(text) as n_chars"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *extra)
    for k, (name, stage) in enumerate(p.STAGES):
        empty = stage(spark, docs.limit(0), SF)
        assert empty.collect() == []
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert sum(r.doc_id is None for r in out.collect()) == 2 and {r.doc_id for r in out.collect()} >= {1, 2, 3, 4}, name
            docs = out
    assert out.where("doc_id = 3").first().n_tokens == 0 and out.where("doc_id = 2").first().n_tokens == 0
