import math
import re
import zlib
from collections import Counter

import pytest

SF = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def base_of(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    docs = [(i, [*WORD.findall(lowered(t)), None]) for i, t in rows]
    count = Counter(w for i, d in docs if not held[i] for w in d)
    n, v = sum(count.values()), len(count)
    return [(i, held[i], len(d), sum(count[w] > 0 for w in d), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in d)) for i, d in docs]


def test_base_and_held_out_gain(spark):
    from tessera.llm.brown import op6_lm_scoring

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op6_lm_scoring(spark, SF).collect()}
    want = base_of(rows)
    assert len(got) == len(want)
    for i, held, n_tokens, n_known, n, base in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, n) and r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 0.93 * sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.95 * len(held)


def test_score_is_that_of_the_classes(spark):
    """Every word seen twice has an exchange class; probabilities of all words after each class add up to 1; scores multiply them."""
    import numpy as np

    from tessera.llm import brown
    from tessera.llm.common import Words

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    classes, counts = {}, {}
    blocks = brown.numbered(docs, "doc_id", "text")
    model = brown.fit(blocks)
    known = brown.Classes(model.c, model.core, model.counts, model.moved)
    for row in blocks.collect():
        t = brown.Tokens(row)
        for key, of, n in zip(t.keys.tolist(), *(x.tolist() for x in known.of(t))):
            assert classes.setdefault(key, of) == of and counts.setdefault(key, n) == n
    count = Counter(w for i, t in rows if not brown.is_held_out(i) for w in [*WORD.findall(lowered(t)), None])
    hashes = {w: int(brown.END) if w is None else int(Words([w], lower=True).hash[0]) for w in {*count, *(w for _, t in rows for w in WORD.findall(lowered(t)))}}
    assert all(counts[h] == count[w] for w, h in hashes.items())
    assert all((classes[h] < brown.CLASSES) == (count[w] > 1) for w, h in hashes.items())
    assert len({classes[h] for w, h in hashes.items() if count[w] > 1}) > 30

    m = np.zeros((brown.WAITING, brown.WAITING))
    chains = {i: [hashes[w] for w in [None, *WORD.findall(lowered(t)), None]] for i, t in rows}
    for i, chain in chains.items():
        if not brown.is_held_out(i):
            for x, y in zip(chain, chain[1:]):
                m[classes[x], classes[y]] += 1
    assert (m == model.m[: brown.WAITING, : brown.WAITING]).all()
    prior = np.where((m.sum(0) > 0) | (np.arange(brown.WAITING) == brown.ONCE), m.sum(0) + 1, 0)
    prior = prior / prior.sum()
    moves = (m + 20 * prior) / (m.sum(1, keepdims=True) + 20)
    once = sum(n == 1 for n in count.values())
    emits = {h: count[w] / m.sum(0)[classes[h]] if count[w] > 1 else 0.5 / once if count[w] else 0.5 for w, h in hashes.items()}
    for x in range(brown.WAITING):
        total = sum(moves[x, classes[h]] * emits[h] for w, h in hashes.items() if count[w]) + moves[x, brown.ONCE] * 0.5
        assert total == pytest.approx(1)
    for r in brown.score_documents(docs).collect():
        chain = chains[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(moves[classes[x], classes[y]] * emits[y]) for x, y in zip(chain, chain[1:])))


def test_a_move_is_weighed_as_by_counting_anew():
    """The likelihood after each possible move, with the bigrams counted anew, is largest for the class that is chosen."""
    import numpy as np

    from tessera.llm import brown

    rng = np.random.default_rng(3)
    n_words = 30
    text = rng.integers(0, n_words, 4000)
    text = text[np.concatenate([[True], text[1:] != text[:-1]])]  # no word stands beside itself
    classes = rng.integers(0, 5, n_words)

    def bigrams(of):
        m = np.zeros((brown.ALL_CLASSES, brown.ALL_CLASSES))
        np.add.at(m, (of[text[:-1]], of[text[1:]]), 1)
        return m

    m = bigrams(classes)
    for w in range(n_words):
        cells = Counter(classes[b] for a, b in zip(text, text[1:]) if a == w) + Counter({brown.ALL_CLASSES + c: n for c, n in Counter(classes[a] for a, b in zip(text, text[1:]) if b == w).items()})
        cell, n = np.array(sorted(cells.items())).T
        got = brown.weighed(np.zeros(len(cell), np.int64), cell, n.astype(float), classes[[w]], m)[0]
        best = []
        for c in range(brown.CLASSES):
            moved = classes.copy()
            moved[w] = c
            best.append(brown.likelihood(bigrams(moved)))
        assert best[got] > max(best) - 1e-6


def test_exchange_raises_the_likelihood():
    import numpy as np

    from tessera.llm import brown

    rng = np.random.default_rng(1)
    kinds = np.arange(60) % 3
    n = np.array([[rng.poisson(40 if (kinds[a] + 1) % 3 == kinds[b] else 1) for b in range(60)] for a in range(60)], float)
    size = brown.ALL_CLASSES
    classes = np.arange(60) % 2
    full = np.concatenate([classes, [brown.ONCE, brown.WAITING]])
    before = None
    for turn in range(6):
        right, left = np.zeros((len(full), size)), np.zeros((len(full), size))
        for a in range(60):
            for b in range(60):
                right[a, full[b]] += n[a, b]
                left[b, full[a]] += n[a, b]
        m = brown.class_matrix(right, full, size)
        if turn == 0:
            before = brown.likelihood(m)
        after = brown.likelihood(m)
        full = brown.exchanged(full, 60, left, right, m, turn)
    assert after > before + 1000


def test_odd_rows(spark):
    from tessera.llm.brown import score_documents

    rows = [(1, None), (2, ""), (3, "A a\nA"), (3, "A a\nA"), (None, "x " * 2000), (4, "y" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "'q' as score")
    got = sorted(((r.doc_id or 0), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in score_documents(df).collect())
    assert got == sorted((i or 0, n, k, t, round(b, 6)) for i, _, n, k, t, b in base_of(rows))
    assert score_documents(df.limit(0)).collect() == []
