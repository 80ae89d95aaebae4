"""Operators on documents against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, component_id string, block long, start string"


def small(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "x", 1, "y") for i, t in zip(ids, texts)], SCHEMA)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def varied(seed, n=120, vocabulary=400):
    """Texts with exact copies, near copies, shared passages, empty, short and long ones, and a null."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(vocabulary)
    base = [" ".join(word() for _ in range(rng.choice([3, 30, 80, 200, 500]))) for _ in range(n // 4)]
    passage = " ".join(word() for _ in range(60))
    out = []
    for _ in range(n):
        t = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = rng.choice([word(), word().upper(), "é—" + word()])
        if rng.random() < 0.3:
            k = rng.randrange(len(t) + 1)
            t[k:k] = passage.split()[rng.randrange(30):]
        out.append(rng.choice([" ", "\n", "\t ", "   "]).join(t))
    return [*out, "", None, " \n\t", "one", "Two words", "one", " ".join(["same"] * 300), " ".join(["same"] * 400), "x" * 5000, " ".join(word() for _ in range(9000))]


def sets_of(texts, k=5):
    out = []
    for t in texts:
        w = WORD.findall(lowered(t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    return out


def brute_components(ids, sets, percent):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(ids[a]), root(ids[b])))
                up[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    from tessera.llm.near_dedup import near_duplicates

    texts = varied(seed)
    sets = sets_of(texts)
    want = brute_components(list(range(len(texts))), sets, 85)
    got = {r.doc_id: r for r in near_duplicates(small(spark, texts)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert [got[i].n_shingles for i in range(len(texts))] == list(map(len, sets))
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_duplicates_on_documents(spark):
    from tessera.llm.near_dedup import op1_minhash_near_dedup

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = brute_components([i for i, _ in rows], sets_of([t for _, t in rows]), 85)
    assert {r.doc_id: r.component_id for r in op1_minhash_near_dedup(spark, SF).collect()} == want


def test_near_duplicates_of_nothing_and_null_ids(spark):
    from tessera.llm.near_dedup import near_duplicates

    assert near_duplicates(small(spark, [])).collect() == []
    text = "a b c d e f g h"
    got = near_duplicates(small(spark, [text, text, text, text], [None, 7, 7, 9])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (7, 7, True), (7, 7, True), (9, 7, False)]


def test_signature_keys_find_every_pair_under_the_bound():
    from tessera.llm.near_dedup import CHUNKS, SYMBOLS, WIDTH, chunk_keys, errors_of

    assert errors_of(85) == 24
    for percent in (80, 85, 95):
        errors, rng = errors_of(percent), random.Random(3)
        plan = chunk_keys(errors)
        for _ in range(1000):
            wrong = set(rng.sample(range(SYMBOLS), errors))
            assert any(not wrong & set(kept) for _, kept in plan)
        # the worst case: errors dealt evenly
        assert sum(WIDTH - len(next(k for c2, k in plan if c2 == c)) for c in range(CHUNKS)) + CHUNKS >= errors + 1


def brute_repeats(ids, texts, window):
    first, out = {}, []
    docs = [(i, WORD.findall(t or "")) for i, t in zip(ids, texts)]
    for i, w in docs:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    for i, w in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [20, 7, 3])
def test_substring_dedup(spark, window):
    from tessera.llm.substring_dedup import substring_dedup

    texts = varied(5)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    got = substring_dedup(small(spark, texts, ids), window=window).collect()
    assert sorted(map(tuple, got)) == brute_repeats(ids, texts, window)


def test_substring_dedup_on_documents(spark):
    from tessera.llm.substring_dedup import op3_substring_dedup, substring_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, op3_substring_dedup(spark, SF).collect())) == brute_repeats(*zip(*rows), 20)
    assert substring_dedup(small(spark, [])).collect() == []
    passage = " ".join(f"p{k}" for k in range(25))
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(small(spark, [passage, "x " + passage, passage, passage, "y z " + passage], [None, 5, 7, 7, 7])).collect()]
    assert sorted(got, key=str) == sorted([(None, 25, 25), (5, 26, 0), (7, 25, 25), (7, 25, 25), (7, 27, 25)], key=str)


def test_difference_covers_meet_at_every_shift():
    from tessera.llm.substring_dedup import COVERS

    for m, cover in COVERS.items():
        assert {(a - b) % m for a in cover for b in cover} == set(range(m))


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


ODD = ["", None, " ", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "é   x  y \n\n z ", "한국어 🙂👩‍👩‍👧", "a" * 3000, " ".join("ab" * k for k in range(200)), "\x00\x01�", "don't we'll I'M 's", "0" * 700 + "=" * 700, "漢字" * 900]


def test_bpe_matches_the_library(spark, path, tokenizer):
    from tessera.llm.bpe import Decoder, Encoder, encode_documents

    e = Encoder(path)
    texts = ODD + [t for t in varied(3) if t] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    for t in texts:
        ids = np.frombuffer(e.encode(t), "<u4").tolist()
        assert ids == tokenizer.encode(t or "", add_special_tokens=False).ids
        d = Decoder(e.vocabulary)
        assert "".join(d.feed(np.array(ids[k : k + 2])) for k in range(0, len(ids), 2)) + d.end() == tokenizer.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in encode_documents(small(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encode_documents(small(spark, []), path).collect() == []


def test_bpe_window_is_enough(path):
    from tessera.llm.bpe import Encoder

    e, rng = Encoder(path), random.Random(2)
    for letters in ("a", "ab", "thesandig", "=-", "é漢"):
        for _ in range(5):
            data = "".join(rng.choice(letters) for _ in range(5000)).encode()
            assert list(e.stream(iter([data]))) == e.merge(data)
            assert list(e.stream(iter([data[:777], data[777:]]))) == e.merge(data)


def test_bpe_decoder_on_invalid_bytes(path, tokenizer):
    from tessera.llm.bpe import Decoder, Encoder

    e, rng = Encoder(path), random.Random(4)
    for _ in range(300):
        ids = [rng.choice(e.vocabulary.of_byte[120:]) for _ in range(rng.randrange(12))]
        d = Decoder(e.vocabulary)
        assert "".join(d.feed(np.array([i])) for i in ids) + d.end() == tokenizer.decode(ids, skip_special_tokens=False)


def test_token_files(spark, path, tokenizer, tmp_path):
    from tessera.llm.common import new_folder
    from tessera.llm.token_files import read_token_files, write_token_files

    texts = ODD + [t for t in varied(3) if t] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    folder = new_folder(spark, "test")
    files = write_token_files(small(spark, texts, ids), path, folder, tokens_per_file=20_000)
    assert len(files) > 2
    got = [tuple(r) for r in read_token_files(spark, folder, files).orderBy("doc_id").collect()]
    want, start = [], 0
    for i, t in sorted(zip(ids, texts), key=lambda x: x[0]):
        k = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(k), zlib.crc32(np.array(k, "<u4").tobytes())))
        start += len(k)
    assert got == want
    assert read_token_files(spark, folder, write_token_files(small(spark, []), path, folder)).collect() == []


def test_code_lengths_are_optimal_and_limited():
    from tessera.llm.token_files import BitWriter, canonical, code_lengths, decoding_table

    rng = np.random.default_rng(1)
    import heapq

    for n in (1, 2, 3, 50, 700):
        counts = rng.zipf(1.3, n).clip(0, 10**9)
        lengths = code_lengths(counts)
        heap, cost = list(map(int, counts)), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        if n > 1 and lengths.max() < 16:
            assert int((lengths * counts).sum()) == cost
        assert (2.0 ** -lengths.astype(float)).sum() <= 1
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    lengths = code_lengths(np.array(fib))
    assert lengths.max() == 16 and (2.0 ** -lengths.astype(float)).sum() <= 1
    codes = canonical(lengths)
    words = [format(int(c), f"0{n}b") for c, n in zip(codes, lengths)]
    assert not any(a != b and b.startswith(a) for a in words for b in words)


def test_vocabularies_over_two_bytes_of_code():
    from tessera.llm.token_files import BitWriter, TokenFile, code_lengths, limit_for, write_file

    import pyarrow.fs as pafs

    assert limit_for(1) == limit_for(30_000) == 16 and limit_for(70_000) == 18
    rng = np.random.default_rng(3)
    counts = np.concatenate([np.ones(70_000, np.int64), 2 ** np.arange(30)])
    lengths = code_lengths(counts)
    assert 16 < lengths.max() <= 18 and (2.0 ** -lengths.astype(float)).sum() <= 1
    ids = np.concatenate([rng.permutation(len(counts)), rng.integers(70_000, len(counts), 5000)]).astype(np.uint32)
    w = BitWriter(lengths)
    w.add(ids)
    fs = pafs._MockFileSystem()
    write_file(fs, "x.tok", [1, None], [len(ids) - 7, 7], w, lengths)
    with fs.open_input_stream("x.tok") as f:
        read = list(TokenFile(f.read()).documents(3))
    assert [d for d, _ in read] == [1, None] and (np.concatenate([x for _, x in read]) == ids).all()


def test_token_files_of_null_and_repeated_ids(spark, path, tokenizer):
    from tessera.llm.common import new_folder
    from tessera.llm.token_files import read_token_files, write_token_files

    rows = [(5, "later words here"), (None, "no id"), (3, "b b b b"), (3, "a"), (3, "a"), (3, None), (None, ""), (7, "x " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'q' as ids").repartition(3)
    folder = new_folder(spark, "test")
    got = [tuple(r) for r in read_token_files(spark, folder, write_token_files(df, path, folder)).collect()]
    want, start = [], 0
    coded = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    for i, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), zlib.crc32(np.array(x[1], "<u4").tobytes()))):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_bpe_of_null_ids_and_repeated_rows(spark, path, tokenizer):
    from tessera.llm.bpe import encode_documents

    rows = [(1, "two words"), (1, "two words"), (None, "no id"), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in encode_documents(df.drop("n_tokens"), path).collect()))
    assert got == sorted((i is None, i or 0, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_merges_against_the_plain_loop_and_pieces_remembered(monkeypatch):
    import random

    import public_tokenizers

    from tessera.llm.bpe import Encoder

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))

    def plain(data):
        ids = [e.vocabulary.of_byte[b] for b in data]
        while len(ids) > 1:
            found = [(e.vocabulary.merges[x], k) for k, x in enumerate(zip(ids, ids[1:])) if x in e.vocabulary.merges]
            if not found:
                break
            (_, to), k = min((f[0], k, f[1]) and ((f[0], f[1]), k) for f, k in found)
            ids[k : k + 2] = [to]
        return ids

    rng = random.Random(3)
    for _ in range(3000):
        data = "".join(rng.choice("aaabbeinorst thé's,.0011日") for _ in range(rng.randrange(1, 22))).encode()
        assert e.merge(data) == plain(data)
    assert e.merge(b"") == [] and e.merge(b"aaaaaaaaa") == plain(b"aaaaaaaaa")

    merged, kept = [], Encoder.merge
    monkeypatch.setattr(Encoder, "merge", lambda self, data: merged.append(data) or kept(self, data))
    e.known.clear()
    texts = ["word", " word", "a word, a word; a word: word's (word) word  word\n\nword ''s 's", "x word, word'sx\n x"]
    got = [e.encode(t) for t in texts]
    assert len(merged) == len(set(merged))
    monkeypatch.undo()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert got == want and [e.encode(t) for t in texts] == want


def test_encoder_remembers_rare_stretches_and_walks_only_what_a_step_met():
    import numpy as np
    import public_tokenizers
    from tessera.llm.token_files import LibraryEncoder

    class Known(dict):
        def keys(self):
            raise AssertionError("all that is known is walked")

    e = LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    e.known, asked, learn = Known(), [], e.learn
    e.learn = lambda stretches: asked.append(len(stretches)) or learn(stretches)
    texts = [" ".join(f"q{x}" for x in range(k, k + 1000)) for k in range(0, 230_000, 1000)]
    first = e.encode(texts)
    e.encode(["a few words"])
    assert e.encode(texts) == first and asked == [230_000, 3, 0]
    assert np.frombuffer(first[7], "<u2").tolist() == e.tokenizer.encode(texts[7], add_special_tokens=False).ids


def test_encoder_keeps_frequent_stretches_when_it_remembers_too_many(monkeypatch):
    import public_tokenizers
    from tessera.llm import token_files as m

    monkeypatch.setattr(m, "REMEMBERED", 300)
    monkeypatch.setattr(m, "ONCE", 250)
    e = m.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    asked, learn = [], e.learn
    e.learn = lambda stretches: asked.append(len(stretches)) or learn(stretches)
    often, rare, few = (" ".join(f"{c}{k}x" for k in range(n)) for c, n in (("q", 100), ("w", 210), ("z", 5)))
    e.encode([often])
    first = e.encode([often, rare])
    e.encode([often, few])
    assert asked == [100, 210, 5] and len(e.known) == 105 and e.encode([often, rare]) == first
