"""BPE encoding and decoding (op7): a bounded-lookahead streaming transducer and an incremental byte-to-text decoder.

Encoding reads a text piece by piece (the pre-tokenizer's pieces) and each piece byte by byte. A piece that is longer than the window
is encoded in windows: the tokens that end at least `lookahead` bytes before the window's end can no longer change, so they are
emitted, and the window moves on. `lookahead` is computed from the merge list: a merge at some place is pre-empted only by an
earlier-listed merge that takes its right symbol, which in turn is pre-empted only by a still earlier one; the longest such chain,
in bytes, is all that has to be seen. Memory is constant in the text's length but for the ids that are returned.

Defined results: a null text counts as empty (no ids, empty decoded text); a row with a null id is encoded like any other; repeated
rows each give a row; other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, steps, string, table

#: The pre-tokenizer's pattern of the byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers; beyond it the memory starts anew (results don't depend on it).
REMEMBERED = 250_000
NO_RANK = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    return out | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Vocabulary:
    """Tokens, merges and added tokens of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        as_bytes = {t: bytes(alphabet[c] for c in t) for t in vocab if all(c in alphabet for c in t)}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for t, i in vocab.items():
            self.bytes_of[i] = as_bytes.get(t, t.encode())
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.of_byte = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])

    def lookahead(self) -> int:
        """Bytes beyond a token's end that can still change it: the longest chain of pre-empting merges."""
        ranks: dict[int, list[int]] = {}  # by left symbol: ranks in order, and the largest reach up to each
        reach: dict[int, list[int]] = {}
        made: dict[int, tuple[int, int]] = {}  # a symbol's right half and the rank that joins it
        most = 0

        def beyond(symbol: int, rank: int) -> int:
            """Reach to the right of a symbol that a merge of this rank is about to use."""
            found = 0
            while True:
                if symbol in ranks and (k := bisect_left(ranks[symbol], rank)):
                    found = max(found, reach[symbol][k - 1])
                if symbol not in made:
                    return found
                symbol, rank = made[symbol]

        for (left, right), (rank, whole) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            far = len(self.bytes_of[right]) + beyond(right, rank)
            most = max(most, far)
            made.setdefault(whole, (right, rank))
            ranks.setdefault(left, []).append(rank)
            past = reach.setdefault(left, [])
            past.append(max(far, past[-1] if past else 0))
        longest = max(map(len, self.bytes_of))
        return most + longest


class Encoder:
    """Text to ids; `special` as the tokenizers library does by default: an added token's string is that token."""

    def __init__(self, path: str, special: bool = True) -> None:
        self.vocabulary = v = Vocabulary(path)
        self.rank_of = {pair: rank for pair, (rank, _) in v.merges.items()}
        self.made_by = dict(v.merges.values())
        self.lookahead = v.lookahead()
        self.window = 4 * self.lookahead
        self.find = regex.compile(PIECES).findall
        self.added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(v.added, key=len, reverse=True)) + ")") if special and v.added else None
        self.inner_gap = regex.compile(r" (?:\s|$)").search
        self.known: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece, all of it at hand."""
        of_byte = self.vocabulary.of_byte
        ids = [of_byte[b] for b in data]
        if len(ids) > 64:
            return self.merge_long(ids)
        get, made = self.rank_of.get, self.made_by
        ranks = [get(x, NO_RANK) for x in zip(ids, ids[1:])]  # of each symbol with the next; a merge changes two of them
        while ranks and (best := min(ranks)) < NO_RANK:
            k = ranks.index(best)
            ids[k : k + 2] = [made[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), NO_RANK)
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), NO_RANK)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap: n log n for long pieces."""
        from heapq import heapify, heappop, heappush

        get = self.vocabulary.merges.get
        n = len(ids)
        nxt, prev = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(f[0], k, ids[k], ids[k + 1], f[1]) for k in range(n - 1) if (f := get((ids[k], ids[k + 1])))]
        heapify(heap)
        while heap:
            _, k, left, right, to = heappop(heap)
            r = nxt[k]
            if ids[k] != left or r < 0 or ids[r] != right:
                continue
            ids[k], ids[r] = to, -1
            nxt[k] = nxt[r]
            if nxt[r] >= 0:
                prev[nxt[r]] = k
                if f := get((to, ids[nxt[r]])):
                    heappush(heap, (f[0], k, to, ids[nxt[r]], f[1]))
            if prev[k] >= 0 and (f := get((ids[prev[k]], to))):
                heappush(heap, (f[0], prev[k], ids[prev[k]], to, f[1]))
        return [i for i in ids if i >= 0]

    def stream(self, chunks: Iterator[bytes]) -> Iterator[int]:
        """Ids of one piece that arrives in chunks: emitted once stable, with a window of constant size."""
        held, bytes_of = b"", self.vocabulary.bytes_of
        for chunk in chunks:
            for k in range(0, len(chunk), self.window):
                held += chunk[k : k + self.window]
                if len(held) >= self.window:
                    done = 0
                    for i in self.merge(held):
                        if done + len(bytes_of[i]) > len(held) - self.lookahead:
                            break
                        done += len(bytes_of[i])
                        yield i
                    held = held[done:]
        yield from self.merge(held)

    def piece(self, text: str) -> bytes:
        data = text.encode("utf-8", "replace")
        ids = self.merge(data) if len(data) <= self.window else list(self.stream(iter([data])))
        return struct.pack(f"<{len(ids)}I", *ids)

    def remembered(self, piece: str) -> bytes:
        """A piece's ids; pieces recur in many stretches (a word before a comma, a number, the comma itself)."""
        ids = self.known.get(piece)
        if ids is None:
            ids = self.piece(piece)
            if len(piece) < 64:
                self.known[piece] = ids
        return ids

    def segment(self, text: str) -> bytes:
        """Ids (little-endian, 32 bits each) of a text without added tokens."""
        # A single space before a non-space always starts a piece, so such stretches are encoded, and remembered, one by one.
        parts = self.find(text) if self.inner_gap(text) else [a if k == 0 else " " + a for k, a in enumerate(text.split(" "))]
        known = self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for p in parts:
            ids = known.get(p)
            if ids is None:
                pieces = self.find(p)
                ids = b"".join(map(self.remembered, pieces))
                if len(p) < 64 and len(pieces) > 1:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self.added is None or not self.added.search(text):
            return self.segment(text)
        return b"".join(int(self.vocabulary.added[s]).to_bytes(4, "little") if k % 2 else self.segment(s) for k, s in enumerate(self.added.split(text)))


class Decoder:
    """Ids to text, a chunk at a time: bytes of a character may come from several tokens; what is not UTF-8 becomes U+FFFD."""

    #: Bytes that follow a lead byte, and the bounds of the first of them (which exclude overlong forms, surrogates and planes over 16).
    def __init__(self, vocabulary: Vocabulary, pieces: bool = True) -> None:
        self.bytes_of = vocabulary.bytes_of
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Bytes at the end that may begin a character whose rest has not come."""
        for k in range(1, min(3, len(data)) + 1):
            b = data[-k]
            if b >= 0xC2:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF5 else 1
                if k >= need:
                    return 0
                if k >= 2:
                    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                    return k if low <= data[-k + 1] <= high else 0
                return k
            if b < 0x80:
                return 0
        return 0

    def feed(self, ids: np.ndarray) -> str:
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        k = self.unfinished(data)
        self.held = data[len(data) - k :] if k else b""
        return (data[: len(data) - k] if k else data).decode("utf-8", "replace")

    def end(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


_made: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    """One for each Python worker."""
    if (path, special) not in _made:
        _made[path, special] = Encoder(path, special)
    return _made[path, special]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 16, keep_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, round_trip (decoded text equals the text) and, with keep_ids, ids as binary."""
    ready(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for rows in parts:
            for some in steps(rows, "text"):
                out = []
                for text in some.text:
                    ids = e.encode(string(text))
                    d, flat, sha, size, want = Decoder(e.vocabulary), np.frombuffer(ids, "<u4"), hashlib.sha256(), 0, hashlib.sha256((string(text) or "").encode("utf-8", "replace")).hexdigest()
                    for k in range(0, len(flat), chunk):
                        sha.update(d.feed(flat[k : k + chunk]).encode())
                    sha.update(d.end().encode())
                    out.append((len(flat), hashlib.sha256(ids).hexdigest(), sha.hexdigest(), sha.hexdigest() == want, ids if keep_ids else None))
                made = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "ids"])
                made.insert(0, "id", some["id"].to_numpy())
                yield made

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, ids binary")
    return (out if keep_ids else out.drop("ids")).withColumnRenamed("id", id_col)


def op7_bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
