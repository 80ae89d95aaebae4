"""Token ids in binary files (op2): canonical length-limited Huffman codes from global counts, decoded in independent blocks.

A file holds a run of documents in ascending id order: a JSON head (sizes), code lengths by token id, document ids and token counts,
one bit offset for each block of `block` tokens, and the code bits (most significant first). A block needs only its offset, so many
blocks are decoded at a time, one table lookup of `limit` bits (16, or more for a vocabulary of over
32,768 ids that occur) a token. All integers are little-endian.

Defined results: a null text counts as empty (its only id is the end id); rows with a null id come first; rows with the same id are
ordered by their token count and ids; an empty table gives no file and no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, press, ready, stage, steps, string, table, unpress

MAGIC = b"TKHUF001"
END_ID = 2
LIMIT = 16
BLOCK = 1024
TOKENS_PER_FILE = 8_000_000
#: Stretches whose ids a worker remembers, and those among them that only one step has met so far: beyond either these are forgotten, and
#: all only where the others are too many too (results don't depend on it). A stretch takes some 170 bytes.
REMEMBERED, ONCE = 1_200_000, 800_000


# --- encoding by the tokenizers library -----------------------------------------------------------------------------


class LibraryEncoder:
    """encode_batch of the tokenizers library, asked only for stretches of text that it has not encoded before.

    With a byte-level pre-tokenizer and no normalizer, a single space before a non-space always starts a piece, so the ids of a text
    are those of its stretches between such places, and stretches that start so can be encoded in one string: the tokens' sizes
    tell whose they are. Texts that hold an added token's string, and other kinds of tokenizer, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"]
        self.added = [a["content"] for a in spec["added_tokens"]]
        self.gap = re.compile(r" (?:\s|\Z)").search
        size = self.tokenizer.get_vocab_size(True)
        self.kind = "H" if size <= 1 << 16 else "I"
        self.bytes_in = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])  # byte-level: a character a byte
        self.known: dict[str, bytes] = {}
        self.once: set[str] = set()

    def stretches(self, text: str) -> list[str] | None:
        """None: encode the text whole."""
        if not self.apart or "\0" in text or self.gap(text) or any(a in text for a in self.added):
            return None
        return text.replace(" ", "\0 ").split("\0")

    def learn(self, stretches: list[str], at_once: int = 4000) -> None:
        """Have the library encode stretches: those with a space before them many in one string, others one by one."""
        inner = [p for p in stretches if p[:1] == " "]
        alone = [p for p in stretches if p[:1] != " "]
        groups = [inner[k : k + at_once] for k in range(0, len(inner), at_once)] + [[p] for p in alone]
        joined = ["".join(g) for g in groups]
        size = 2 if self.kind == "H" else 4
        for group, text, e in zip(groups, joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = array(self.kind, e.ids)
            data = ids.tobytes()
            if len(group) == 1:
                self.known[group[0]] = data
                continue
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            ends = np.append(np.flatnonzero(raw == 0x20)[1:], len(raw))  # a stretch's only space is its first character
            cuts = [0, *((np.searchsorted(np.cumsum(self.bytes_in[ids]), ends) + 1) * size).tolist()]
            self.known.update(zip(group, map(data.__getitem__, map(slice, cuts, cuts[1:]))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 16-bit (a vocabulary of up to 65,536) or 32-bit integers."""
        known, parts = self.known, [self.stretches(t) for t in texts]
        if len(known) > REMEMBERED or len(self.once) > ONCE:
            for p in self.once:
                del known[p]
            self.once.clear()
            if len(known) > REMEMBERED:
                known.clear()
        met = set().union(*(x for x in parts if x is not None))
        self.once -= met
        new = met.difference(known)  # walks met; `-` would walk all that is known
        self.learn(list(new))
        self.once |= new
        whole = iter(self.tokenizer.encode_batch_fast([t for t, x in zip(texts, parts) if x is None], add_special_tokens=False))
        return [b"".join(map(known.__getitem__, x)) if x is not None else array(self.kind, next(whole).ids).tobytes() for x in parts]


_made: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One for each Python worker."""
    if path not in _made:
        _made[path] = LibraryEncoder(path)
    return _made[path]


def encoded(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens (with the end id), ids (zstd-packed) and, in some rows, counts of several rows' ids."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = library_encoder(path)
        kind = "<u2" if e.kind == "H" else "<u4"
        end, pack = array(e.kind, [end_id]).tobytes(), zstandard.ZstdCompressor(1, write_content_size=True)
        for rows in parts:
            for some in steps(rows, "text", 2 << 20):
                ids = [x + end for x in e.encode([string(t) or "" for t in some.text])]
                total = np.bincount(np.frombuffer(b"".join(ids), kind))
                seen = np.flatnonzero(total)
                counts = [press(np.stack([seen, total[seen]]).reshape(-1))] + [None] * (len(ids) - 1)  # with the first row of a step
                yield pd.DataFrame({"doc_id": some.doc_id.to_numpy(), "n_tokens": [len(x) // len(end) for x in ids], "wide": e.kind == "I", "ids": [pack.compress(x) for x in ids], "counts": counts})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n_tokens long, wide boolean, ids binary, counts binary")


def unpacked(wide: bool, ids: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), "<u4" if wide else "<u2")


def token_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs in the whole table; as long as the vocabulary at most."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for rows in parts:
            for packed in rows.counts:
                seen, n = unpress(packed, np.int64).reshape(2, -1)
                if seen[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(seen[-1] + 1 - len(total), np.int64)])
                total[seen] += n
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"token": seen, "n": total[seen]})

    rows = ids.select("counts").where("counts is not null").mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows.token.max()) + 1 if len(rows) else 0, np.int64)
    out[rows.token.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return out


# --- the code -----------------------------------------------------------------------------------------------------------


def limit_for(n_ids: int) -> int:
    """Bits of the longest code: LIMIT, or one more than codes of equal length need."""
    return max(LIMIT, (max(1, n_ids) - 1).bit_length() + 1)


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over `limit` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    limit = limit or limit_for(len(used))
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    packages, levels = np.zeros(0, np.int64), []
    for _ in range(limit):
        both = np.concatenate([leaf, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(leaf))
        both = both[rank]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(leaf) - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        out[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - last
            codes[i], last = code, int(lengths[i])
            code += 1
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For every `limit` bits that may come next: the id they begin with, and its length."""
    codes = canonical(lengths)
    symbol, size = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    order = np.flatnonzero(lengths)
    order = order[np.lexsort((order, lengths[order]))]
    at = (codes[order] << (limit - lengths[order]).astype(np.uint64)).astype(np.int64)
    for a, n, i in zip(at.tolist(), (1 << (limit - lengths[order].astype(np.int64))).tolist(), order.tolist()):
        symbol[a : a + n], size[a : a + n] = i, lengths[i]
    return symbol, size


class BitWriter:
    """Codes of ids, slice by slice, into 32-bit words."""

    def __init__(self, lengths: np.ndarray, block: int = BLOCK) -> None:
        self.lengths, self.codes, self.block = lengths.astype(np.int64), canonical(lengths), block
        self.words: list[np.ndarray] = [np.zeros(1, np.uint64)]
        self.bit = self.tokens = 0
        self.offsets: list[np.ndarray] = []

    def add(self, ids: np.ndarray) -> None:
        for k in range(0, len(ids), 1 << 18):
            self._add(ids[k : k + (1 << 18)])

    def _add(self, ids: np.ndarray) -> None:
        size = self.lengths[ids]
        at = self.bit + np.concatenate([[0], np.cumsum(size)])
        self.offsets.append(at[:-1][-self.tokens % self.block :: self.block])
        base = self.bit >> 5
        word = (at[:-1] >> 5) - base
        value = self.codes[ids] << (64 - (at[:-1] & 31) - size).astype(np.uint64)
        n = int(at[-1] >> 5) - base + 2
        out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        out = out[:n].astype(np.uint64)
        self.words[-1][-1] |= out[0]  # the word that the last slice began
        self.bit, self.tokens = int(at[-1]), self.tokens + len(ids)
        self.words.append(out[1 : (self.bit >> 5) - base + 1])
        if not len(self.words[-1]):
            self.words.pop()

    def parts(self) -> tuple[np.ndarray, bytes]:
        return np.concatenate([*self.offsets, np.zeros(0, np.int64)]).astype("<u8"), np.concatenate(self.words).astype(">u4").tobytes() + b"\0" * 4


def write_file(fs: pafs.FileSystem, path: str, doc_ids: list, sizes: list[int], w: BitWriter, lengths: np.ndarray) -> int:
    offsets, bits = w.parts()
    known = np.array([d is not None and d == d for d in doc_ids], bool)
    head = json.dumps({"documents": len(sizes), "tokens": w.tokens, "block": w.block, "limit": max(LIMIT, int(lengths.max(initial=0))), "ids": len(lengths), "bits": len(bits)}).encode()
    body = [MAGIC, len(head).to_bytes(4, "little"), head, lengths.astype(np.uint8).tobytes(), known.tobytes(), np.array([d if k else 0 for d, k in zip(doc_ids, known)], "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), offsets.tobytes(), bits]
    with fs.open_output_stream(path + ".part") as f:
        for x in body:
            f.write(x)
    fs.move(path + ".part", path)
    return sum(map(len, body))


class TokenFile:
    """A file's documents; blocks() decodes any run of blocks on its own."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(data[8:12], "little")
        self.head = h = json.loads(data[12 : 12 + n])
        at = 12 + n

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        lengths = take("u1", h["ids"])
        self.known, self.doc_ids, self.sizes = take("?", h["documents"]), take("<i8", h["documents"]), take("<u4", h["documents"]).astype(np.int64)
        self.offsets = take("<u8", -(-h["tokens"] // h["block"])).astype(np.int64)
        self.bits = take("u1", h["bits"])
        self.symbol, self.size = decoding_table(lengths, h["limit"])
        self.size = self.size.astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks first..last-1."""
        step, limit = self.head["block"], self.head["limit"]
        at = self.offsets[first:last].copy()
        total = min(self.head["tokens"], last * step) - first * step
        out = np.zeros((len(at), step), np.uint32)
        base = int(at[0]) >> 3
        end = (int(self.offsets[last]) >> 3) + 4 if last < len(self.offsets) else len(self.bits)
        b = np.concatenate([self.bits[base:end], np.zeros(limit * step // 8 // 8 + 8, np.uint8)]).astype(np.uint32)
        view = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        at -= base * 8
        most = len(view) - 1
        for k in range(min(step, total)):
            code = (view[np.minimum(at >> 3, most)] >> (32 - limit - (at & 7)).astype(np.uint32)) & ((1 << limit) - 1)
            out[:, k] = self.symbol[code]
            at += self.size[code]
        return out.reshape(-1)[:total]

    def documents(self, at_once: int = 8192) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, token ids) in file order, with a few blocks in memory."""
        held, block = np.zeros(0, np.uint32), 0
        for k, n in enumerate(self.sizes.tolist()):
            while len(held) < n:
                held = np.concatenate([held, self.blocks(block, min(block + at_once, len(self.offsets)))])
                block += at_once
            yield (int(self.doc_ids[k]) if self.known[k] else None), held[:n]
            held = held[n:]


# --- tables to files and back ---------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, tokens_per_file: int = TOKENS_PER_FILE) -> list[tuple[str, int, int, int]]:
    """Write the documents' ids in ascending id order; gives (file, documents, tokens, bytes) of each file, in order.

    The list has one entry for `tokens_per_file` tokens; nothing else but the counts by id comes to the driver.
    """
    spark = ready(docs.sparkSession)
    ids = stage(encoded(docs, path, id_col, text_col, end_id), "ids", blobs=True)
    total = ids.agg(F.sum("n_tokens")).first()[0]
    if not total:
        return []
    lengths = code_lengths(token_counts(ids))
    code = spark.sparkContext.broadcast(lengths)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        w, doc_ids, sizes = BitWriter(code.value), [], []
        for rows in parts:
            doc_ids += [None if d is None or d != d else int(d) for d in rows.doc_id.astype(object)]
            sizes += rows.n_tokens.tolist()
            for k in range(0, len(rows), 500):
                some = rows.iloc[k : k + 500]
                w.add(np.concatenate([unpacked(wide, packed) for wide, packed in zip(some.wide, some.ids)]))
        if sizes:
            part = TaskContext.get().partitionId()
            fs, where = pafs.FileSystem.from_uri(folder)
            fs.create_dir(where, recursive=True)
            name = f"{where}/part-{part:06d}-{uuid.uuid4().hex}.tok"  # a repeated attempt writes a file of its own
            size = write_file(fs, name, doc_ids, sizes, w, code.value)
            yield pd.DataFrame({"part": [part], "file": [name], "documents": [len(sizes)], "tokens": [w.tokens], "bytes": [size]})

    n = -(-total // tokens_per_file)
    ids = ids.drop("counts")
    ordered = (ids.repartitionByRange(int(n), "doc_id") if n > 1 else ids.repartition(1)).sortWithinPartitions("doc_id", "n_tokens", "ids")
    made = stage(ordered.mapInPandas(write, "part long, file string, documents long, tokens long, bytes long"), "files").orderBy("part").collect()
    return [(r.file, r.documents, r.tokens, r.bytes) for r in made]


def read_token_files(spark: SparkSession, folder: str, files: list[tuple[str, int, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, decoded from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    starts = np.cumsum([0, *(f[2] for f in files)])
    wanted = spark.createDataFrame([(f[0], int(s)) for f, s in zip(files, starts)], "file string, start long").repartition(len(files))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for rows in parts:
            for file, start in zip(rows.file, rows.start):
                with fs.open_input_stream(file) as f:
                    data = TokenFile(f.read())
                out = []
                for d, ids in data.documents():
                    out.append((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) >= 20_000:
                        yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    return wanted.mapInPandas(read, schema)


def op2_token_id_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ready(spark)
    folder = new_folder(spark, "token-files")
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(spark, folder, files)
