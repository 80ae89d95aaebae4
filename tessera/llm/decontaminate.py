"""Benchmark decontamination (op10): spaced-seed hashing.

Words are lower-cased runs of letters, digits and non-ASCII characters. A document holds an item if SPAN = 13 consecutive words of the
item stand in the document, aligned, with at most SUBSTITUTIONS = 2 of them replaced. Each fixed mask hashes only some of 13 positions;
whichever two words are replaced, one of the masks fits between them at some offset (a test tries all pairs), so every such passage
has a hit. Around each hit the aligned words are compared, so chance hits don't count. Items of 4 to 12 words have to occur whole, with
one word in SHORT_PER replaced at most. Shorter ones are no evidence inside of a text; they match a text that has their words and no others.

The benchmark is cut into slices of bounded size, written to the shared folder and read by each task one after the other: training
documents are read once and nothing is shuffled, whatever the sizes.

Defined results: a null or empty text is clean; null items, and items without words, match nothing; an item without an id counts and is
listed as null, before the others; rows with a null id are judged like others; repeated rows each give a row, repeated items count once;
empty tables give no rows, or clean ones; other columns play no part.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, new_folder, ready, steps, string, table

SPAN, SUBSTITUTIONS = 13, 2
#: Positions that count, of SPAN words: any two substitutions leave one of these free at some offset.
MASKS = ((0, 1, 2, 3, 5, 7, 8), (0, 2, 5, 6, 8, 9, 10), (0, 1, 3, 4, 7, 8, 9))
#: For items shorter than SPAN: one substitution among 8 to 12 words leaves 4 words in a row.
SHORT_MASK, SHORT_LEAST, SHORT_PER = (0, 1, 2, 3), 4, 8
#: Characters of benchmark text in one slice (about 60 MB of hashes).
SLICE_CHARS = 8_000_000
_SEPARATORS = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])


def normalized(texts: list[str | None]) -> Words:
    return Words([(t or "").lower() for t in texts], separators=_SEPARATORS)


def masked(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, p in enumerate(mask):
        out += words[p : p + n] * np.uint64(2 * pow(5, 3 * k + 7, 1 << 62) + 1)
    return mix(out + np.uint64(sum(1 << p for p in mask)))


class Slice:
    """Items of one slice: words, and for each mask the sorted hashes of all places with a bitmap before them."""

    def __init__(self, ids: list[int | None], texts: list[str]) -> None:
        w = normalized(texts)
        self.ids, self.hash, self.start = ids, w.hash, w.start
        size = np.diff(w.start)
        owner = np.repeat(np.arange(len(ids)), size)
        self.index = []
        for mask, chosen in [*((m, size >= SPAN) for m in MASKS), (SHORT_MASK, (size >= SHORT_LEAST) & (size < SPAN))]:
            h = masked(w.hash, mask)
            at = np.flatnonzero(chosen[owner[: len(h)]] & (owner[: len(h)] == owner[mask[-1] :])) if len(h) else np.zeros(0, np.int64)
            at = at[np.argsort(h[at], kind="stable")]
            bits = np.zeros(1 << 20, bool)
            bits[h[at] & np.uint64((1 << 20) - 1)] = True
            self.index.append((mask, h[at], at, bits))
        self.owner = owner
        self.whole: dict[tuple, list[int]] = {}
        for k in np.flatnonzero((size > 0) & (size < SHORT_LEAST)).tolist():
            self.whole.setdefault(tuple(w.hash[w.start[k] : w.start[k + 1]].tolist()), []).append(k)

    def hits(self, words: Words) -> Iterator[tuple[int, int]]:
        """(document, item) pairs that are confirmed."""
        seen: set[tuple[int, int]] = set()
        if self.whole:
            for d in np.flatnonzero(np.diff(words.start) < SHORT_LEAST).tolist():
                yield from ((d, i) for i in self.whole.get(tuple(words.hash[words.start[d] : words.start[d + 1]].tolist()), ()))
        for mask, keys, at, bits in self.index:
            if not len(keys):
                continue
            h = masked(words.hash, mask)
            place = np.flatnonzero(bits[h & np.uint64((1 << 20) - 1)])
            lo, hi = np.searchsorted(keys, h[place], "left"), np.searchsorted(keys, h[place], "right")
            place, lo, n = place[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(place):
                continue
            item_at = at[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            item = self.owner[item_at]
            doc = np.searchsorted(words.start, np.repeat(place, n), "right") - 1
            shift = np.repeat(place, n) - (item_at - self.start[item])  # where the item's first word would stand
            for d, i, s in np.unique(np.stack([doc, item, shift], 1), axis=0).tolist():
                if (d, i) not in seen and self.fits(words, d, i, s):
                    seen.add((d, i))
                    yield d, i

    def fits(self, words: Words, doc: int, item: int, shift: int) -> bool:
        own = self.hash[self.start[item] : self.start[item + 1]]
        lo, hi = max(shift, int(words.start[doc])), min(shift + len(own), int(words.start[doc + 1]))
        span = min(SPAN, len(own))
        if hi - lo < span:
            return False
        same = np.concatenate([[0], np.cumsum(words.hash[lo:hi] == own[lo - shift : hi - shift])])
        return bool((same[span:] - same[:-span]).max() >= span - (SUBSTITUTIONS if span == SPAN else span // SHORT_PER))


def write_slices(items: DataFrame, id_col: str, text_col: str, slice_chars: int) -> tuple[str, list[str]]:
    """One file for each slice; the driver holds one slice at a time."""
    spark = items.sparkSession
    folder = new_folder(spark, "benchmark")
    own = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    n = 1 + int(own.agg(F.sum(F.length("text"))).first()[0] or 0) // slice_chars
    fs, where = pafs.FileSystem.from_uri(folder)
    fs.create_dir(where, recursive=True)
    files = []
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toPandas()
        if len(rows):
            buf = io.BytesIO()
            rows.to_parquet(buf)
            with fs.open_output_stream(f"{where}/{k}.parquet") as f:
                f.write(buf.getvalue())
            files.append(f"{where}/{k}.parquet")
    return folder, files


_slices: OrderedDict[str, Slice] = OrderedDict()


def read_slice(folder: str, file: str) -> Slice:
    """The last two stay in memory."""
    if file not in _slices:
        fs, _ = pafs.FileSystem.from_uri(folder)
        with fs.open_input_file(file) as f:
            rows = pd.read_parquet(io.BytesIO(f.read()))
        _slices[file] = Slice([None if i is None or i != i else int(i) for i in rows.id.astype(object)], rows.text.tolist())
        while len(_slices) > 2:
            _slices.popitem(last=False)
    return _slices[file]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_chars: int = SLICE_CHARS, keep_text: bool = True) -> DataFrame:
    """Every row of docs (id and, with keep_text, text) with n_words, n_items, items (sorted ids) and contaminated."""
    ready(docs.sparkSession)
    folder, files = write_slices(items, item_col, item_text_col, slice_chars)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for some in steps(rows, "text", 1 << 20):
                words = normalized([string(t) for t in some.text])
                found: list[set[int | None]] = [set() for _ in range(len(some))]
                for file in files:
                    s = read_slice(folder, file)
                    for d, i in s.hits(words):
                        found[d].add(s.ids[i])
                out = pd.DataFrame({"id": some["id"].to_numpy(), "text": some.text.to_numpy() if keep_text else None, "n_words": np.diff(words.start), "n_items": list(map(len, found)), "items": [sorted(x, key=lambda i: (i is not None, i)) for x in found]})
                out["contaminated"] = out.n_items > 0
                yield out

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, text string, n_words long, n_items long, items array<long>, contaminated boolean")
    return (out if keep_text else out.drop("text")).withColumnsRenamed({"id": id_col, "text": text_col})


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep_text=False)
