"""Substring dedup (op3): difference-cover anchors.

A window of `window` words is a repeat if its word sequence also starts earlier (smaller id, or the same document further left). Short
runs of words ("anchors") are hashed only at positions whose remainder modulo a period lies in a difference cover: two equal windows,
however shifted against each other, then share an aligned anchor. Anchors that occur once are done with; around the others all windows
that hold such an anchor are hashed in full (the extension), and the earliest start of each is found by a minimum, so no pairs are made
and a passage that very many documents share costs one question for each block of documents.

Defined results: a null text has no words; rows with a null id come after all others; rows with the same id at the same start are
equally early, so neither is removed for the other; an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import NO_ID, Block, blocks_of, pack
from .common import DEALT, Words, answered, answers_of, bucket_count, deal_rows, gathered, press, spread, table, unpress

#: Perfect difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
WINDOW = 20
#: One question about a window: where its first start in the block is, and a second hash that tells chance meetings apart.
FIRST = np.dtype([("doc", "<i8"), ("row", "<u4"), ("pos", "<u4"), ("check", "<u2")])
#: Where a window starts: the document's place in its block, and the word.
PLACE = np.dtype([("row", "<u4"), ("pos", "<u4")])


def period_of(window: int) -> int:
    return max(m for m in COVERS if m <= max(1, 2 * window // 3))


class Anchors:
    """Anchors of a block: `at` (word indexes), and their hashes as sorted distinct `keys` with `inverse`."""

    def __init__(self, words: Words, window: int) -> None:
        m = period_of(window)
        self.length = window - m + 1
        inside = words.within(self.length)
        doc = np.repeat(np.arange(len(words.start) - 1), np.diff(words.start))
        chosen = np.zeros(m, bool)
        chosen[list(COVERS[m])] = True
        self.at = inside[chosen[(inside - words.start[doc[inside]]) % m]]
        self.keys, self.inverse, self.counts = np.unique(words.runs(self.length)[self.at] if len(self.at) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)


def repeats(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The packed documents, and block, places: where repeats start."""
    blocks = pack(docs, id_col, text_col)
    n_words = blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = bucket_count(n_words * 3)

    def ask_anchors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks_of(parts):
            a = Anchors(b.words(), window)
            yield pd.DataFrame({"block": [b.block], "keys": [a.keys.tobytes()], "vals": [np.minimum(a.counts, 2).astype("u1").tobytes()]})

    def more_than_one(keys: np.ndarray, vals: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (spread(np.add.reduceat(vals.astype(np.int64), at), at, len(keys)) > 1).astype("u1")

    def ask_windows(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.itertuples(index=False):
            b = Block(row)
            w = b.words()
            a = Anchors(w, window)
            hit = a.at[answers_of(answers, "u1").astype(bool)[a.inverse]] if len(a.at) else a.at
            n = len(w.hash)
            near = np.zeros(n + 1, np.int64)  # windows from hit - (period - 1) to hit hold that anchor
            np.add.at(near, np.maximum(hit - (window - a.length), 0), 1)
            np.add.at(near, np.minimum(hit + 1, n), -1)
            inside = w.within(window)
            start = inside[np.cumsum(near)[inside] > 0]
            if not len(start):
                continue
            row = np.searchsorted(w.start, start, "right") - 1
            place, ids = np.zeros(len(start), PLACE), b.doc_ids[row]
            place["row"], place["pos"] = row, start - w.start[row]
            order = np.lexsort((place["pos"], ids))  # documents of a block come in any order
            start, place, ids = start[order], place[order], ids[order]
            keys, first, inverse = np.unique(w.runs(window)[start], return_index=True, return_inverse=True)
            vals = np.zeros(len(keys), FIRST)
            vals["doc"], vals["row"], vals["pos"], vals["check"] = ids[first], place["row"][first], place["pos"][first], w.runs(window, 5)[start[first]] >> np.uint64(48)
            later = (ids != ids[first][inverse]) | (place["pos"] != place["pos"][first][inverse])
            out.append({"block": b.block, "keys": keys.tobytes(), "vals": vals.tobytes(), "later": press(place[later])})
        return pd.DataFrame(out, columns=["block", "keys", "vals", "later"])

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for block, keys, vals, later in zip(rows.block, rows["keys"], rows.vals, rows.later):
                yield deal_rows(block, np.frombuffer(keys, np.uint64), np.frombuffer(vals, FIRST), buckets)
                if later:  # what a block knows to be repeats by itself goes along in parts of its own
                    yield pd.DataFrame({"part": [buckets + block % buckets], "block": [block], "keys": [b""], "vals": [later]})

    def repeated(rows: pd.DataFrame) -> pd.DataFrame:
        if rows.part.iloc[0] >= buckets:
            return rows[["block", "vals"]].rename(columns={"vals": "places"})
        keys, vals, order, cuts = gathered(rows, FIRST)
        by = np.lexsort((vals["pos"], vals["doc"], vals["check"], keys))
        k, v = keys[by], vals[by]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (v["check"][1:] != v["check"][:-1])])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        again = np.zeros(len(k), bool)
        again[order[by]] = (v["doc"] != v["doc"][lead]) | (v["pos"] != v["pos"][lead])
        place = np.zeros(len(k), PLACE)
        place["row"][order], place["pos"][order] = vals["row"], vals["pos"]
        out = [(b, press(place[x:y][again[x:y]])) for b, x, y in zip(rows.block.tolist(), cuts, cuts[1:]) if again[x:y].any()]
        return pd.DataFrame(out, columns=["block", "places"])

    asked = answered(blocks.mapInPandas(ask_anchors, "block long, keys binary, vals binary"), bucket_count(n_words * 2), more_than_one, "u1")
    windows = blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(ask_windows, "block long, keys binary, vals binary, later binary")
    return blocks, windows.mapInPandas(deal, DEALT).groupBy("part").applyInPandas(repeated, "block long, places binary")


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and, with keep_text, the kept words joined by one space."""
    blocks, found = repeats(docs, window, id_col, text_col)

    def cut(blocks: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.itertuples(index=False):
            b = Block(row)
            words = [r.split() for r in b.raw]
            ends = np.cumsum([0, *map(len, words)])
            gone = np.zeros(ends[-1] + 1, np.int64)
            place = np.concatenate([np.zeros(0, PLACE), *(unpress(x, PLACE) for x in found.places)])
            s = ends[:-1][place["row"]] + place["pos"].astype(np.int64)
            np.add.at(gone, s, 1)
            np.add.at(gone, s + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            removed = np.add.reduceat(np.concatenate([gone, [0]]), ends[:-1]) * (np.diff(ends) > 0) if len(words) else []
            for d, w, a, e, n in zip(b.doc_ids.tolist(), words, ends, ends[1:], removed):
                kept = b" ".join([x for x, g in zip(w, gone[a:e].tolist()) if not g] if n else w)
                out.append((None if d == NO_ID else d, len(w), int(n), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return (out if keep_text else out.drop("kept")).withColumnRenamed("doc_id", id_col)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
