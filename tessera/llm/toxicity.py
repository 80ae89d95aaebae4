"""Toxicity (op8): nearest labelled examples by exact TF-IDF cosine over a block-max inverted index; votes give the score.

Features of a text are its lower-cased words and the first STEM bytes of longer words (stems of inflected words). Every feature that at
least LEAST_DOCS texts of the labelled sample hold is in the vocabulary. Its weight is TF-IDF times a factor that is FLOOR for features
that say nothing about the label and grows with the (shrunk) log of how much likelier label 1 is where the feature stands; all features
count, so every text that shares any of them with an example has neighbours. The nearest NEIGHBOURS examples vote with their cosine as
weight, shrunk to the base rate; isotonic regression over leave-one-out votes of the sample makes the vote a probability. A text without
any feature gets the rate of label 1 among such examples.

Examples that resemble each other share a block. Lists of rare features are walked in full; for the lists of frequent ones (more than
one example in HEAD_PART), which make up most postings, the largest weight in each block is kept, so a block's best possible cosine is
known, and blocks that can't reach the nearest found so far are left out. The result is that of comparing all examples.

The model is fitted on the texts of at most SAMPLE labelled rows (those with the smallest hash of their id), which bounds what is sent to
the executors; every document is scored.

Defined results: a null text counts as empty; labels that are null, or rows that are held out, teach nothing; without labels of both kinds
all scores are the base rate; rows with a null id are scored and not held out; repeated rows each give a row; empty tables give no rows;
of equally near examples the smaller id is nearer; other columns play no part, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, give_back, mix, press, ready, stage, steps, string, table, unpress
from .decontaminate import _SEPARATORS as SEPARATORS

SAMPLE, LEAST_DOCS, STEM = 8_000, 2, 5
FLOOR, PRIOR = 0.1, 20.0
NEIGHBOURS, SHRINK = 25, 0.5
BLOCK, HEAD_PART, MOST_HEAD, FIRST_BLOCKS = 64, 20, 512, 4
HELD_OUT_OF, HELD_OUT, CUT = 4, 2, 0.3
#: Characters of text whose features are in memory at a time, and texts that are compared with the examples at a time.
STEP, TEXTS = 1 << 20, 64
#: Entries of posting lists that the texts compared at a time ask for, unless a single text asks for more, and those in memory at a time
#: (some 40 bytes each), unless a single list has more.
POSTINGS, SUMMED = 1 << 23, 1 << 16
#: Entries that are brought into order by feature at a time.
SORTED = 1 << 19


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of every word and stem of the texts."""
    w = Words([(t or "").lower() for t in texts], separators=SEPARATORS)
    doc = np.repeat(np.arange(len(texts)), np.diff(w.start))
    long = np.flatnonzero(w.hi - w.lo > STEM)
    h = np.full(len(long), STEM, np.uint64)
    for k in range(STEM):
        h = mix(h + w.buf[w.lo[long] + k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate([doc, doc[long]]), np.concatenate([w.hash, h])


@dataclass
class Vectors:
    """Sparse rows of unit length: row k has features and weights start[k]:start[k+1]."""

    start: np.ndarray
    feature: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def rows(self, a: int, b: int) -> Vectors:
        lo, hi = self.start[a], self.start[b]
        return Vectors(self.start[a : b + 1] - lo, self.feature[lo:hi], self.weight[lo:hi])

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))


def counted(x: np.ndarray, size: int) -> np.ndarray:
    """np.bincount, which makes a copy of 64 bits a value, slice by slice."""
    out = np.zeros(size, np.int64)
    for a in range(0, len(x), SORTED):
        out += np.bincount(x[a : a + SORTED], minlength=size)
    return out


def transposed(v: Vectors, size: int, name: np.ndarray | None = None) -> Vectors:
    """A row for each of `size` features, which holds v's rows (row k as name[k], if given) and their weights; sorted a few features at a time."""
    kind = np.uint16 if len(v) <= 1 << 16 else np.int32
    owner = np.repeat((np.arange(len(v)) if name is None else name).astype(kind), np.diff(v.start))
    start = np.concatenate([[0], np.cumsum(counted(v.feature, size))])
    out = Vectors(start, np.empty_like(owner), np.empty_like(v.weight))
    a = 0
    while a < size:
        b = max(a + 1, int(np.searchsorted(start, start[a] + SORTED, "right")) - 1)
        at = np.flatnonzero((v.feature >= a) & (v.feature < b))
        at = at[np.argsort(v.feature[at], kind="stable")]
        out.feature[start[a] : start[b]], out.weight[start[a] : start[b]] = owner[at], v.weight[at]
        a = b
    return out


class Space:
    """The vocabulary: sorted feature hashes and their weights, from the numbers of texts (with label 1) that hold them."""

    def __init__(self, keys: np.ndarray, n_texts: np.ndarray, n_label: np.ndarray, n: int, n1: int) -> None:
        self.given = keys, n_texts, n_label, n, n1
        self.keys, self.base = keys, n1 / n if n else 0.0
        likelier = np.log((n_label + PRIOR * self.base) / (n_texts + PRIOR) / self.base) if n1 else np.zeros(len(keys))
        self.weight = (np.log((1 + n) / (1 + n_texts)) + 1) * (FLOOR + np.maximum(0, likelier) ** 2)

    def __reduce__(self) -> tuple:
        keys, n_texts, n_label, n, n1 = self.given
        return _space, (keys.tobytes(), press(n_texts.astype("<u4")), press(n_label.astype("<u4")), n, n1)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, feature, n: each text's features and how often they stand in it."""
        doc, h = features(texts)
        size = len(self.keys)
        at = np.minimum(np.searchsorted(self.keys, h), size - 1) if size else np.zeros(0, np.int64)
        hit = self.keys[at] == h if size else np.zeros(0, bool)
        pair, n = np.unique(doc[: len(hit)][hit] * size + at[hit], return_counts=True)
        owner, feature = pair // max(1, size), pair % max(1, size)
        return np.searchsorted(owner, np.arange(len(texts) + 1)), feature.astype(np.int32), n

    def vectors(self, start: np.ndarray, feature: np.ndarray, n: np.ndarray) -> Vectors:
        weight = (1 + np.log(n)) * self.weight[feature]
        owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
        return Vectors(start, feature, weight / np.sqrt(np.bincount(owner, weight * weight, len(start) - 1))[owner])

    def lists(self, start: np.ndarray, owner: np.ndarray, n: np.ndarray, rows: int) -> Vectors:
        """vectors() transposed, from each feature's rows and how often it stands in them."""
        weight = np.log(n)
        weight += 1
        weight *= np.repeat(self.weight, np.diff(start))
        weight /= np.sqrt(np.bincount(owner, weight * weight, rows))[owner]
        return Vectors(start, owner, weight)


def _space(keys: bytes, n_texts: bytes, n_label: bytes, n: int, n1: int) -> Space:
    return Space(np.frombuffer(keys, np.uint64), unpress(n_texts, "<u4").astype(float), unpress(n_label, "<u4").astype(float), n, n1)


class Index:
    """The examples' posting lists; frequent features (the head) by block, with their largest weight in each.

    lists: `own` transposed, for those who have it.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, own: Vectors | None, size: int, lists: Vectors | None = None) -> None:
        lists = lists or transposed(own, size)
        seen = np.diff(lists.start)
        head = np.argsort(-seen, kind="stable")[:MOST_HEAD]
        head = head[seen[head] * HEAD_PART > len(ids)]
        self.head = np.full(size, -1, np.int32)
        self.head[head] = np.arange(len(head))
        self.n_blocks = -(-len(ids) // BLOCK)
        self.ids, self.labels = ids, labels.astype(float)
        self.dense = np.zeros((self.n_blocks * BLOCK, len(head)))
        for k, f in enumerate(head.tolist()):
            at = slice(lists.start[f], lists.start[f + 1])
            self.dense[lists.feature[at], k] = lists.weight[at]
        self.most = self.dense.reshape(self.n_blocks, BLOCK, len(head)).max(1) if len(ids) else np.zeros((0, len(head)))
        tail = np.repeat(self.head < 0, seen)
        self.start = np.concatenate([[0], np.cumsum(np.where(self.head < 0, seen, 0))])
        self.owner, self.weight = lists.feature[tail].astype(np.int32), lists.weight[tail]

    def sums(self, v: Vectors) -> np.ndarray:
        """What rare features add to the cosines of each row with the examples. Entries are walked SUMMED at a time, in steps that begin
        anew with each row, so that sums don't depend on what rows stand beside it."""
        out = np.zeros((len(v), self.n_blocks * BLOCK))
        for k, (a, b) in enumerate(zip(v.start.tolist(), v.start[1:].tolist())):
            f, w = v.feature[a:b], v.weight[a:b]
            lo = self.start[f]
            many = self.start[f + 1] - lo
            end = np.cumsum(many)
            x = done = 0
            while x < len(f):
                y = max(x + 1, int(np.searchsorted(end, done + SUMMED, "right")))
                m, total = many[x:y], int(end[y - 1]) - done
                at = np.repeat(lo[x:y] - end[x:y] + m + done, m)
                at += np.arange(total)
                part = self.weight.take(at)
                part *= np.repeat(w[x:y], m)
                out[k] += np.bincount(self.owner.take(at), part, out.shape[1])
                x, done = y, done + total
        return out

    def cosines(self, v: Vectors, k: int, without: np.ndarray | None = None) -> np.ndarray:
        """Cosines of each row with the examples: exact where they may be among the k largest, -1 where they can't be."""
        n, width = len(v), self.n_blocks * BLOCK
        owner, place = v.owner(), self.head[v.feature]
        ask = np.zeros((n, self.dense.shape[1]))
        ask[owner[place >= 0], place[place >= 0]] = v.weight[place >= 0]
        sums = self.sums(v)
        bound = sums.reshape(n, self.n_blocks, BLOCK).max(2) + ask @ self.most.T
        out, open_ = np.full((n, width), -1.0), np.zeros((n, self.n_blocks), bool)
        first = min(FIRST_BLOCKS, self.n_blocks)
        np.put_along_axis(open_, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, 1)
        done = open_.copy()
        for turn in range(2):
            for b in np.flatnonzero(open_.any(0)).tolist():
                rows, own = np.flatnonzero(open_[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                out[rows, own] = sums[rows, own] + ask[rows] @ self.dense[own].T
            if without is not None:
                out[np.arange(n), without] = -1
            if turn == 0:
                least = -np.partition(-out, k - 1, axis=1)[:, k - 1] if k <= width else np.full(n, -1.0)
                open_ = (bound >= least[:, None] - 1e-9) & ~done
        return out

    def cuts(self, v: Vectors) -> list[int]:
        """Bounds of runs of rows that are compared at a time: TEXTS rows or POSTINGS entries at most, one row at least."""
        many = np.where(self.head[v.feature] < 0, self.start[v.feature + 1] - self.start[v.feature], 0)
        total = np.concatenate([[0], np.cumsum(many)])[v.start]
        out = [0]
        while out[-1] < len(v):
            a = out[-1]
            b = int(np.searchsorted(total, total[a] + POSTINGS, "right")) - 1
            out.append(max(a + 1, min(a + TEXTS, b, len(v))))
        return out

    def nearest(self, v: Vectors, k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row, examples with the k largest cosines above 0 (ties to the smaller id) and the cosines."""
        out = []
        if not self.n_blocks:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(v)
        cuts = self.cuts(v)
        for a, b in zip(cuts, cuts[1:]):
            some = v.rows(a, b)
            cosine = self.cosines(some, k, None if without is None else without[a:b]).round(12)
            least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1] if k <= cosine.shape[1] else np.full(len(some), -1.0)
            for row, x in zip(cosine, least.tolist()):
                at = np.flatnonzero(row >= max(x, 1e-12))
                at = at[np.lexsort((self.ids[at], -row[at]))[:k]]
                out.append((at, row[at]))
        return out

    def votes(self, v: Vectors, base: float, without: np.ndarray | None = None) -> list[tuple[float, list[int]]]:
        """Share of label 1 among the nearest, and the ids of the first three."""
        return [(float(((near * self.labels[at]).sum() + SHRINK * base) / (near.sum() + SHRINK)), self.ids[at[:3]].tolist()) for at, near in self.nearest(v, NEIGHBOURS, without)]


def alike(x: np.ndarray, groups: int) -> np.ndarray:
    """A group for each row, by a few steps of k-means on directions; it only changes how well blocks are bounded."""
    centre, out = x[np.arange(groups) * len(x) // max(1, groups)], np.zeros(len(x), np.int64)
    for _ in range(4):
        out = (x @ centre.T).argmax(1) if groups else out
        centre = np.stack([x[out == g].sum(0) if (out == g).any() else centre[g] for g in range(groups)]) if groups else centre
        centre = centre / np.maximum(np.sqrt((centre * centre).sum(1, keepdims=True)), 1e-12)
    return out


def isotonic(votes: np.ndarray, labels: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: votes in order, and the rate of label 1 at each."""
    pools: list[list[float]] = []
    for x, y in sorted(zip(votes.tolist(), labels.tolist())):
        pools.append([x, y, 1])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]):
            last = pools.pop()
            pools[-1] = [last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    return np.array([p[0] for p in pools]), np.array([(p[1] + base) / (p[2] + 1) for p in pools])


def forget_encoders() -> None:
    """Workers serve one stage after the other: what an encoder has remembered in this one goes, back to the system, before the index comes."""
    for name in ("bpe", "token_files"):
        if found := sys.modules.get(f"{__package__}.{name}"):
            found._made.clear()
    give_back()


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(HELD_OUT_OF)) == HELD_OUT, F.lit(False))


class Examples:
    """The labelled examples by feature and in an index. A task makes them for itself, so that an idle worker holds only the recipe.

    start, feature, n: each example's features and how often they stand in it; by_feature: each feature's examples instead.
    """

    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, start: np.ndarray, feature: np.ndarray, n: np.ndarray, by_feature: bool = False) -> None:
        self.space, self.size = space, len(ids)
        self.lists = space.lists(start, feature, n, len(ids)) if by_feature else transposed(space.vectors(start, feature, n), len(space.keys))
        self.index = Index(ids, labels, None, len(space.keys), self.lists)

    def rows(self, a: int, b: int) -> Vectors:
        """The vectors of the examples a..b-1."""
        at = np.flatnonzero((self.lists.feature >= a) & (self.lists.feature < b))
        row = self.lists.feature[at] - a
        at = at[np.argsort(row, kind="stable")]
        feature = (np.searchsorted(self.lists.start, at, "right") - 1).astype(np.int32)
        return Vectors(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]), feature, self.lists.weight[at])

    @property
    def own(self) -> Vectors:
        return self.rows(0, self.size)

    def scoring(self) -> Examples:
        """Without the vectors themselves, which only leave-one-out votes ask for."""
        del self.lists
        return self


class Recipe:
    """What the driver has of the examples, and sends: the counts of their features.

    The examples come in an order that puts those that resemble each other into one block.
    """

    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, start: np.ndarray, feature: np.ndarray, n: np.ndarray) -> None:
        seen = counted(feature, len(space.keys))
        head = np.argsort(-seen, kind="stable")[:MOST_HEAD]
        place = np.full(len(seen), -1, np.int32)
        place[head] = np.arange(len(head))
        dense = np.zeros((len(ids), len(head)), np.float32)
        for a in range(0, len(ids), TEXTS):
            own = start[a : a + TEXTS + 1]
            v = space.vectors(own - own[0], feature[own[0] : own[-1]], n[own[0] : own[-1]])
            at, row = place[v.feature], v.owner()
            dense[a + row[at >= 0], at[at >= 0]] = v.weight[at >= 0]
        order = np.lexsort((ids, alike(dense, -(-len(ids) // (4 * BLOCK)))))
        name = np.empty(len(ids), np.int64)
        name[order] = np.arange(len(ids))
        self.labels = labels[order]
        lists = transposed(Vectors(start, feature, n), len(space.keys), name)
        self.given = space, ids[order], self.labels, press(np.diff(lists.start).astype("<u4")), lists.feature.dtype, press(lists.feature), press(lists.weight)

    def examples(self) -> Examples:
        space, ids, labels, sizes, kind, owner, n = self.given
        return Examples(space, ids, labels, np.concatenate([[0], np.cumsum(unpress(sizes, "<u4"), dtype=np.int64)]), unpress(owner, kind), unpress(n, "<u4"), by_feature=True)


def flat(pressed: list[bytes], kind: np.dtype) -> np.ndarray:
    """All of their values, one array after the other, without having them twice."""
    out, at = np.zeros(sum(len(unpress(x, kind)) for x in pressed), kind), 0
    for x in pressed:
        own = unpress(x, kind)
        out[at : at + len(own)], at = own, at + len(own)
    return out


@dataclass
class Model:
    #: A broadcast Recipe; None without labels of both kinds.
    sent: Broadcast | None
    empty_rate: float
    at: np.ndarray
    rates: np.ndarray

    def examples(self) -> Examples | None:
        return self.sent and self.sent.value.examples().scoring()

    def score(self, examples: Examples | None, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        if examples is None:
            return [(self.empty_rate, [])] * len(texts)
        v = examples.space.vectors(*examples.space.counts(texts))
        some = (np.diff(v.start) > 0).tolist()
        return [(float(np.interp(vote, self.at, self.rates)), evidence) if known else (self.empty_rate, []) for known, (vote, evidence) in zip(some, examples.index.votes(v, examples.space.base))]


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Model:
    """Only the sample's features, their counts and votes reach the driver."""
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~held_out("id"))
    chosen = own.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id"), "labelled")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in parts:
            for s in steps(some, "text", STEP):
                doc, h = features([string(t) for t in s.text])
                once = np.unique(mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]  # a feature counts once a text
                label = s.label.to_numpy(np.int64)[doc[once]]
                keys, inverse = np.unique(h[once], return_inverse=True)
                yield pd.DataFrame({"key": keys.view(np.int64), "n1": np.bincount(inverse, label, len(keys)).astype(np.int64), "n": np.bincount(inverse, minlength=len(keys))})

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in parts:
            yield pd.DataFrame({c: [some[c].to_numpy(np.int64).tobytes()] for c in ("key", "n1", "n")})

    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n1")).first()
    n, n1 = sizes.n, sizes.n1
    if not n1 or n1 == n:
        return Model(None, n1 / n if n else 0.0, np.zeros(0), np.zeros(0))
    found = rows.mapInPandas(count, "key long, n1 long, n long").groupBy("key").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    found = found.mapInPandas(packed, "key binary, n1 binary, n binary").collect()
    keys, in_label, in_all = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[c], np.int64) for r in found)]) for c in ("key", "n1", "n"))
    order = np.argsort(keys.view(np.uint64))
    space = Space(keys.view(np.uint64)[order], in_all[order].astype(float), in_label[order].astype(float), n, n1)
    known = spark.sparkContext.broadcast(space)

    def counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in parts:
            for s in steps(some, "text", STEP):
                start, feature, n = known.value.counts([string(t) for t in s.text])
                each = [(press(feature[a:b]), press(n[a:b].astype("<u4"))) for a, b in zip(start, start[1:])]
                yield pd.DataFrame({"id": s["id"].to_numpy(), "label": s.label.to_numpy(), "feature": [f for f, _ in each], "n": [c for _, c in each]})

    all_ = sorted(rows.mapInPandas(counts, "id long, label int, feature binary, n binary").collect(), key=lambda r: (r.id, r.label, r.feature, r.n))
    known.destroy()
    none, full = [r.label for r in all_ if not r.feature], [r for r in all_ if r.feature]
    ids, own = np.array([r.id for r in full], np.int64), np.array([r.label for r in full], np.int64)
    feature, n_each = (flat([r[c] for r in full], kind) for c, kind in (("feature", np.int32), ("n", np.dtype("<u4"))))
    start = np.cumsum([0, *(len(unpress(r.n, "<u4")) for r in full)])
    del all_, full, found, known
    recipe = Recipe(space, ids, own, start, feature, n_each)
    del feature, n_each
    give_back()
    sent = spark.sparkContext.broadcast(recipe)
    at, rates = isotonic(leave_one_out(spark, sent, len(ids)), recipe.labels, space.base)
    return Model(sent, float((sum(none) + space.base) / (len(none) + 1)), at, rates)


def leave_one_out(spark: SparkSession, sent: Broadcast, n: int) -> np.ndarray:
    """Each example's vote by the others, in tasks of a few hundred."""
    step = 16 * TEXTS

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_encoders()
        e = sent.value.examples()
        for rows in parts:
            for a in rows["id"].tolist():
                at = np.arange(a, min(a + step, n))
                yield pd.DataFrame({"id": at, "vote": [x for x, _ in e.index.votes(e.rows(a, a + len(at)), e.space.base, at)]})

    out = np.zeros(n)
    for r in spark.range(0, n, step, max(1, -(-n // step))).mapInPandas(run, "id long, vote double").collect():
        out[r.id] = r.vote
    return out


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, keep_text: bool = False) -> DataFrame:
    """id, held_out, score (probability of label 1), predicted (score >= CUT), evidence (ids of the nearest examples)."""
    ready(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, label_col, sample)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_encoders()
        examples = model.examples()
        for rows in parts:
            for some in steps(rows, "text", STEP):
                said = model.score(examples, [string(t) for t in some.text])
                yield pd.DataFrame({"id": some["id"].to_numpy(), "held_out": some.held_out.to_numpy(), "text": some.text.to_numpy() if keep_text else None, "score": [s for s, _ in said], "evidence": [e for _, e in said]})
            del rows, some  # before the next batch comes

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, held_out boolean, text string, score double, evidence array<long>")
    return out.select(F.col("id").alias(id_col), *([F.col("text").alias(text_col)] if keep_text else []), "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
