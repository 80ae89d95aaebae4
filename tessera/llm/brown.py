"""LM scoring (op6): Brown class bigrams.

The probability of a word is that of its class after the class before, times that of the word in its class. Exchange clustering gives
every word that occurs at least twice in the training texts one of CLASSES classes: a word moves to the class that raises the likelihood of
the training text's class bigrams most. Frequent words (at least 1 / CORE of the tokens, so CORE of them at most) are clustered first,
while the others wait in a class of their own; then, in TURNS turns, all words move, the waiting ones at once and the others half of them
in a turn. Moves of one turn are judged on the same counts; the state with the highest likelihood is the result. Transitions are smoothed
with the classes' own frequencies; words that occur once share a class with one unknown word, which gets UNKNOWN of it. A text's words
are followed by one end token, which is also what stands before its first word.

Texts become numbers once: a row for each block of documents holds its distinct words' hashes and the words as places in that list.
Counts and moves come by request: each block asks about each of its words once, wherever and however often it stands, and tells what
classes stand beside it. What is gathered (words, their counts, their neighbours' classes) grows with the input and stays distributed;
the driver has the classes' bigrams and the frequent words. Answers are kept in the shared folder by the task that made the blocks, so the
texts are never shuffled.

Words are told apart by 64-bit hashes.

Defined results: a null text counts as empty (the end token alone); rows with a null id are trained on; repeated rows each count; without
training rows all words are unknown; an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import NO_ID, ids_of
from .common import DEALT, Words, bucket_count, deal_rows, drop_folder, gathered, new_folder, press, press_sorted, ready, spread, stage, starts_of, steps, string, table, unpress, unpress_sorted

CORE, CLASSES, ROUNDS, TURNS, SMOOTH, UNKNOWN = 20_000, 64, 8, 3, 20.0, 0.5
#: Classes besides: words seen once or never, and words that wait for their class.
ONCE, WAITING = CLASSES, CLASSES + 1
ALL_CLASSES = CLASSES + 2
#: What may stand beside a word: a class behind it, or (from ALL_CLASSES on) a class before it.
BESIDE = 2 * ALL_CLASSES
FAN_IN = 64
#: Neighbour counts that are weighed against all classes at a time.
WEIGHED = 20_000
HELD_OUT_OF, HELD_OUT = 7, 2
END = np.uint64(0xE0D0E0D0E0D0E0D1)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT_OF == HELD_OUT


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A staged row for each block: doc_ids, sizes (tokens by document), tokens (places in keys), keys, counts in training documents."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for rows in parts:
            for some in steps(rows, "text"):
                w = Words([string(t) for t in some.text], lower=True)
                tokens = np.insert(w.hash, w.start[1:], END)
                sizes = np.diff(w.start) + 1
                ids = ids_of(some.doc_id)
                held = np.array([is_held_out(None if i == NO_ID else i) for i in ids.tolist()], bool)
                keys, inverse = np.unique(tokens, return_inverse=True)
                counts = np.bincount(inverse[~np.repeat(held, sizes)], minlength=len(keys)).astype("<u4")
                yield pd.DataFrame({
                    "block": [block], "n_train": [int(sizes[~held].sum())], "n_keys": [len(keys)], "doc_ids": [ids.tobytes()], "held": [held.tobytes()], "sizes": [sizes.astype("<u4").tobytes()],
                    "tokens": [press(inverse.astype("<u4"))], "keys": [press_sorted(keys)], "vals": [press(counts)],
                })
                block += 1

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage(own.mapInPandas(run, "block long, n_train long, n_keys long, doc_ids binary, held binary, sizes binary, tokens binary, keys binary, vals binary"), "numbered", blobs=True)


ANSWERS = "task long, block long, part long, data binary"


def kept_by_task(answers: DataFrame, name: str) -> str:
    """Write rows with a task column into a folder for each task."""
    path = new_folder(answers.sparkSession, name)
    answers.repartition("task").write.options(compression="uncompressed").partitionBy("task").parquet(path)
    return path


class Answers:
    """What kept_by_task() wrote, for the blocks of one task at a time."""

    def __init__(self, path: str) -> None:
        self.fs, self.where = pafs.FileSystem.from_uri(path)
        self.task, self.found = -1, {}

    def of(self, block: int, kind: str) -> np.ndarray:
        """One block's answers, in the order of its keys."""
        if block >> 32 != self.task:
            self.task, self.found = block >> 32, {}
            folder = f"{self.where}/task={self.task}"
            if self.fs.get_file_info(folder).type != pafs.FileType.NotFound:
                rows = pads.dataset(folder, filesystem=self.fs, format="parquet").to_table(columns=["block", "part", "data"]).to_pydict()
                for b, p, d in sorted(zip(rows["block"], rows["part"], rows["data"])):
                    self.found.setdefault(b, []).append(d)
        return np.concatenate([np.zeros(0, kind), *(unpress(d, kind) for d in self.found.get(block, ()))])


def counted(blocks: DataFrame, n_train: int) -> str:
    """Answers to each block: the counts of its keys. Task -1 has a row for each part: v (words), once, and the frequent words."""
    buckets = bucket_count(7 * int(blocks.agg(F.sum("n_keys")).first()[0] or 0))
    least = max(2, -(-n_train // CORE))

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for block, keys, vals in zip(rows.block, rows["keys"], rows.vals):
                yield deal_rows(block, unpress_sorted(keys), unpress(vals, "<u4"), buckets)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        keys, vals, order, cuts = gathered(rows, "<u4")
        at = starts_of(keys)
        total = np.add.reduceat(vals.astype(np.int64), at)
        back = np.empty(len(keys), "<i8")
        back[order] = spread(total, at, len(keys))
        part = int(rows.part.iloc[0])
        core = total >= least
        block = rows.block.to_numpy()
        out = pd.DataFrame({"task": block >> 32, "block": block, "part": part, "data": [press(back[a:b]) for a, b in zip(cuts, cuts[1:])]})
        own = pd.DataFrame({"task": [-1], "block": [-1], "part": [part], "v": [int((total > 0).sum())], "once": [int((total == 1).sum())], "core_keys": [keys[at][core].tobytes()], "core_counts": [total[core].tobytes()]})
        return pd.concat([out.assign(v=None, once=None, core_keys=None, core_counts=None), own.assign(data=None)])

    dealt = blocks.select("block", "keys", "vals").mapInPandas(deal, DEALT)
    return kept_by_task(dealt.groupBy("part").applyInPandas(meet, ANSWERS + ", v long, once long, core_keys binary, core_counts binary"), "counts")


class Counts:
    """Totals of the training tokens: n, v, words seen once, and the frequent words (sorted keys, counts)."""

    def __init__(self, n: int, rows: list) -> None:
        self.n, self.v, self.once = n, sum(r.v for r in rows), sum(r.once for r in rows)
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.core_keys, np.uint64) for r in rows)])
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.core_counts, np.int64) for r in rows)])
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def symbols(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Frequent words by their place; behind them those seen once or never, then all others."""
        out = len(self.keys) + (counts > 1)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, at, out)
        return out


def before(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The symbol before each: an end token stands before a document."""
    out = np.empty_like(symbols)
    out[1:] = symbols[:-1]
    out[:1] = symbols[-1:]
    out[np.cumsum(sizes) - sizes] = symbols[np.cumsum(sizes) - 1]
    return out


class Tokens:
    """One block's documents as places in its keys."""

    def __init__(self, row: object) -> None:
        self.block = int(row.block)
        self.keys, self.places = unpress_sorted(row.keys), unpress(row.tokens, "<u4")
        self.sizes, self.held = np.frombuffer(row.sizes, "<u4").astype(np.int64), np.frombuffer(row.held, bool)

    def pairs(self, of_key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the training tokens: places, what of_key gives them, and the tokens before them."""
        own = ~np.repeat(self.held, self.sizes)
        x = of_key[self.places]
        return self.places[own], x[own], before(x, self.sizes)[own]


TEXT = ["block", "held", "sizes", "tokens", "keys"]


def symbol_pairs(blocks: DataFrame, counts: str, c: Counts) -> DataFrame:
    """Staged rows with pairs (symbol * n_symbols + next symbol) of the training documents and their counts; a pair stands in one row.

    There are n_symbols ** 2 pairs at most. Each task adds up its blocks, and the tasks' counts are combined FAN_IN at a time.
    """
    n_symbols = len(c.keys) + 2
    parts_ = 1 + min(c.n, n_symbols**2) // 2_000_000
    sent = blocks.sparkSession.sparkContext.broadcast(c)

    def added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        pair, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
        return pair, np.bincount(inverse, np.concatenate(counts), len(pair)).astype("<i8")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pair, n, task, known = np.zeros(0, np.int64), np.zeros(0, np.int64), TaskContext.get().partitionId(), Answers(counts)
        for rows in parts:
            for row in rows.itertuples(index=False):
                t = Tokens(row)
                _, s, last = t.pairs(sent.value.symbols(t.keys, known.of(t.block, "<i8")).astype(np.int64))
                new = np.unique(last * n_symbols + s, return_counts=True)
                pair, n = added([pair, new[0]], [n, new[1]])
        for p in range(parts_):
            if (own := pair % parts_ == p).any():
                yield pd.DataFrame({"part": [p], "task": [task], "pairs": [press_sorted(pair[own].astype(np.uint64))], "n": [press(n[own])]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        pair, n = added([unpress_sorted(x) for x in rows["pairs"]], [unpress(x, "<i8") for x in rows.n])
        return pd.DataFrame({"part": [rows.part.iloc[0]], "task": [rows.task.iloc[0] // FAN_IN], "pairs": [press_sorted(pair)], "n": [press(n)]})

    kind = "part long, task long, pairs binary, n binary"
    out = stage(blocks.select(*TEXT).mapInPandas(count, kind), "task-pairs", blobs=True)
    tasks = 1 + int(out.agg(F.max("task")).first()[0] or 0)
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        out = out.groupBy("part", F.floor(F.col("task") / FAN_IN).alias("group")).applyInPandas(add, kind)
    return stage(out.select("pairs", "n"), "pairs", blobs=True)


def contexts(pairs: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each symbol stands before, and behind, each class: a bounded number of cells, summed by slices of symbols."""
    spark, size = pairs.sparkSession, len(classes)
    sent, step = spark.sparkContext.broadcast(classes), 512

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = np.zeros((size, n_classes)), np.zeros((size, n_classes))
        for rows in parts:
            for p, n in zip(rows["pairs"], rows.n):
                p, n = unpress_sorted(p).astype(np.int64), unpress(n, "<i8").astype(float)
                a, b = p // size, p % size
                right += np.bincount(a * n_classes + sent.value[b], n, size * n_classes).reshape(size, -1)
                left += np.bincount(b * n_classes + sent.value[a], n, size * n_classes).reshape(size, -1)
        for k in range(0, size, step):
            both = np.stack([left[k : k + step], right[k : k + step]])
            if both.any():
                yield pd.DataFrame({"at": [k], "cells": [press(both.reshape(-1))]})

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [rows["at"].iloc[0]], "cells": [press(sum(unpress(c, "<f8") for c in rows.cells))]})

    out = np.zeros((2, size, n_classes))
    for r in pairs.mapInPandas(add, "at int, cells binary").groupBy("at").applyInPandas(total, "at int, cells binary").collect():
        cells = unpress(bytes(r.cells), "<f8").reshape(2, -1, n_classes)
        out[:, r["at"] : r["at"] + cells.shape[1]] = cells
    return out[0], out[1]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-9))


def class_matrix(right: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    out = np.zeros((n_classes, n_classes))
    np.add.at(out, classes, right)
    return out


def likelihood(m: np.ndarray) -> float:
    return float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum())


def exchanged(classes: np.ndarray, n_core: int, left: np.ndarray, right: np.ndarray, m: np.ndarray, turn: int) -> np.ndarray:
    """Each core word (half of them in a turn) in the class that raises the likelihood most, others staying."""
    new, rows, columns = classes.copy(), m.sum(1), m.sum(0)
    for w in range(n_core):
        if (w * 2654435761 >> 7) % 2 != turn % 2:
            continue
        a, r, c = classes[w], right[w], left[w]
        n = r.sum()
        without = m.copy()
        without[a] -= r
        without[:, a] -= c
        without = np.maximum(without, 0)
        row, column = rows.copy(), columns.copy()
        row[a] -= n
        column[a] -= n
        gain = (_xlogx(without[:CLASSES] + r) - _xlogx(without[:CLASSES])).sum(1) + (_xlogx(without[:, :CLASSES].T + c) - _xlogx(without[:, :CLASSES].T)).sum(1)
        gain -= _xlogx(np.maximum(row[:CLASSES], 0) + n) - _xlogx(np.maximum(row[:CLASSES], 0)) + _xlogx(np.maximum(column[:CLASSES], 0) + n) - _xlogx(np.maximum(column[:CLASSES], 0))
        new[w] = int(np.argmax(gain + 1e-9 * (np.arange(CLASSES) == a)))
    return new


def clustered(pairs: DataFrame, c: Counts) -> np.ndarray:
    """The classes of the frequent words, while the others wait."""
    n_core = len(c.keys)
    order = np.argsort(-c.counts, kind="stable")
    classes = np.concatenate([np.zeros(n_core, np.int64), [ONCE, WAITING]])
    classes[order] = np.arange(n_core) % CLASSES
    best, kept = -np.inf, classes
    for turn in range(ROUNDS + 1):
        left, right = contexts(pairs, classes, ALL_CLASSES)
        m = class_matrix(right, classes, ALL_CLASSES)
        if likelihood(m) > best:
            best, kept = likelihood(m), classes
        if turn < ROUNDS:
            classes = exchanged(classes, n_core, left, right, m, turn)
            if turn and (classes == kept).all():
                break
    return kept[:n_core]


class Classes:
    """Classes of a block's keys: those of the last moves, before them those of the frequent words."""

    def __init__(self, c: Counts, core: np.ndarray, counts: str, moved: str | None) -> None:
        self.c, self.core, self.counts, self.moved = c, np.concatenate([core, [ONCE, WAITING]]), Answers(counts), moved and Answers(moved)

    def of(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(classes, counts)"""
        counts = self.counts.of(t.block, "<i8")
        out = self.core[self.c.symbols(t.keys, counts)]
        if self.moved:
            out[counts > 1] = self.moved.of(t.block, "u1")
        return out, counts


def moving(keys: np.ndarray, classes: np.ndarray, turn: int) -> np.ndarray:
    """Of words that occur at least twice: which ones move in a turn."""
    return (classes == WAITING) | ((keys >> np.uint64(5)) % np.uint64(2) == turn % 2)


def beside(blocks: DataFrame, known: tuple, moved: str | None, turn: int, buckets: int) -> DataFrame:
    """Staged rows for the blocks and parts: keys that occur at least twice, their classes, and for those that move what stands beside
    them (key * BESIDE + class, in order) and how often. Rows of part -1 have the classes' bigrams in m."""
    sent = blocks.sparkSession.sparkContext.broadcast(known)
    shift = np.uint64(64 - int(np.log2(buckets)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = Classes(*sent.value, moved)
        for rows in parts:
            for row in rows.itertuples(index=False):
                t = Tokens(row)
                own, counts = classes.of(t)
                places, x, last = t.pairs(own)
                m = np.bincount(last * ALL_CLASSES + x, minlength=ALL_CLASSES**2)
                none = dict.fromkeys(("m", "keys", "classes", "cells", "n"))
                out = [none | {"part": -1, "block": t.block, "m": m}]
                if turn < TURNS and (counts > 1).any():
                    number = np.cumsum(counts > 1) - 1
                    keys, of = t.keys[counts > 1], own[counts > 1]
                    goes = np.zeros(len(own), bool)
                    goes[counts > 1] = moving(keys, of, turn)
                    # the token before each, as a place: what stands behind it is the token's own class
                    first = before(t.places.astype(np.int64), t.sizes)[~np.repeat(t.held, t.sizes)]
                    codes = np.concatenate([number[first[goes[first]]] * BESIDE + x[goes[first]], number[places[goes[places]]] * BESIDE + ALL_CLASSES + last[goes[places]]])
                    cells, n = np.unique(codes, return_counts=True)
                    top = keys >> shift
                    cuts = [0, *(np.flatnonzero(np.diff(top)) + 1).tolist(), len(keys)]
                    for a, b in zip(cuts, cuts[1:]):
                        lo, hi = np.searchsorted(cells, [a * BESIDE, b * BESIDE])
                        out.append(none | {"part": int(top[a]), "block": t.block, "keys": press_sorted(keys[a:b]), "classes": press(of[a:b].astype("u1")), "cells": press_sorted((cells[lo:hi] - a * BESIDE).astype(np.uint64)), "n": press(n[lo:hi].astype("<u4"))})
                yield pd.DataFrame(out, columns=["part", "block", "m", "keys", "classes", "cells", "n"])

    return stage(blocks.select(*TEXT).mapInPandas(run, "part long, block long, m array<long>, keys binary, classes binary, cells binary, n binary"), "beside", blobs=True)


def weighed(word: np.ndarray, cell: np.ndarray, n: np.ndarray, own: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The class that raises the likelihood most for each word; (word, cell) in order, each word has some. own: the words' classes."""
    sums = np.zeros((len(own), BESIDE))
    sums[word, cell] = n
    at = np.concatenate([m.T[:, :CLASSES], m[:, :CLASSES]])[cell]
    side, class_ = cell // ALL_CLASSES, cell % ALL_CLASSES
    inside = np.flatnonzero(class_ == own[word])  # the class beside it is its own, which it leaves
    other = sums.reshape(len(own), 2, ALL_CLASSES)[word[inside], 1 - side[inside], :CLASSES]
    at[inside] -= other
    settled = np.flatnonzero(own[word] < CLASSES)
    at[settled, own[word[settled]]] -= n[settled]
    at = np.maximum(at, 0)
    gain = np.add.reduceat(_xlogx(at + n[:, None]) - _xlogx(at), starts_of(word), axis=0)
    stays = np.arange(CLASSES) == own[:, None]
    for total, k in ((m.sum(1)[:CLASSES], 0), (m.sum(0)[:CLASSES], 1)):
        size = sums[:, k * ALL_CLASSES : (k + 1) * ALL_CLASSES].sum(1)[:, None]
        rest = np.maximum(total - stays * size, 0)
        gain -= _xlogx(rest + size) - _xlogx(rest)
    return (gain + 1e-9 * stays).argmax(1)


def moves(rows: DataFrame, m: np.ndarray, turn: int) -> str:
    """Answers to each block: the new classes of its keys that occur at least twice."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpress_sorted(k) for k in rows["keys"]]
        cuts = np.cumsum([0, *map(len, keys)])
        words, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        own = np.zeros(len(words), np.int64)
        own[inverse] = np.concatenate([unpress(c, "u1") for c in rows["classes"]])
        codes, counts = [], [unpress(n, "<u4") for n in rows.n]
        for a, cells in zip(cuts.tolist(), rows.cells):
            x = unpress_sorted(cells).astype(np.int64)
            codes.append(inverse[a + x // BESIDE] * BESIDE + x % BESIDE)
        code, back = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(back, np.concatenate(counts), len(code))
        word = code // BESIDE
        k = 0
        while k < len(code):
            end = min(k + WEIGHED, len(code))
            if end < len(code):  # up to the last whole word, or to the end of a word that is too long
                first = np.searchsorted(word, word[end], "left")
                end = int(first) if first > k else int(np.searchsorted(word, word[end], "right"))
            of, local = np.unique(word[k:end], return_inverse=True)
            own[of] = weighed(local, code[k:end] % BESIDE, n[k:end], own[of], m)
            k = end
        new, block = own[inverse].astype("u1"), rows.block.to_numpy()
        return pd.DataFrame({"task": block >> 32, "block": block, "part": rows.part.to_numpy(), "data": [press(new[a:b]) for a, b in zip(cuts, cuts[1:])]})

    own = rows.where("part >= 0").select("part", "block", "keys", "classes", "cells", "n")
    return kept_by_task(own.groupBy("part").applyInPandas(meet, ANSWERS), f"moves-{turn}")


def settled(blocks: DataFrame, known: tuple, n_keys: int) -> tuple[str | None, np.ndarray]:
    """Where the answers with the classes of all words are, and the classes' bigrams."""
    best, kept, moved = -np.inf, (None, np.zeros((ALL_CLASSES, ALL_CLASSES))), None
    spark, buckets = blocks.sparkSession, bucket_count(7 * n_keys, 8 << 20)
    for turn in range(TURNS + 1):
        rows = beside(blocks, known, moved, turn, buckets)
        m = np.zeros(ALL_CLASSES**2)
        for r in rows.where("part < 0").select(F.posexplode("m").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
            m[r["at"]] = r.n
        m = m.reshape(ALL_CLASSES, ALL_CLASSES)
        if turn == 0 or not m[WAITING].any() and likelihood(m) > best:
            best, kept = -np.inf if m[WAITING].any() else likelihood(m), (moved, m)
        if turn < TURNS:
            moved = moves(rows, m, turn)
        drop_folder(spark, rows.staged_path)
    return kept


@dataclass
class Model:
    """Totals, the frequent words' classes, where the counts and the others' classes are, and the classes' bigrams."""

    c: Counts
    core: np.ndarray
    counts: str
    moved: str | None
    m: np.ndarray

    def transitions(self) -> np.ndarray:
        """Probability of each class after each; 0 for classes without words (but ONCE has the unknown word)."""
        m = self.m[:WAITING, :WAITING]
        prior = np.where((m.sum(0) > 0) | (np.arange(WAITING) == ONCE), m.sum(0) + 1, 0)
        return (m + SMOOTH * prior / prior.sum()) / (m.sum(1, keepdims=True) + SMOOTH)

    def emissions(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of a word in its class."""
        unknown = UNKNOWN if self.c.once else 1.0
        return np.where(counts > 1, counts / np.maximum(self.m.sum(0), 1)[classes], np.where(counts > 0, (1 - UNKNOWN) / max(1, self.c.once), unknown))


def fit(blocks: DataFrame) -> Model:
    spark = blocks.sparkSession
    size = blocks.agg(F.sum("n_train").alias("n"), F.sum("n_keys").alias("keys")).first()
    counts = counted(blocks, size.n or 0)
    told = spark.read.schema("block long, part long, data binary, v long, once long, core_keys binary, core_counts binary, task long").parquet(counts)
    c = Counts(size.n or 0, told.where("task = -1").select("v", "once", "core_keys", "core_counts").collect())
    core = clustered(symbol_pairs(blocks, counts, c), c)
    return Model(c, core, counts, *settled(blocks, (c, core, counts), size["keys"] or 0))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = ready(docs.sparkSession)
    blocks = numbered(docs, id_col, text_col)
    sent = spark.sparkContext.broadcast(fit(blocks))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        classes, c, moves = Classes(model.c, model.core, model.counts, model.moved), model.c, np.log10(np.maximum(model.transitions(), 1e-300))
        for rows in parts:
            for row in rows.itertuples(index=False):
                t = Tokens(row)
                of, found = classes.of(t)
                x, at = of[t.places], np.cumsum(t.sizes) - t.sizes
                each = moves[before(x, t.sizes), x] + np.log10(model.emissions(of, found))[t.places]
                base, score = (np.add.reduceat(y, at) for y in (np.log10((found + 1) / (c.n + c.v + 1))[t.places], each))
                ids = np.frombuffer(row.doc_ids, np.int64)
                yield pd.DataFrame({
                    "doc_id": pd.Series([None if i == NO_ID else i for i in ids.tolist()], dtype=object), "held_out": t.held, "n_tokens": t.sizes, "n_known": np.add.reduceat((found > 0).astype(np.int64)[t.places], at),
                    "train_tokens": c.n, "base_score": base, "score": score, "perplexity": 10 ** (-score / t.sizes),
                })

    return blocks.select(*TEXT, "doc_ids").mapInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double").withColumnRenamed("doc_id", id_col)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
