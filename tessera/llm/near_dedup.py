"""MinHash near-dedup (op1): multi-index Hamming join of b-bit signatures.

Each distinct set of word shingles gets SYMBOLS minimum hashes of 16 bits each. Two sets with a Jaccard similarity of 0.85 differ in
9.75 of 65 symbols on average (deviation 2.9); pairs that differ in up to 24 symbols (MARGIN deviations more) are candidates, so a pair
at the bound is missed about once in half a million. The symbols are split into CHUNKS; by the pigeonhole principle a pair with at most E
differing symbols has a chunk with at most its allowed errors, because the allowances add up to E - CHUNKS + 1. Each allowed choice of
left-out symbols gives a key, and equal keys meet, which finds every pair under the bound. Full sets then confirm each link.

Large groups make no pairs: equal sets are one class first; then each class is compared with the nearest pivot (smallest class) of its
keys. Only keys whose classes are still in several components go on. Their classes form families (chains of candidates); a family is
compared in full, block against block by matrix products, giving a spanning forest; candidates of different families are confirmed
pair by pair.

Defined results: a null or empty text (or one without words) has an empty set, linked with nothing; a text with fewer words than a
shingle has its whole word sequence as its one shingle; repeated rows each give a row; rows with a null id are returned, linked with
nothing; an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, ready, stage, steps, string, table
from .components import components

SYMBOLS, CHUNKS, MARGIN = 65, 13, 4.8
WIDTH = SYMBOLS // CHUNKS
#: Members of a pivot that one task compares with it.
MEMBERS = 256
#: Members of a family, and their shingles, in one block (about); two blocks are compared in one task.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
_LANES = -(-SYMBOLS // 4)
_SEEDS = np.random.Generator(np.random.PCG64(4)).integers(1, 1 << 63, (2, SYMBOLS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def errors_of(percent: int) -> int:
    """Differing symbols up to which pairs are candidates for a similarity of percent / 100."""
    q = 1 - percent / 100
    return min(SYMBOLS - 1, math.ceil(SYMBOLS * q + MARGIN * math.sqrt(SYMBOLS * q * (1 - q))))


def chunk_keys(errors: int) -> list[tuple[int, tuple[int, ...]]]:
    """(chunk, symbols that a key keeps) for each key of a signature."""
    spare = max(0, errors - CHUNKS + 1)
    out = []
    for c in range(CHUNKS):
        allowed = spare // CHUNKS + (c < spare % CHUNKS)
        own = range(c * WIDTH, (c + 1) * WIDTH)
        out += [(c, tuple(s for s in own if s not in left)) for left in combinations(own, allowed)]
    return out


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    w = Words(texts, lower=True)
    at = w.within(words)
    runs = w.runs(words)
    first = np.searchsorted(at, w.start)
    hashes = runs[at]
    out = []
    for k, (a, b) in enumerate(zip(first, first[1:])):
        lo, hi = w.start[k], w.start[k + 1]
        if b > a:
            out.append(np.unique(hashes[a:b]))
        elif hi > lo:
            out.append(mix(np.array([np.bitwise_xor.reduce(mix(w.hash[lo:hi] + np.arange(1, hi - lo + 1, dtype=np.uint64))) + np.uint64(hi - lo)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit symbols for each set; empty sets get zeros."""
    out = np.zeros((len(sets), _LANES * 4), np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[k] for k in full])
    at = np.cumsum([0, *(len(sets[k]) for k in full)])[:-1]
    for s in range(SYMBOLS):
        least = np.minimum.reduceat((flat ^ _SEEDS[0, s]) * _SEEDS[1, s], at)
        out[full, s] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def differing(a: Column, b: Column) -> Column:
    """Symbols in which two packed signatures differ: 16-bit lanes folded to their lowest bit and counted."""

    def lanes(x: Column) -> Column:
        folded = x
        for shift in range(1, 16):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(folded.bitwiseAND(F.lit(0x0001000100010001)))

    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + lanes(x))


def signed(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits that stand for the set), sig (packed symbols)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for some in steps(rows, "text", 1 << 20):
                sets = shingle_sets([string(t) for t in some.text], words)
                sig = signatures(sets).view(np.int64)
                yield pd.DataFrame({
                    "doc_id": some.doc_id.to_numpy(), "n_shingles": [len(s) for s in sets],
                    "set_a": np.array([int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64),
                    "set_b": np.array([int(mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64),
                    "sig": [x if len(s) else None for x, s in zip(sig, sets)],
                })

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n_shingles long, set_a long, set_b long, sig array<long>")


def keyed(classes: DataFrame, errors: int) -> DataFrame:
    """key, rep: a row for each key of each class."""
    plan = chunk_keys(errors)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mults = np.random.Generator(np.random.PCG64(9)).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for rows in parts:
            for k in range(0, len(rows), 4096):
                some = rows.iloc[k : k + 4096]
                sym = np.stack(some.sig.to_numpy()).astype(np.int64).view(np.uint16)[:, :SYMBOLS].astype(np.uint64)
                part = mix((sym + np.uint64(1)) * mults)
                keys = np.stack([mix(part[:, list(kept)].sum(1, dtype=np.uint64) + np.uint64(c)) for c, kept in plan])
                yield pd.DataFrame({"key": keys.reshape(-1).view(np.int64), "rep": np.tile(some.rep.to_numpy(np.int64), len(plan))})

    return classes.select("rep", "sig").mapInPandas(run, "key long, rep long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (pivot, rep), those whose full sets have 100 * intersection >= percent * union. Each text travels once for each pivot
    it is compared with; a pivot with very many members is copied to several tasks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rep")
        sets = shingle_sets(list(rows.text), words)
        reps, pivot = rows.rep.to_numpy(), rows["pivot"].iloc[0]
        own = sets[int(np.flatnonzero(reps == pivot)[0])]
        linked = []
        for rep, s in zip(reps.tolist(), sets):
            if rep != pivot:
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(s) - both):
                    linked.append((pivot, rep))
        return pd.DataFrame(linked, columns=["a", "b"], dtype="int64")

    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("tasks"))
    dealt = pairs.join(sizes, "pivot").select("pivot", "rep", F.pmod(F.xxhash64("rep"), F.col("tasks")).cast("int").alias("task"))
    own = sizes.select("pivot", F.col("pivot").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    return dealt.union(own).join(texts, "rep").groupBy("pivot", "task").applyInPandas(run, "a long, b long")


def linked_in_blocks(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links that connect what is linked within each family (family, rep, n_shingles): all sets of two blocks of members are compared at once by a
    matrix product, and only a spanning forest is returned."""
    sizes = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = members.drop("n_shingles").join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "rep")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        reps, sets = rows.rep.to_numpy(), shingle_sets(list(rows.text), words)
        n, size = len(sets), np.array([len(s) for s in sets], float)
        keys, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[inverse]
        row = np.repeat(np.arange(n), [len(s) for s in sets])
        row, column = row[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((n, n), np.float32)
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            lo, hi = np.searchsorted(column, [a, a + 4096])
            dense = np.zeros((n, 4096), np.float32)
            dense[row[lo:hi], column[lo:hi] - a] = 1
            both += dense @ dense.T
        near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        left, out = np.ones(n, bool), []
        for k in range(n):
            if left[k]:
                left[k], reached = False, [k]
                while reached:
                    i = reached.pop()
                    new = np.flatnonzero(near[i] & left)
                    left[new] = False
                    out += [(reps[i], reps[j]) for j in new]
                    reached += new.tolist()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.join(texts, "rep").groupBy("family", "x", "y").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links), kept (the row has that id)."""
    ready(docs.sparkSession)
    sigs = stage(signed(docs, words, id_col, text_col), "signatures")
    same = ["n_shingles", "set_a", "set_b"]
    classes = stage(sigs.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    errors = errors_of(percent)
    keys = keyed(classes, errors)
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1")
    keys = stage(keys.join(shared.select("key", "pivot"), "key"), "keys")
    near = stage(keys.select("rep").distinct().join(classes.select("rep", "n_shingles", "sig"), "rep"), "near-signatures")
    wanted = near.select(F.col("rep").alias(id_col))
    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).join(wanted, id_col, "left_semi")
    texts = stage(source.groupBy(id_col).agg(F.first("text").alias("text")).withColumnRenamed(id_col, "rep"), "near-texts")

    def close(n: str, m: str, x: str, y: str) -> Column:
        return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (differing(F.col(x), F.col(y)) <= errors)

    # Each class with the pivots of its keys: one link a class is confirmed; all of them make families.
    a = near.select(F.col("rep").alias("pivot"), F.col("n_shingles").alias("n_pivot"), F.col("sig").alias("sig_pivot"))
    pairs = keys.where("rep != pivot").select("pivot", "rep").distinct().join(a, "pivot").join(near, "rep").where(close("n_shingles", "n_pivot", "sig", "sig_pivot"))
    pairs = stage(pairs.select("pivot", "rep", differing(F.col("sig"), F.col("sig_pivot")).alias("apart")), "pairs")
    links = stage(confirmed(pairs.groupBy("rep").agg(F.min_by("pivot", F.struct("apart", "pivot")).alias("pivot")).select("pivot", "rep"), texts, words, percent), "links")
    reached = stage(components(links), "components")
    # Keys whose classes are in several components are open: all their classes are compared, within families in blocks, across them by pairs.
    family = stage(components(pairs, "pivot", "rep"), "families").select(F.col("node").alias("rep"), F.col("component").alias("family"))
    members = keys.select("key", "rep").join(reached.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    several = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    members = stage(members.join(several, "key").join(family, "rep", "left").select("key", "rep", "component", F.coalesce("family", "rep").alias("family")), "open-keys")
    each = members.select("family", "rep", "component").distinct()
    split = each.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("family")
    within = stage(linked_in_blocks(stage(each.join(split, "family").join(near.select("rep", "n_shingles"), "rep").select("family", "rep", "n_shingles"), "members"), texts, words, percent), "links")
    info = members.join(near, "rep")
    other = info.select("key", F.col("rep").alias("pivot"), F.col("component").alias("component_pivot"), F.col("family").alias("family_pivot"), F.col("n_shingles").alias("n_pivot"), F.col("sig").alias("sig_pivot"))
    apart = (info["key"] == other["key"]) & (F.col("pivot") < F.col("rep")) & (F.col("component") != F.col("component_pivot")) & (F.col("family") != F.col("family_pivot"))
    across = stage(info.join(other, apart & close("n_shingles", "n_pivot", "sig", "sig_pivot")).select("pivot", "rep").distinct(), "pairs")
    links = links.union(within).union(stage(confirmed(across, texts, words, percent), "links"))
    reached = stage(components(links), "components")
    whole = classes.drop("sig").join(reached.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    return (
        sigs.drop("sig").join(whole, same, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .withColumnRenamed("doc_id", id_col)
    )


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
