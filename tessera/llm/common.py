"""Shared plumbing: session set-up, staged tables, word hashing in numpy, request/response by hash."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Characters of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 2 << 20
#: Bytes whose words are hashed at a time.
HASHED_BYTES = 1 << 18
#: Large binary values: small row groups, checked at each row, so that neither a writer nor a reader's batch holds many of them.
BLOBS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver found it."""
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; only where it is unset, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_folder, spark, path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a staged table; quietly nothing if the session has ended."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return


def stage(df: DataFrame, name: str, blobs: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors.

    blobs: the rows hold large binary values that are packed already.
    """
    spark = ready(df.sparkSession)
    path = new_folder(spark, name)
    df.write.options(compression="uncompressed" if blobs else "zstd", **(BLOBS if blobs else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove a table that stage() made and that nothing will read again."""
    drop_folder(df.sparkSession, df.staged_path)


def give_back() -> None:
    """Let this process's freed memory go back to the system, which else counts it on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def sweep(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of plans that nothing refers to any more: else they stay until the driver happens to collect its garbage."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# --- words as numbers -----------------------------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240817))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 19)
        for name, base in (("up", _M), ("down", _M_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Words:
    """Words of several texts: `hash` (64 bits each), byte bounds `lo`, `hi` in `buf`, and `start`: text k has words start[k]:start[k+1]."""

    def __init__(self, texts: list[str | None], lower: bool = False, separators: np.ndarray | None = None) -> None:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.buf = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        gap = (_SPACE if separators is None else separators)[self.buf]
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.lo, self.hi = edges[0::2], edges[1::2]
        self.hash = np.empty(len(self.lo), np.uint64)
        cuts = [0, *(np.flatnonzero(np.diff(self.lo // HASHED_BYTES)) + 1).tolist(), len(self.lo)] if len(self.lo) else []
        for a, b in zip(cuts, cuts[1:]):
            self._hash(a, b)
        ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
        self.start = np.concatenate([[0], np.searchsorted(self.lo, ends)]).astype(np.int64)

    def _hash(self, a: int, b: int) -> None:
        """Hash words a..b-1: differences of running sums, moved to where each word begins."""
        first, lo, hi = self.lo[a], self.lo[a:b], self.hi[a:b]
        own = self.buf[first : hi[-1]]
        up, down = _power(len(own) + 1)
        sums = np.zeros(len(own) + 1, np.uint64)
        np.take(_BYTE, own, out=sums[1:])
        sums[1:] *= up[: len(own)]
        np.cumsum(sums, out=sums)
        self.hash[a:b] = mix((sums[hi - first] - sums[lo - first]) * down[lo - first] + (hi - lo).astype(np.uint64))

    def runs(self, k: int, seed: int = 1) -> np.ndarray:
        """Hash of the k words from each word on; those that run over a text's end are to be left out by the caller."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += self.hash[j : j + n] * np.uint64(2 * pow(3 + seed, j + 1, 1 << 63) + 1)
        return mix(out)

    def within(self, k: int) -> np.ndarray:
        """Indexes of words from which k words of the same text follow (itself included)."""
        n = len(self.hash)
        end = np.repeat(self.start[1:], np.diff(self.start))
        return np.flatnonzero(np.arange(n) + k <= end)


def steps(rows: pd.DataFrame, text: str, most: int = STEP_BYTES) -> Iterator[pd.DataFrame]:
    """Slices of rows with about `most` characters each."""
    if not len(rows):
        return
    size = rows[text].map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy()
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        yield rows.iloc[a:b]


def string(value: object) -> str | None:
    """None for what pandas makes of a null."""
    return value if isinstance(value, str) else None


# --- request and response by hash --------------------------------------------------------------------------------------


def press(values: np.ndarray) -> bytes:
    """Bytes of an array, plane by plane (all first bytes, all second bytes, ...), so that planes without news vanish."""
    flat = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(1, write_content_size=True).compress(flat.view(np.uint8).reshape(len(flat), flat.dtype.itemsize).T.tobytes()) if len(flat) else b""


def unpress(data: bytes, kind: str | np.dtype) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not data:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def press_sorted(keys: np.ndarray) -> bytes:
    return press(np.diff(keys, prepend=np.uint64(0)))


def unpress_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpress(data, np.uint64), dtype=np.uint64)


def bucket_count(total_bytes: int, per_bucket: int = 24 << 20) -> int:
    """A power of two, so that a bucket is a run of top bits; each bucket gets about per_bucket bytes."""
    return 1 << max(4, math.ceil(math.log2(max(1, total_bytes) / per_bucket)))


def dealt(asks: DataFrame, buckets: int, kind: str | np.dtype) -> DataFrame:
    """asks (block, keys: sorted distinct uint64, vals: one of `kind` for each key) as a row for each block and bucket, pressed."""

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for block, keys, vals in zip(rows.block, rows["keys"], rows.vals):
                yield deal_rows(block, np.frombuffer(keys, np.uint64), np.frombuffer(vals, kind), buckets)

    return asks.mapInPandas(deal, DEALT)


DEALT = "part long, block long, keys binary, vals binary"


def deal_rows(block: int, keys: np.ndarray, vals: np.ndarray, buckets: int) -> pd.DataFrame:
    if not len(keys):
        return pd.DataFrame({"part": [], "block": [], "keys": [], "vals": []})
    top = keys >> np.uint64(64 - int(math.log2(buckets)))
    cuts = [0, *(np.flatnonzero(np.diff(top)) + 1), len(keys)]
    return pd.DataFrame({
        "part": [int(top[a]) for a in cuts[:-1]], "block": block,
        "keys": [press_sorted(keys[a:b]) for a, b in zip(cuts, cuts[1:])], "vals": [press(vals[a:b]) for a, b in zip(cuts, cuts[1:])],
    })


def gathered(rows: pd.DataFrame, kind: str | np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One bucket: its keys in order, their vals, the order itself, and the bounds of each row's own keys before ordering."""
    keys = [unpress_sorted(k) for k in rows["keys"]]
    cuts = np.cumsum([0, *map(len, keys)])
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    return flat[order], np.concatenate([unpress(v, kind) for v in rows.vals])[order], order, cuts


def starts_of(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])


def answered(asks: DataFrame, buckets: int, reduce: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], kind: str | np.dtype) -> DataFrame:
    """Ask about 64-bit keys, once a block: see dealt().

    All vals of one key meet: reduce(keys, vals, at) gets one bucket's keys in order with their vals, at being where each distinct
    key starts; it returns one answer for each row. The result has block, part (bucket) and answers, whose order within a block is
    that of its keys. A key that a third of all documents hold comes once a block, not once a document.
    """

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        keys, vals, order, cuts = gathered(rows, kind)
        said = reduce(keys, vals, starts_of(keys))
        back = np.empty(len(keys), said.dtype)
        back[order] = said
        return pd.DataFrame({"block": rows.block.to_numpy(), "part": rows.part.to_numpy(), "answers": [press(back[a:b]) for a, b in zip(cuts, cuts[1:])]})

    return dealt(asks, buckets, kind).groupBy("part").applyInPandas(meet, "block long, part long, answers binary")


def answers_of(rows: pd.DataFrame, kind: str | np.dtype) -> np.ndarray:
    """The answers to one block's keys, in the order of its keys."""
    return np.concatenate([np.zeros(0, kind), *(unpress(a, kind) for a in rows.sort_values("part").answers)])


def spread(counts: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """One value for each distinct key, repeated for all its rows."""
    return np.repeat(counts, np.diff(np.concatenate([at, [n]])))
