"""Arrays in files, a chunk at a time: what raw files, tiles, Zarr and HDF5 have in common."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import types as T
from ..operators.store import Store, _from_arrow, _to_arrow, coords, create_store

#: Cells that one task reads or writes at a time.
CELLS = 1 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """A URI's file system, or the local one (a folder that all executors share)."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def read_bytes(path: str, offset: int = 0, size: int | None = None) -> bytes:
    fs, where = filesystem(path)
    with fs.open_input_file(where) as f:
        f.seek(offset)
        return f.read() if size is None else f.read(size)


def write_bytes(path: str, data: bytes) -> None:
    fs, where = filesystem(path)
    fs.create_dir(where.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(where) as f:
        f.write(data)


def file_size(path: str) -> int:
    info = filesystem(path)[0].get_file_info(filesystem(path)[1])
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return info.size


def read_chunks(spark: SparkSession, t: T.ElementType, shape: Sequence[int], chunks: list[tuple], load: Callable[..., np.ndarray]) -> Store:
    """A store from chunks (origin, extents, what load needs): each is loaded by the task that needs it, and a view that cuts or projects loads
    only the chunks that it meets. Cells beyond the shape are cut off."""
    n, out = len(shape), create_store(spark, t, shape)
    names = coords(n)
    schema = ", ".join([*(f"{c} bigint" for c in names), f"v {t.spark}"])
    if not chunks or not math.prod(shape):
        return out.replace(spark.createDataFrame([], schema))
    limits = tuple(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ast

        for b in batches:
            for row in b.to_pylist():
                a = load(*ast.literal_eval(row["what"])).reshape(row["size"])
                keep = [max(0, min(s, m - o)) for o, s, m in zip(row["origin"], row["size"], limits)]
                a = a[tuple(slice(0, k) for k in keep)]
                flat, total = np.ascontiguousarray(a).reshape(-1), a.size
                for k in range(0, total, CELLS):
                    part = flat[k : k + CELLS]
                    at = np.unravel_index(np.arange(k, k + len(part)), a.shape)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x + o, pa.int64()) for x, o in zip(at, row["origin"])), _to_arrow(part, t)], names=[*names, "v"])

    def rows(some: list[tuple]) -> DataFrame:
        wanted = spark.createDataFrame(pa.table({"origin": pa.array([list(map(int, c[0])) for c in some], pa.list_(pa.int64())), "size": pa.array([list(map(int, c[1])) for c in some], pa.list_(pa.int64())), "what": pa.array([repr(c[2:]) for c in some])}))
        return wanted.repartition(min(len(some), max(spark.sparkContext.defaultParallelism, len(some) // 4))).mapInArrow(run, schema)

    def met(box: list[tuple[int, int]]) -> DataFrame:
        return rows([c for c in chunks if all(o <= hi and lo < o + n for o, n, (lo, hi) in zip(c[0], c[1], box))])

    out.replace(rows(chunks))
    out.root.read = met
    return out


def write_chunks(store: Store, tile: Sequence[int], save: Callable[[np.ndarray, tuple[int, ...]], None], pad: bool = False) -> int:
    """Each tile of the store to save(array, color); with pad, tiles at the edges are filled up with zeros. Runs now; gives the number of tiles."""
    n, t, shape = store.ndim, store.type, store.shape
    cut = store.partition_by_tiling(tile)
    colors = [f"c{k}" for k in range(n)]
    tile = tuple(tile)

    def run(rows: pa.Table) -> pa.Table:
        color = tuple(int(rows[c][0].as_py()) for c in colors)
        low = [c * s for c, s in zip(color, tile)]
        a = np.zeros([s if pad else min(s, m - o) for s, m, o in zip(tile, shape, low)], t.numpy)
        expected = math.prod(min(s, m - o) for s, m, o in zip(tile, shape, low))
        if rows.num_rows != expected:
            raise ValueError(f"{expected - rows.num_rows} cells of tile {color} have no value")
        a[tuple(rows[f"d{k}"].to_numpy() - o for k, o in enumerate(low))] = _from_arrow(rows["v"], t)
        save(a, color)
        return pa.table({"done": pa.array([1], pa.int32())})

    made = cut.df.groupBy(*colors).applyInArrow(run, "done int").agg(F.sum("done")).first()[0] or 0
    if made != math.prod(cut.colors):
        raise ValueError(f"{math.prod(cut.colors) - made} tiles have no value")
    return made


def split(shape: Sequence[int], tile: Sequence[int]) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(color, origin) of all tiles, in C order."""
    counts = [-(-n // t) for n, t in zip(shape, tile)]
    for color in np.ndindex(*counts):
        yield color, tuple(c * t for c, t in zip(color, tile))


