"""Headerless files: whole 1-D arrays, tiles in files of their own, tiles at byte offsets, and a file handle."""

from __future__ import annotations

import math
import os
from collections.abc import Sequence

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from ..functions import types as T
from ..operators.store import Store
from .chunks import CELLS, file_size, filesystem, read_bytes, read_chunks, split, write_bytes, write_chunks


def from_file(spark: SparkSession, path: str, t: T.ElementType) -> Store:
    """A 1-D store of as many elements as the file holds; byte ranges are read by the tasks."""
    size = file_size(path)
    if size % t.size:
        raise ValueError(f"{size} bytes are no whole number of {t}")
    n, kind = size // t.size, t.numpy
    chunks = [((k,), (min(CELLS, n - k),), path, k * t.size, min(CELLS, n - k) * t.size) for k in range(0, n, CELLS)]
    return read_chunks(spark, t, (n,), chunks, lambda p, at, size: np.frombuffer(read_bytes(p, at, size), kind))


def to_file(path: str, store: Store) -> None:
    """One file; each task writes its own byte range, so the path has to be in a shared POSIX file system."""
    if store.ndim != 1:
        raise ValueError("only 1-D stores go to one file")
    fs, where = filesystem(path)
    if not isinstance(fs, pafs.LocalFileSystem):
        raise ValueError(f"{path}: tasks write into one file, which needs a shared POSIX folder")
    fs.create_dir(where.rpartition("/")[0] or ".", recursive=True)
    size = store.type.size
    with open(where, "wb") as f:
        f.truncate(store.volume * size)

    def save(a: np.ndarray, color: tuple[int, ...]) -> None:
        with open(where, "r+b") as f:
            f.seek(color[0] * CELLS * size)
            f.write(np.ascontiguousarray(a).tobytes())

    if store.volume:
        write_chunks(store, (CELLS,), save)


def _tile_name(folder: str, color: Sequence[int], start: Sequence[int]) -> str:
    return folder.rstrip("/") + "/" + ".".join(str(c + s) for c, s in zip(color, start))


def _tiles(shape: Sequence[int], tile: Sequence[int], start: Sequence[int] | None) -> tuple[int, ...]:
    start = (0,) * len(shape) if start is None else tuple(start)
    if not len(shape) == len(tile) == len(start):
        raise ValueError("shape, tile and start differ in rank")
    if any(t <= 0 for t in tile) or any(n % t for n, t in zip(shape, tile)):
        raise ValueError(f"shape {tuple(shape)} is no multiple of tile {tuple(tile)}")
    return start


def from_tiles(spark: SparkSession, folder: str, shape: Sequence[int], t: T.ElementType, tile: Sequence[int], start: Sequence[int] | None = None) -> Store:
    """A store from a folder with one file for each tile, named by its color (plus start) joined by dots."""
    start, kind = _tiles(shape, tile, start), t.numpy
    chunks = [(origin, tile, _tile_name(folder, color, start)) for color, origin in split(shape, tile)]
    return read_chunks(spark, t, shape, chunks, lambda p: np.frombuffer(read_bytes(p), kind))


def to_tiles(folder: str, store: Store, tile: Sequence[int], start: Sequence[int] | None = None) -> None:
    start = _tiles(store.shape, tile, start)
    write_chunks(store, tile, lambda a, color: write_bytes(_tile_name(folder, color, start), np.ascontiguousarray(a).tobytes()))


def from_offsets(spark: SparkSession, path: str, shape: Sequence[int], t: T.ElementType, offsets: Sequence[int], tile: Sequence[int]) -> Store:
    """A store whose tiles, in C order, lie at byte offsets of one file."""
    _tiles(shape, tile, None)
    if len(offsets) != math.prod(n // m for n, m in zip(shape, tile)):
        raise ValueError(f"{len(offsets)} offsets don't fit the number of tiles")
    size, kind = math.prod(tile) * t.size, t.numpy
    chunks = [(origin, tile, path, int(at), size) for (_, origin), at in zip(split(shape, tile), offsets)]
    return read_chunks(spark, t, shape, chunks, lambda p, at, size: np.frombuffer(read_bytes(p, at, size), kind))


class FileHandle:
    """A file that is read, or written, as a whole; flags as in open(): r, w, or r+."""

    def __init__(self, spark: SparkSession, path: str | os.PathLike, flags: str = "r") -> None:
        if flags not in ("r", "w", "r+", "w+"):
            raise ValueError(f"flags {flags!r}")
        self.spark, self.path, self.flags, self.closed = spark, os.fspath(path), flags, False
        if flags == "r":
            file_size(self.path)

    def _check(self, wants: str) -> None:
        if self.closed:
            raise RuntimeError("the file is closed")
        if wants not in self.flags and "+" not in self.flags:
            raise ValueError(f"the file isn't open for {'reading' if wants == 'r' else 'writing'}")

    def read(self, t: T.ElementType) -> Store:
        self._check("r")
        return from_file(self.spark, self.path, t)

    def write(self, store: Store) -> None:
        self._check("w")
        to_file(self.path, store)

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> FileHandle:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()
