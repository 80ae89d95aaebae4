"""Zarr version 2 folders: C order, no compressor, no filters, chunk names joined by dots."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from ..functions import types as T
from ..operators.store import Store
from .chunks import filesystem, read_bytes, read_chunks, split, write_bytes, write_chunks

#: Fixed values, so that default chunks are those of other writers: bytes aimed at for 1 MiB of data, least, most, and how near is near.
BASE, LEAST, MOST, NEAR = 256 * 1024, 128 * 1024, 64 * 1024 * 1024, 0.5


def default_chunks(shape: Sequence[int], item: int) -> tuple[int, ...]:
    """Axes are halved in turn until a chunk is near the aim, which grows by a factor of 2 for each tenfold of the data."""
    sizes = [max(1, n) for n in shape]
    if not item:
        return tuple(shape)
    aim = min(MOST, max(LEAST, BASE * 2 ** math.log10(math.prod(sizes) * item / 2**20)))

    def fine(halvings: int) -> tuple[bool, list[int]]:
        each = [halvings // len(sizes) + (k < halvings % len(sizes)) for k in range(len(sizes))]
        chunk = [-(-n // 2**h) for n, h in zip(sizes, each)]
        size = math.prod(chunk) * item
        return math.prod(chunk) == 1 or size < MOST and (size < aim or abs(size - aim) < NEAR * aim), chunk

    halvings = 0
    while not fine(halvings)[0]:
        halvings += 1
    return tuple(fine(halvings)[1])


def chunks_of(chunks: int | Sequence[int] | None, shape: Sequence[int], item: int) -> tuple[int, ...]:
    if chunks is None:
        return default_chunks(shape, item)
    given = [chunks] * len(shape) if isinstance(chunks, (int, np.integer)) and not isinstance(chunks, bool) else list(chunks) if isinstance(chunks, (tuple, list)) else None
    if given is None or any(isinstance(c, bool) or not isinstance(c, (int, np.integer)) for c in given):
        raise TypeError("chunks have to be an int, ints, or None")
    if len(given) > len(shape):
        raise ValueError("too many dimensions in chunks")
    given += list(shape[len(given) :])
    out = tuple(int(n if c == -1 else c) for c, n in zip(given, shape))
    if any(c < 1 for c in (max(c, 1) if n == 0 else c for c, n in zip(out, shape))):
        raise ValueError("chunks have to be positive")
    return tuple(max(1, c) for c in out)


def write_array(store: Store, folder: str, chunks: int | Sequence[int] | None = None) -> None:
    """Each chunk is a file that one task writes; those at the edges are filled up. A folder that is neither empty nor Zarr is left alone."""
    if store.ndim == 0:
        raise ValueError("arrays without dimensions can't be written")
    fs, where = filesystem(folder)
    if fs.get_file_info(where).type == pafs.FileType.Directory:
        there = fs.get_file_info(pafs.FileSelector(where))
        if there and not any(i.base_name == ".zarray" for i in there):
            raise ValueError(f"{folder} holds other files")
        fs.delete_dir_contents(where)
    item = store.type.numpy
    cut = chunks_of(chunks, store.shape, item.itemsize)
    base = folder.rstrip("/")
    head = {"chunks": list(cut), "compressor": None, "dtype": item.str, "fill_value": 0, "filters": None, "order": "C", "shape": list(store.shape), "zarr_format": 2}
    if store.volume:
        write_chunks(store, cut, lambda a, color: write_bytes(base + "/" + ".".join(map(str, color)), np.ascontiguousarray(a).tobytes()), pad=True)
    write_bytes(base + "/.zarray", json.dumps(head).encode())  # last: a folder with a head is whole
    write_bytes(base + "/.zattrs", b"{}")


def read_array(spark: SparkSession, folder: str) -> Store:
    base = folder.rstrip("/")
    try:
        head = json.loads(read_bytes(base + "/.zarray"))
    except FileNotFoundError:
        fs, where = filesystem(base + "/zarr.json")
        if fs.get_file_info(where).type == pafs.FileType.File:
            raise NotImplementedError("only Zarr version 2 can be read") from None
        raise
    for key, wanted in (("zarr_format", 2), ("order", "C")):
        if head.get(key) != wanted:
            raise NotImplementedError(f"{key} {head.get(key)!r}")
    if head.get("dimension_separator", ".") != ".":
        raise NotImplementedError(f"dimension separator {head['dimension_separator']!r}")
    if head.get("compressor") is not None or head.get("filters"):
        raise NotImplementedError("compressed or filtered chunks")
    kind, shape, cut = np.dtype(head["dtype"]), tuple(head["shape"]), tuple(head["chunks"])
    if kind.byteorder == ">":
        raise NotImplementedError("big-endian data")
    t, fill = T.of_dtype(kind), head.get("fill_value") or 0
    size = math.prod(cut)

    def load(path: str) -> np.ndarray:
        fs, where = filesystem(path)
        if fs.get_file_info(where).type == pafs.FileType.NotFound:  # a chunk that was never written
            return np.full(size, fill, kind)
        return np.frombuffer(read_bytes(path), kind)

    return read_chunks(spark, t, shape, [(origin, cut, base + "/" + ".".join(map(str, color))) for color, origin in split(shape, cut)], load)
