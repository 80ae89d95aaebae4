"""HDF5 datasets, by way of h5py where it is installed."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import SparkSession

from ..functions import types as T
from ..operators.store import Store
from ..plans.tiles import launch_shape, tile_shape
from .chunks import CELLS, read_chunks, split, write_chunks


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise ModuleNotFoundError("HDF5 files need the package h5py, which isn't installed") from e
    return h5py


def type_of(dtype: np.dtype) -> T.ElementType:
    """Numbers, complex numbers and opaque bytes; times, compounds, references, enums, variable lengths and arrays raise."""
    d = np.dtype(dtype)
    if d.metadata and ({"enum", "vlen", "ref"} & set(d.metadata)) or d.kind in "mMOU" or d.names or d.subdtype:
        raise NotImplementedError(f"HDF5 type {d}")
    if d.kind == "S":
        return T.binary_type(d.itemsize)
    return T.of_dtype(d)


def tiles_of(shape: Sequence[int], chunks: Sequence[int] | None, pieces: int) -> tuple[int, ...]:
    """Tiles that are whole chunks of about CELLS cells where the dataset is chunked; else runs along the first axis."""
    if chunks:
        out = list(chunks)
        for k in reversed(range(len(shape))):
            while math.prod(out) * 2 <= CELLS and out[k] < shape[k]:
                out[k] *= 2
        return tuple(out)
    launch = launch_shape(shape, max(pieces, math.prod(shape) // CELLS))
    return tile_shape(shape, launch)


def from_file(spark: SparkSession, path: str, dataset: str) -> Store:
    """A dataset without dimensions becomes a store of one cell."""
    h5py = _h5py()
    with h5py.File(path, "r") as f:
        d = f[dataset]
        shape, t, chunks = d.shape or (1,), type_of(d.dtype), d.chunks
    tile = tiles_of(shape, chunks, spark.sparkContext.defaultParallelism)

    def load(path: str, name: str, origin: tuple, size: tuple) -> np.ndarray:
        with _h5py().File(path, "r") as f:
            return np.asarray(f[name][tuple(slice(o, o + s) for o, s in zip(origin, size))] if f[name].shape else f[name][()])

    parts = []
    for _, origin in split(shape, tile):
        size = tuple(min(t_, n - o) for t_, n, o in zip(tile, shape, origin))
        parts.append((origin, size, path, dataset, origin, size))
    return read_chunks(spark, t, shape, parts, load)


def to_file(store: Store, path: str, dataset: str) -> None:
    """Each tile goes to a file of its own; the file at `path` has a virtual dataset over them."""
    import os

    if store.unbound:
        raise ValueError("an unbound store can't be written")
    if os.path.isdir(path):
        raise ValueError(f"{path} is a folder")
    h5py = _h5py()
    tile, folder = tiles_of(store.shape, None, store.spark.sparkContext.defaultParallelism), path + ".tiles"
    os.makedirs(folder, exist_ok=True)

    def save(a: np.ndarray, color: tuple[int, ...]) -> None:
        with _h5py().File(f"{folder}/{'.'.join(map(str, color))}.h5", "w") as f:
            f[dataset] = a

    write_chunks(store, tile, save)
    layout = h5py.VirtualLayout(shape=store.shape, dtype=store.type.numpy)
    for color, origin in split(store.shape, tile):
        size = tuple(min(t, n - o) for t, n, o in zip(tile, store.shape, origin))
        layout[tuple(slice(o, o + s) for o, s in zip(origin, size))] = h5py.VirtualSource(f"{folder}/{'.'.join(map(str, color))}.h5", dataset, shape=size)
    with h5py.File(path, "w") as f:
        f.create_virtual_dataset(dataset, layout)


def check_batches(shape: Sequence[int], chunk: Sequence[int]) -> None:
    if len(chunk) != len(shape):
        raise ValueError(f"a chunk of rank {len(chunk)} for a dataset of rank {len(shape)}")
    if any(c <= 0 for c in chunk):
        raise ValueError("chunks have to be positive")


def from_file_batched(spark: SparkSession, path: str, dataset: str, chunk: Sequence[int]) -> Iterator[tuple[Store, tuple[int, ...]]]:
    """(store, offsets) of one chunk after the other, from low to high; those at the edges are shorter."""
    with _h5py().File(path, "r") as f:
        shape = f[dataset].shape
    check_batches(shape, chunk)
    whole = from_file(spark, path, dataset)
    for _, origin in split(shape, chunk):
        out = whole
        for k, (o, c, n) in enumerate(zip(origin, chunk, shape)):
            out = out.slice(k, slice(o, min(o + c, n)))
        yield out, origin
