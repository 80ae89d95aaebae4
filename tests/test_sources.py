import io
import json
import os

import numpy as np
import pytest

from tessera.functions import types as T
from tessera.functions.benchmark_log import BenchmarkLog
from tessera.operators.store import create_store, from_numpy
from tessera.sources import hdf5, raw, zarr


@pytest.mark.parametrize("dtype", ["u1", "i4", "f8", "u8", "f2", "c16"])
def test_raw(spark, tmp_path, dtype):
    a = np.arange(1000).astype(dtype)
    raw.to_file(f"{tmp_path}/a", from_numpy(spark, a))
    assert (np.fromfile(f"{tmp_path}/a", dtype) == a).all()
    assert (raw.from_file(spark, f"{tmp_path}/a", T.of_dtype(dtype)).to_numpy() == a).all()


def test_raw_edges(spark, tmp_path):
    raw.to_file(f"{tmp_path}/empty", from_numpy(spark, np.zeros(0)))
    assert raw.from_file(spark, f"{tmp_path}/empty", T.float64).shape == (0,)
    with pytest.raises(ValueError):
        raw.to_file(f"{tmp_path}/b", from_numpy(spark, np.zeros((2, 2))))
    (tmp_path / "odd").write_bytes(b"123")
    with pytest.raises(ValueError):
        raw.from_file(spark, f"{tmp_path}/odd", T.int32)
    with pytest.raises(FileNotFoundError):
        raw.from_file(spark, f"{tmp_path}/none", T.int32)


@pytest.mark.parametrize(("shape", "tile", "start"), [((6,), (2,), (0,)), ((4, 6), (2, 3), (0, 0)), ((4, 6), (4, 2), (1, 2)), ((2, 4, 6), (1, 2, 3), None)])
def test_tiles(spark, tmp_path, shape, tile, start):
    a = np.arange(int(np.prod(shape))).reshape(shape)
    raw.to_tiles(str(tmp_path), from_numpy(spark, a), tile, start)
    assert len(os.listdir(tmp_path)) == np.prod([n // t for n, t in zip(shape, tile)])
    assert ".".join(map(str, start or (0,) * len(shape))) in os.listdir(tmp_path)
    assert (raw.from_tiles(spark, str(tmp_path), shape, T.int64, tile, start).to_numpy() == a).all()
    for bad in (((5,) * len(shape), tile), (shape, tile[:-1] or (1, 1))):
        with pytest.raises(ValueError):
            raw.from_tiles(spark, str(tmp_path), bad[0], T.int64, bad[1])


def test_offsets(spark, tmp_path):
    a = np.arange(24).reshape(4, 6)
    parts = [a[i : i + 2, j : j + 3] for i in (0, 2) for j in (0, 3)]
    order, data, at = [2, 0, 3, 1], b"junk!", {}
    for k in order:
        at[k] = len(data)
        data += parts[k].tobytes() + b"pad"
    (tmp_path / "x").write_bytes(data)
    assert (raw.from_offsets(spark, f"{tmp_path}/x", (4, 6), T.int64, [at[k] for k in range(4)], (2, 3)).to_numpy() == a).all()
    with pytest.raises(ValueError):
        raw.from_offsets(spark, f"{tmp_path}/x", (4, 6), T.int64, [0], (2, 3))


def test_file_handle(spark, tmp_path):
    a = from_numpy(spark, np.arange(10))
    with raw.FileHandle(spark, tmp_path / "f", "w") as f:
        f.write(a)
        with pytest.raises(ValueError):
            f.read(T.int64)
    with pytest.raises(RuntimeError):
        f.write(a)
    with raw.FileHandle(spark, tmp_path / "f", "r") as f:
        assert (f.read(T.int64).to_numpy() == np.arange(10)).all()
        with pytest.raises(ValueError):
            f.write(a)
    with pytest.raises(ValueError):
        raw.FileHandle(spark, tmp_path / "f", "a")


@pytest.mark.parametrize(("shape", "chunks"), [((9,), (9,)), ((11,), (4,)), ((6, 10), (3, 5)), ((7, 5), (4, 4)), ((3, 1, 8), (2, 2, 3)), ((1, 2, 2, 5, 2), (2, 1, 3, 2, 1)), ((0, 3), (2, 2)), ((7,), None), ((6, 6), 4), ((6, 6), (4,)), ((6, 6), (4, -1))])
@pytest.mark.parametrize("dtype", ["u1", "f8"])
def test_zarr(spark, tmp_path, shape, chunks, dtype):
    a = np.arange(int(np.prod(shape))).reshape(shape).astype(dtype)
    zarr.write_array(from_numpy(spark, a), f"{tmp_path}/z", chunks)
    head = json.loads((tmp_path / "z/.zarray").read_text())
    assert head["shape"] == list(shape) and head["zarr_format"] == 2 and head["compressor"] is None
    assert (zarr.read_array(spark, f"{tmp_path}/z").to_numpy() == a).all()
    size = int(np.prod(head["chunks"])) * a.itemsize
    assert all((tmp_path / "z" / f).stat().st_size == size for f in os.listdir(tmp_path / "z") if not f.startswith("."))


@pytest.mark.parametrize(("shape", "dtype", "chunks"), [((0,), "f8", (1,)), ((10**9,), "u1", (1953125,)), ((10**9,), "f8", (488282,)), ((2048, 257, 17), "f8", (512, 65, 5))])
def test_zarr_default_chunks(shape, dtype, chunks):
    assert zarr.default_chunks(shape, np.dtype(dtype).itemsize) == chunks


def test_a_view_reads_the_chunks_that_it_meets(spark, tmp_path):
    a = np.arange(12 * 20.0).reshape(12, 20)
    zarr.write_array(from_numpy(spark, a), f"{tmp_path}/z", (4, 5))
    whole = zarr.read_array(spark, f"{tmp_path}/z")
    views = [(whole[5:8, 6:10], a[5:8, 6:10], {"1.1"}), (whole[3:5].project(1, 19), a[3:5, 19], {"0.3", "1.3"}), (whole.transpose((1, 0))[0:6, 8:12], a.T[0:6, 8:12], {"2.0", "2.1"})]
    for view, want, needed in views:
        for f in os.listdir(tmp_path / "z"):  # a chunk that is read all the same has the wrong size
            if not f.startswith(".") and f not in needed:
                (tmp_path / "z" / f).write_bytes(b"gone")
        assert (view.to_numpy() == want).all()
        zarr.write_array(from_numpy(spark, a), f"{tmp_path}/z", (4, 5))
    whole[5:8, 6:10].fill(-1.0)  # a new version is no longer what the file holds
    a[5:8, 6:10] = -1
    assert (whole[4:9].to_numpy() == a[4:9]).all()


def test_one_file_needs_a_posix_folder(spark):
    with pytest.raises((ValueError, OSError)):
        raw.to_file("mock://bucket/x", from_numpy(spark, np.arange(4)))


def test_zarr_refusals(spark, tmp_path):
    s = from_numpy(spark, np.arange(4))
    (tmp_path / "other").mkdir()
    (tmp_path / "other/file").write_text("x")
    with pytest.raises(ValueError):
        zarr.write_array(s, f"{tmp_path}/other")
    with pytest.raises(ValueError):
        zarr.write_array(create_store(spark, T.int64, ()).fill(1), f"{tmp_path}/zero")
    for bad, error in (((2, 2), ValueError), ("2", TypeError), (True, TypeError), ((1.5,), TypeError), ((0,), ValueError)):
        with pytest.raises(error):
            zarr.write_array(s, f"{tmp_path}/bad", bad)
    zarr.write_array(s, f"{tmp_path}/z", 2)
    zarr.write_array(from_numpy(spark, np.arange(3)), f"{tmp_path}/z", 2)  # an array may be written over
    assert zarr.read_array(spark, f"{tmp_path}/z").shape == (3,)
    head = json.loads((tmp_path / "z/.zarray").read_text())
    for k, v in (("zarr_format", 3), ("order", "F"), ("dimension_separator", "/"), ("compressor", {"id": "zlib"}), ("filters", [{}]), ("dtype", ">i8")):
        (tmp_path / "z/.zarray").write_text(json.dumps(head | {k: v}))
        with pytest.raises(NotImplementedError):
            zarr.read_array(spark, f"{tmp_path}/z")
    (tmp_path / "v3").mkdir()
    (tmp_path / "v3/zarr.json").write_text("{}")
    with pytest.raises(NotImplementedError):
        zarr.read_array(spark, f"{tmp_path}/v3")


def test_hdf5_without_its_package(spark):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ModuleNotFoundError, match="h5py"):
            hdf5.from_file(spark, "x.h5", "d")
    assert hdf5.type_of(np.dtype("V8")) == T.binary_type(8) and hdf5.type_of(np.dtype("f4")) == T.float32
    for bad in ("M8[s]", "U3", [("a", "i4")], ("i4", (2,))):
        with pytest.raises(NotImplementedError):
            hdf5.type_of(np.dtype(bad))
    with pytest.raises(ValueError):
        hdf5.check_batches((4, 4), (2,))
    with pytest.raises(ValueError):
        hdf5.check_batches((4, 4), (2, 0))
    assert hdf5.tiles_of((10**7,), (1000,), 8) == (1024000,) and hdf5.tiles_of((10,), None, 8) == (10,)


def test_benchmark_log():
    out = io.StringIO()
    with BenchmarkLog("b", ["size", "s"], {"cores": 8}, out) as log:
        log.log(size=1, s=0.5)
        with pytest.raises(ValueError):
            log.log(size=1)
    assert out.getvalue().splitlines()[-2:] == ["size,s", "1,0.5"] and "# cores: 8" in out.getvalue()
    with pytest.raises(ValueError):
        BenchmarkLog("b", ["a", "a"])
