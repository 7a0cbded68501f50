"""Matrices in ``.npy`` files, read by ranges of their rows."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs


def _opened(path: str) -> pa.NativeFile:
    store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3a:", "s3:", path)))
    return store.open_input_file(name)


def header(file) -> dict:
    """Shape, order, type and start of the numbers of a matrix of plain numbers."""
    version = np.lib.format.read_magic(file)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if dtype.hasobject or dtype.names or len(shape) != 2:
        raise ValueError(f"no matrix of numbers: {dtype}, {len(shape)} dimensions")
    return {"shape": list(shape), "fortran": bool(fortran), "dtype": dtype.str, "start": file.tell()}


def _checked(path: str, columns: int, width: int) -> None:
    if columns != width:
        raise ValueError(f"{path}: {columns} channels, not {width}")


def entity(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".npy")


def ranges(batches: Iterator[pa.RecordBatch], width: int, rows: int) -> Iterator[pa.RecordBatch]:
    """For each file ranges of its rows, with what its header says."""
    for batch in batches:
        out: list[tuple] = []
        for path in batch.column(0).to_pylist():
            with _opened(path) as file:
                about = header(file)
            n, columns = about["shape"]
            _checked(path, columns, width)
            out += [(path, lo, min(rows, n - lo), json.dumps(about)) for lo in range(0, n, rows)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["path", "first", "rows", "about"])


def _range(file, about: dict, first: int, rows: int) -> np.ndarray:
    (n, columns), dtype = about["shape"], np.dtype(about["dtype"])
    get = lambda at, count: np.frombuffer(file.read_at(count * dtype.itemsize, about["start"] + at * dtype.itemsize), dtype)
    if about["fortran"]:  # a column's rows stand together
        return np.stack([get(c * n + first, rows) for c in range(columns)], axis=1)
    return get(first * columns, rows * columns).reshape(rows, columns)


def _rows(path: str, first: int, matrix: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(np.ascontiguousarray(matrix, float).reshape(-1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)), flat)
    return pa.RecordBatch.from_arrays([pa.array([entity(path)] * len(matrix)), pa.array(np.arange(first, first + len(matrix))), lists], ["entity", "t", "x"])


def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first, rows, about in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with _opened(path) as file:
                yield _rows(path, first, _range(file, json.loads(about), first, rows))


def read_whole(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            matrix = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
            _checked(path, matrix.shape[1], width)
            if len(matrix):
                yield _rows(path, 0, matrix)
