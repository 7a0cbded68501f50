"""Folders that every executor sees, written tables that cut lineage, and bounds on what a Python worker holds."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import workers_find_package

#: Bytes of texts that a Python worker takes on at a time, unless a single text is longer.
SLICE_BYTES = 2 << 20
_made: dict[str, str] = {}
#: Paths written within each open ``scratch``.
_scratch: list[list[str]] = []
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a session that runs in one process (tests) gets a folder of its own; on a cluster, where a folder
    of one machine would lose rows, it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        app = spark.sparkContext.applicationId
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = _made[app] = _made.get(app) or "file://" + tempfile.mkdtemp(prefix="driftwell-")
    return conf.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/driftwell/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written within when it ends; a result that reads them is written outside first."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that no later plan reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lets Python workers find this package, and bounds the bytes of an Arrow batch by SLICE_BYTES.

    A batch of long texts would else take 64 MB or more of an executor beside its heap.  The bound holds when a plan
    runs, so it stays in the session; a lower one is left as it is.
    """
    workers_find_package(spark)
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get(_BATCH).lower()).groups()
    if int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0) > SLICE_BYTES:
        spark.conf.set(_BATCH, str(SLICE_BYTES))


def slices(batches: Iterator[pa.RecordBatch], *columns: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of whole rows that hold about ``limit`` bytes in the named columns (texts, bytes or
    lists of numbers), so that a batch of long texts takes no more memory than one of short ones.  A row that is larger
    stands alone; an empty batch stays one."""
    for batch in batches:
        size = np.ones(batch.num_rows, np.int64)
        for c in columns:
            column = batch.column(c)
            lists = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
            length = pc.list_value_length(column) if lists else pc.binary_length(column)
            size += length.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * (column.type.value_type.bit_width // 8 if lists else 1)
        stop, lo = np.cumsum(size), 0
        while lo < batch.num_rows or batch.num_rows == lo == 0:
            hi = max(lo + 1, int(np.searchsorted(stop, (stop[lo - 1] if lo else 0) + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    trimmed()


def trimmed() -> None:
    """Gives freed memory of this worker back to the machine: it lives on beside the executor's heap when its task ends."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


__all__ = ["bounded_batches", "new_path", "remove", "scratch", "shared_dir", "slices", "written"]
