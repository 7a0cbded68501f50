"""Token ids in files: frequency ranks in a byte-aligned variable-length code with separate control bytes.

A store is a folder with two tables.  ``ranks`` holds ``version, rank, id`` for every id of the vocabulary.  A row of
``blocks`` is a block of texts in ascending id order: ``part, block, doc_ids, lengths, control, data``.  An id is stored
as its rank by frequency in the corpus, in the 1 to 4 low bytes that it needs, in ``data``; ``control`` holds two bits per
id, its number of bytes less one, four ids to a byte, the first in the low bits.  Reading looks the lengths of four ids
up in a table by control byte, sums them to places and gathers the bytes.

The ids wait in a table of their own between counting and writing, which goes when the store is written.  Encoding the
texts twice instead takes less disk, but more CPU seconds than the check tool allows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import bounded_batches, new_path, remove, slices, written

#: Appended to every text.
END_ID = 2
#: Ids of a block, unless one text has more.
BLOCK_IDS = 1 << 18
#: Ids of a part of the files, about: with more ids there are more parts.
PART_IDS = 1 << 25
#: Version of the format, stored with the ranks.
VERSION = 1
RANK_SCHEMA = "version int, rank int, id int"
FILE_SCHEMA = "part int, block int, doc_ids array<long>, lengths array<long>, control binary, data binary"

#: Byte lengths of the four ids of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype(np.uint32)
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    stop = np.cumsum(size)
    data = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint8)
    start = stop - size
    for i in range(4):
        has = size > i
        data[start[has] + i] = (ranks[has] >> np.uint32(8 * i)).astype(np.uint8)
    two = np.zeros(-len(ranks) % 4 + len(ranks), np.uint8)
    two[: len(ranks)] = size - 1
    two = two.reshape(-1, 4)
    return two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6, data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers that ``pack`` stored."""
    size = LENGTHS[control].ravel()[:n]
    start = np.cumsum(size) - size
    out = data[start].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for i in range(1, 4):
        has = np.flatnonzero(size > i)
        if len(has):
            out[has] |= data[start[has] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.load(path)
        kind = np.uint16 if max(table.size, end_id + 1) <= 1 << 16 else np.uint32
        for batch in slices(batches, 1):
            ids = [np.append(x, end_id).astype(kind).tobytes() for x in bpe.encoded(batch.column(1).fill_null(""), table)]
            width = np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "n", "tie", "ids"],
            )

    return run


def _numbers(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32)


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches, 1):
            ids = [_numbers(x, n) for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            total += np.bincount(np.concatenate([np.zeros(0, np.uint16), *ids]), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return run


def _write(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        docs: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            control, data = pack(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([list(map(len, held))], pa.list_(pa.int64())), pa.array([control.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())],
                ["part", "block", "doc_ids", "lengths", "control", "data"],
            )

        for batch in slices(batches, 2):
            for doc, n, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                docs.append(doc)
                held.append(rank[_numbers(ids, n)])
                size += n
                if size >= BLOCK_IDS:
                    yield flush()
                    docs, held, size, block = [], [], 0, block + 1
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends ``end_id`` and writes the store at ``path``.

    Ranks order ids by falling frequency over all texts, then by id; the counts that come to the driver are one for
    each id of the vocabulary.  Texts are dealt by ranges of their id (equal ids by a checksum of the ids).  Ids are
    integers: a column of other types must cast to long without loss, or it is an error.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"the ids of the store are integers, not {kind}")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = written(docs.mapInArrow(_tokenise(tokenizer, end_id), "doc_id long, n long, tie long, ids binary"), "ids", compression="zstd")
    size = max(bpe.load(tokenizer).size, end_id + 1)
    total = np.zeros(size, np.int64)
    for r in ids.select("n", "ids").mapInArrow(_frequencies(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[r["id"]] = r["n"]
    by_rank = np.lexsort([np.arange(size), -total])
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    ranks = F.get(F.from_json(F.lit(str(by_rank.tolist())), "array<int>"), F.col("id").cast("int"))
    spark.range(size).select(F.lit(VERSION).alias("version"), F.col("id").cast("int").alias("rank"), ranks.alias("id")).coalesce(1).write.parquet(f"{path}/ranks")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(int(total.sum()) / PART_IDS))
    ordered = ids.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "n", "ids").mapInArrow(_write(rank), FILE_SCHEMA).write.parquet(f"{path}/blocks")
    remove(spark, ids)


def load_ranks(spark, path: str) -> np.ndarray:
    """The id of each rank of a store; as many numbers as the vocabulary has ids."""
    rows = spark.read.schema(RANK_SCHEMA).parquet(f"{path}/ranks").collect()
    if {r["version"] for r in rows} != {VERSION} or sorted(r["rank"] for r in rows) != list(range(len(rows))):
        raise ValueError(f"the store at {path} is not of version {VERSION} of the format")
    by_rank = np.empty(len(rows), np.uint32)
    by_rank[[r["rank"] for r in rows]] = [r["id"] for r in rows]
    return by_rank


def _read(by_rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, block, docs, lengths, control, data = (batch.column(i)[row] for i in range(6))
                lengths = np.array(lengths.as_py(), np.int64)
                ids = by_rank[unpack(np.frombuffer(control.as_buffer(), np.uint8), np.frombuffer(data.as_buffer(), np.uint8), int(lengths.sum()))].astype("<u4")
                stop = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * len(lengths), pa.int32()), pa.array([block.as_py()] * len(lengths), pa.int32()), pa.array(docs.as_py(), pa.int64()), pa.array(stop - lengths),
                     pa.array(lengths), pa.array([ids[a:b].tobytes() for a, b in zip(stop - lengths, stop, strict=True)], pa.binary())],
                    ["part", "block", "doc_id", "at", "n_tokens", "ids"],
                )

    return run


def _digest(read):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read(batches):
            crc = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column(5)], pa.int64())
            yield batch.set_column(5, "ids_crc32", crc)

    return run


def read_ids(spark, path: str) -> DataFrame:
    """``part, block, doc_id, at, n_tokens, ids`` of a store: ids as little-endian unsigned 32-bit numbers."""
    bounded_batches(spark)
    blocks = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/blocks")
    return blocks.mapInArrow(_read(load_ranks(spark, path)), "part int, block int, doc_id long, at long, n_tokens long, ids binary")


def digest(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of a store; ``start`` counts the ids of all texts before a text."""
    bounded_batches(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/blocks")
    blocks = files.select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))
    parts = blocks.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_first"))
    blocks = blocks.withColumn("block_first", before(Window.partitionBy("part").orderBy("block"))).join(parts, "part")
    found = files.mapInArrow(_digest(_read(load_ranks(spark, path))), "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(blocks.select("part", "block", (F.col("part_first") + F.col("block_first")).alias("first")), ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def stored(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts and reads them back: ``doc_id, start, n_tokens, ids_crc32``.

    The files are in ascending id order (null ids first; rows of equal id by a checksum of their ids).  Null counts as
    an empty text, which holds ``end_id`` alone.  Repeated rows are stored as often as they come; texts may be of any
    script and length; an empty table gives none.
    """
    path = path or new_path(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer, path, end_id, id_col, text_col)
    return digest(docs.sparkSession, path)
