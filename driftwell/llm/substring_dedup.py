"""Substring duplicates: passages of many words that repeat anywhere in a corpus, found through recompressed symbols.

Rounds name runs and pairs of words by global rules, so equal passages have equal symbols inside.  Spark counts the names;
a stretch of words that decides a symbol of a name that no other place has cannot lie in a repeat, which leaves few windows.
These are told apart by 128 bits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .recompression import recompressed
from .shared import bounded_batches, remove, slices, trimmed, written
from .words import Block, blocks, distinct, hash_ranges, mix, words_of

#: Words of a window.
WINDOW = 35
#: Documents and ranges of windows that may be broadcast (some 30 MB); beyond, the tables are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_RANGES = 200_000, 1_000_000
_OTHER = np.uint64(0xA0761D6478BD642F)
_INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _texts(block: Block) -> Iterator[bytes]:
    for lo, hi in zip(block.offsets[:-1], block.offsets[1:], strict=True):
        yield block.data[lo:hi].tobytes()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``key, text`` with a key for each row, and the table that has the id of a key where the ids are none."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if rows.schema["id"].dataType.simpleString() in _INTEGERS and not rows.groupBy("id").count().where("id is null or count > 1").head(1):
        return rows.select(F.col("id").cast("long").alias("key"), "text"), None
    table = written(rows.withColumn("key", F.monotonically_increasing_id()), "keyed", "zstd")
    return table.select("key", "text"), table


def _symbols(window: int):
    """Per text: words, digest of all words, where its usable symbols are decided, and their names.

    Of a name that comes again within a slice only the first place goes on (``many``), the others are ``known`` to repeat;
    so a name has as many rows as there are slices, however often a passage occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for block in blocks(batch.column(1), batch.nbytes + 1):
                words = words_of(block)
                count = words.counts()
                s = recompressed(words.hash, np.repeat(np.arange(len(count)), count))
                s = s.pick(s.high - s.low <= window)
                which, first = distinct(s.name)
                often = np.bincount(which, minlength=len(first)) > 1
                begin = np.searchsorted(s.text, np.arange(len(count) + 1))
                held = np.diff(begin)
                place = np.arange(len(s)) - begin[s.text]
                first = np.sort(first)
                names = pa.StructArray.from_arrays([pa.array(s.name[first].view(np.int64)), pa.array(place[first].astype(np.int32)), pa.array(often[which[first]])], ["name", "place", "many"])
                low = s.low - words.first[s.text]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(block.first, len(block)), pa.array(count),
                    pa.array([hashlib.sha256(b" ".join(t.split())).digest() for t in _texts(block)], pa.binary()),
                    _lists(pa.array(low.astype(np.int32)), held), _lists(pa.array((low + s.high - s.low).astype(np.int32)), held),
                    _lists(pa.array(often[which]), held), _lists(names, np.bincount(s.text[first], minlength=len(count))),
                ], ["key", "n_words", "sha", "low", "high", "known", "names"])
        trimmed()

    return run


_SYMBOLS = "key long, n_words long, sha binary, low array<int>, high array<int>, known array<boolean>, names array<struct<name:long,place:int,many:boolean>>"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each value of a list column, and the values; null lists are empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False)


def _open_ranges(window: int):
    """Ranges of starts of windows in which no symbol is decided that occurs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 3):
            windows = batch.column(1).to_numpy() - window + 1
            first = np.concatenate([[0], np.cumsum(windows)])
            row, low = _flat(batch.column(2))
            high, alone = _flat(batch.column(3))[1], ~_flat(batch.column(4))[1].astype(bool)
            begin = np.searchsorted(row, np.arange(batch.num_rows))
            again, place = _flat(batch.column(5))
            alone[begin[again] + place] = False
            shut = np.zeros(first[-1] + 1, np.int64)
            lo, hi = np.maximum(high - window, 0)[alone], np.minimum(low, windows[row] - 1)[alone]
            keep = lo <= hi
            np.add.at(shut, first[row[alone]][keep] + lo[keep], 1)
            np.add.at(shut, first[row[alone]][keep] + hi[keep] + 1, -1)
            clear = np.cumsum(shut)[:-1] == 0
            edge = np.zeros(len(clear) + 1, bool)
            edge[first] = True
            starts = np.flatnonzero(clear & (edge[:-1] | ~np.concatenate([[False], clear[:-1]])))
            stops = np.flatnonzero(clear & (edge[1:] | ~np.concatenate([clear[1:], [False]]))) + 1
            of = np.searchsorted(first, starts, "right") - 1
            held = np.bincount(of, minlength=batch.num_rows)
            some = pa.array(np.flatnonzero(held))
            columns = [batch.column(0), _lists(pa.array((starts - first[of]).astype(np.int32)), held), _lists(pa.array((stops - first[of]).astype(np.int32)), held)]
            yield pa.RecordBatch.from_arrays([c.take(some) for c in columns], ["key", "lo", "hi"])
        trimmed()

    return run


def _window_rows(window: int):
    """Per text: 128 bits of each open window, first places within a slice alone, and the starts ``known`` to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row, lo = _flat(batch.column(2))
            hi = _flat(batch.column(3))[1]
            for block in blocks(batch.column(1), batch.nbytes + 1):
                words = words_of(block)
                mine = (row >= block.first) & (row < block.first + len(block))
                of, begin, n = row[mine] - block.first, lo[mine].astype(np.int64), (hi - lo)[mine].astype(np.int64)
                start = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
                of = np.repeat(of, n)
                at = words.first[of] + start
                one = hash_ranges(words.hash, at, at + window)
                two = hash_ranges(mix(words.hash + _OTHER), at, at + window)
                order = np.lexsort((two, one))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
                group = np.empty(len(order), np.int64)
                group[order] = np.cumsum(fresh) - 1
                often = np.bincount(group, minlength=1)[group] > 1
                first = np.sort(order[fresh])
                rows = pa.StructArray.from_arrays([
                    pa.array(one[first].view(np.int64)), pa.array(two[first].view(np.int64)), pa.array(start[first].astype(np.int32)), pa.array(often[first])
                ], ["one", "two", "start", "many"])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(block.first, len(block)), _lists(rows, np.bincount(of[first], minlength=len(block))),
                    _lists(pa.array(start[often].astype(np.int32)), np.bincount(of[often], minlength=len(block))),
                ], ["key", "rows", "known"])
        trimmed()

    return run


def _removed(window: int):
    """Per text the words that repeated windows cover, and the digest of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            starts = [_flat(batch.column(c)) for c in (2, 3)]
            row, start = (np.concatenate([x[i] for x in starts]) for i in (0, 1))
            order = np.argsort(row, kind="stable")
            row, start = row[order], start[order].astype(np.int64)
            begin = np.searchsorted(row, np.arange(batch.num_rows + 1))
            texts = batch.column(1)
            out = {"n": [], "sha": [], "lo": [], "hi": []}
            for k in range(batch.num_rows):
                words = texts[k].as_buffer().to_pybytes().split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start[begin[k] : begin[k + 1]], 1)
                np.add.at(edge, start[begin[k] : begin[k + 1]] + window, -1)
                gone = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                turns = np.flatnonzero(gone[1:] != gone[:-1])
                out["n"].append(int(gone.sum()))
                out["sha"].append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone[1:-1].tolist(), strict=True) if not g])).digest())
                out["lo"].append(turns[::2].tolist())
                out["hi"].append(turns[1::2].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["sha"], pa.binary()), pa.array(out["lo"], pa.list_(pa.int64())), pa.array(out["hi"], pa.list_(pa.int64()))], ["key", "n_removed", "sha", "lo", "hi"])
        trimmed()

    return run


def _found(docs: DataFrame, window: int) -> DataFrame:
    """``key, n_words, n_removed, sha, lo, hi`` of ``key, text``."""
    spark = docs.sparkSession
    symbols = written(docs.select("key", "text").mapInArrow(_symbols(window), _SYMBOLS), "symbols", "zstd")
    long = symbols.where(F.col("n_words") >= window)
    names = long.select("key", F.explode("names").alias("n")).select("key", "n.*")
    total = F.sum(F.when(F.col("many"), 2).otherwise(1)).over(Window.partitionBy("name"))
    again = names.withColumn("total", total).where("total > 1 and not many").groupBy("key").agg(F.collect_list("place").alias("places"))
    ranges = long.select("key", "n_words", "low", "high", "known").join(again, "key", "left").mapInArrow(_open_ranges(window), "key long, lo array<int>, hi array<int>")
    ranges = written(ranges, "open")
    count, many = ranges.agg(F.count("*"), F.coalesce(F.sum(F.size("lo")), F.lit(0))).first()
    few = count <= BROADCAST_ROWS and many <= BROADCAST_RANGES
    near = written(docs.join(F.broadcast(ranges) if few else ranges, "key").select("key", "text", "lo", "hi"), "near", "zstd")
    remove(spark, ranges)
    windows = near.mapInArrow(_window_rows(window), "key long, rows array<struct<one:long,two:long,start:int,many:boolean>>, known array<int>")
    rows = windows.select("key", F.explode("rows").alias("w")).select("key", "w.*")
    total = F.sum(F.when(F.col("many"), 2).otherwise(1)).over(Window.partitionBy("one", "two"))
    rows = rows.withColumn("total", total).where("total > 1 and not many").select("key", "start", F.lit(None).cast("array<int>").alias("known"))
    marks = rows.unionByName(windows.where(F.size("known") > 0).select("key", F.lit(None).cast("int").alias("start"), "known"))
    marks = marks.groupBy("key").agg(F.collect_list("start").alias("starts"), F.first("known", True).alias("known"))
    told = near.select("key", "text").join(marks, "key").mapInArrow(_removed(window), "key long, n_removed long, sha binary, lo array<long>, hi array<long>")
    told = written(told, "told")
    remove(spark, near)
    out = symbols.select("key", "n_words", F.col("sha").alias("whole")).join(told, "key", "left")
    none = F.array().cast("array<long>")
    return out.select("key", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "whole").alias("sha"), F.coalesce("lo", none).alias("lo"), F.coalesce("hi", none).alias("hi"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, spans`` (word ranges that go).

    A word goes when a window of ``window`` consecutive words of its text covers it whose words, in order and unchanged,
    also start anywhere else, in the same text or another.  Null and empty texts have no words; texts of fewer words than
    a window keep all.  Repeated rows are texts of their own, so both lose what they share; ids may be null, repeated or of
    any type (then rows are numbered in a table first).  Texts may be of any length, one at a time is held whole.  An empty
    table gives none; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows, table = _keyed(docs, id_col, text_col)
    out = _found(rows, window)
    out = out.withColumnRenamed("key", "doc_id") if table is None else out.join(table.select("key", F.col("id").alias("doc_id")), "key")
    return out.select("doc_id", "n_words", "n_removed", F.lower(F.hex("sha")).alias("kept_sha256"), F.arrays_zip("lo", "hi").alias("spans"))


def without_passages(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, with the words that stay in the text, joined by one space.

    Texts that lose nothing stay as they are, null ones too.
    """
    bounded_batches(docs.sparkSession)
    table = written(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), "rows", "zstd")
    spans = _found(table.select("key", F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).alias("text")), window).where("n_removed > 0").select("key", "lo", "hi")
    text = F.col(f"row.`{text_col}`")
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    kept = F.filter(words, lambda w, i: ~F.exists(F.arrays_zip("lo", "hi"), lambda s: (s["lo"] <= i) & (i < s["hi"])))
    rows = table.join(spans, "key", "left")
    return rows.select(F.col("row").withField(f"`{text_col}`", F.when(F.col("lo").isNull(), text).otherwise(F.array_join(kept, " "))).alias("row")).select("row.*")


#: Windows as texts, for tables of any number of documents that DuckDB holds.
ORACLE = r"""
with d as (
  select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), p as (
  select k, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35
), h as (
  select k, i, md5(array_to_string(w[i:i + 34], ' ')) as h from p join d using (k)
), r as (
  select k, i, count(*) over (partition by h) as c from h
), g as (
  select distinct k, unnest(range(i, i + 35)) as i from r where c > 1
), l as (
  select k, list(i order by i) as gone from g group by k
)
select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(array_to_string(case when gone is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i)), lambda i: w[i]) end, ' ')) as kept_sha256
from d left join l using (k)
"""
