"""Readers of the benchmark datasets, event vectors and SQL dumps."""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.order import numbered
from ..functions.text import natural_key
from ..functions.tiles import tiled
from ..session import kept, keyed, workers_find_package
from . import matrices

#: Rows of a matrix that a task reads at a time, tasks at most, and stores of which workers can read a range of a file.
MATRIX_ROWS, MATRIX_TASKS = 1 << 16, 10_000
RANGED = ("file", "hdfs", "s3", "s3a", "gs")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``entity`` (file name), ``t, value``: the lines of text files numbered from 0 in each file.

    A file is read in splits by many tasks.  A line's number is its place in its split plus the lines of the splits before
    it in the file; only counts of splits meet in one window.
    """
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("__at"), "value")
    split = ["file_path", "file_block_start"]
    counts = lines.groupBy(*split).agg(F.min("__at").alias("__first"), F.count("*").alias("n"))
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*split, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    entity = F.element_at(F.split(F.col("file_path"), "/"), -1)
    return lines.join(starts, split).select(entity.alias("entity"), (F.col("__at") + F.col("__shift")).alias("t"), "value")


def csv_series(spark: SparkSession, path: str, columns: list[str], header: bool, drop_first: bool = False, skip: int = 0) -> DataFrame:
    """Rows of CSV files in file order: ``entity`` (file name), ``t`` and double columns; ``skip`` rows at the top go."""
    rows = csv_lines(spark, path, (["__first"] if drop_first else []) + columns, skip + int(header))
    return rows.select("entity", "t", *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in columns])


def csv_lines(spark: SparkSession, path: str, columns: list[str], skip: int = 0) -> DataFrame:
    """``entity`` (file name), ``t`` and text columns of CSV files in the order of their lines, without the ``skip`` first;
    quoted cells may hold commas, cells are trimmed."""
    lines = text_lines(spark, path).where(F.col("t") >= skip)
    schema = ", ".join(f"`{c}` string" for c in columns)
    cells = F.from_csv("value", schema, {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return lines.select("entity", (F.col("t") - skip).alias("t"), cells.alias("__c")).select("entity", "t", "__c.*")


def minute_clock(df: DataFrame, start: str, by: str = "entity") -> DataFrame:
    """A timestamp for each row, one minute apart from ``start``."""
    return df.withColumn("ts", F.timestamp_add("MINUTE", F.col("t").cast("int"), F.lit(start).cast("timestamp_ntz")))


def attack_labels(text: str = "Normal/Attack"):
    return F.when(F.trim(F.col(text)) != "Normal", 1).otherwise(0)


def attack_clock(text: str = "Timestamp"):
    return F.to_timestamp_ntz(F.trim(F.col(text)), F.lit("d/M/yyyy h:mm:ss a"))


def npy_series(spark: SparkSession, path: str, width: int, chosen: DataFrame | None = None, rows: int = MATRIX_ROWS) -> DataFrame:
    """Matrices of ``.npy`` files: ``entity`` (file name without its ending), ``t, x``.  Of ``chosen`` (a table of one
    column) only the files that it names are read.

    A file is cut into ranges of ``rows`` rows, which many tasks read; files of a store that only Spark can open are read
    whole, a file by one task.
    """
    workers_find_package(spark)
    files = spark.read.format("binaryFile").load(path)
    if chosen is not None:
        name = F.regexp_extract("path", r"([^/]*)\.npy$", 1)
        files = files.join(chosen.toDF("__name"), name == F.col("__name"), "left_semi")
    scheme = F.regexp_extract("path", r"^([a-z0-9]+):", 1)
    schema = "entity string, t long, x array<double>"
    ranged = files.select("path").where(scheme.isin(*RANGED)).mapInArrow(lambda b: matrices.ranges(b, width, rows), "path string, first long, rows long, about string")
    ranged = kept(ranged)
    ranged = ranged.repartition(max(1, min(ranged.count(), MATRIX_TASKS)), "path", "first").mapInArrow(matrices.read_ranges, schema)
    whole = files.select("path", "content").where(~scheme.isin(*RANGED)).mapInArrow(lambda b: matrices.read_whole(b, width), schema)
    return ranged.unionByName(whole)


def labelled_intervals(df: DataFrame, intervals: str = "anomaly_sequences", n: str = "num_values") -> DataFrame:
    """``chan_id, t, label`` from texts such as ``[[3, 5], [9, 12]]``; the stop of an interval is not part of it."""
    pairs = F.transform(F.regexp_extract_all(F.col(intervals), F.lit(r"\[\s*\d+\s*,\s*\d+\s*\]"), F.lit(0)), lambda p: F.struct(
        F.regexp_extract(p, r"\[\s*(\d+)", 1).cast("long").alias("a"), F.regexp_extract(p, r",\s*(\d+)", 1).cast("long").alias("b")
    ))
    rows = df.select("chan_id", pairs.alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)).alias("t"))
    return rows.select("chan_id", "t", F.exists("p", lambda p: (F.col("t") >= p["a"]) & (F.col("t") < p["b"])).cast("int").alias("label"))


def outliers_clamped(df: DataFrame, column: str, by: list[str], threshold: float = 3.0, width: int = 1441) -> DataFrame:
    """Values above the local mean by ``threshold`` deviations become that mean (windows of the given values)."""
    tiles = tiled(df, by, "t", width // 2, width // 2)
    w = tiles.window.rowsBetween(-(width // 2), width // 2)
    mean, std = F.avg(column).over(w), F.stddev_pop(column).over(w)
    return tiles.own(tiles.rows.withColumn(column, F.when(F.col(column) - mean > threshold * std, mean).otherwise(F.col(column))))


def clamped(values: Iterator[float], threshold: float, half: int) -> Iterator[float]:
    """Each value, or the mean of the ``2 * half + 1`` values around it where it is above that by ``threshold`` deviations;
    values before it are taken as they were clamped.  Holds those values and their sums, summed anew once in a window."""
    held: deque[float] = deque()
    total = square = 0.0
    ahead, done = 0, 0  # values after the current one, and values before it

    def mended() -> float:
        nonlocal total, square
        x, n = held[done], len(held)
        mean = total / n
        std = math.sqrt(max(square / n - mean * mean, 0.0))
        if abs(x - mean - threshold * std) <= 1e-6 * (abs(x) + abs(mean)):  # too near for running sums
            mean = math.fsum(held) / n
            std = math.sqrt(math.fsum((v - mean) ** 2 for v in held) / n)
        if x - mean > threshold * std:
            held[done] = mean
            total += mean - x
            square += mean * mean - x * x
        return held[done]

    count = 0
    for v in values:
        held.append(v)
        total += v
        square += v * v
        ahead += 1
        if ahead <= half:
            continue
        yield mended()
        ahead -= 1
        done += 1
        count += 1
        if done > half:
            x = held.popleft()
            done -= 1
            total -= x
            square -= x * x
        if count % (2 * half + 1) == 0:
            total, square = math.fsum(held), math.fsum(x * x for x in held)
    while ahead:
        yield mended()
        ahead -= 1
        done += 1
        if done > half:
            x = held.popleft()
            done -= 1
            total -= x
            square -= x * x


def outliers_clamped_in_turn(df: DataFrame, column: str, by: list[str], order: str = "t", threshold: float = 3.0, width: int = 1441) -> DataFrame:
    """``by, order, column`` with outliers clamped one after another: a window sees the values before its middle as they
    were clamped, so a series is a fold in its order, many series in parallel.

    A task holds ``width`` values of one series.  Null and NaN count as 0 in a window and stay what they are.
    """
    workers_find_package(df.sparkSession)
    rows = df.select(*by, order, F.col(column).cast("double").alias(column))
    rows = keyed(rows, *by).sortWithinPartitions(*by, order)
    half, names = width // 2, [*by, order, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[tuple] = deque()  # keys of rows whose values are still to come

        rows_in = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        row = next(rows_in, None)
        out: list[tuple] = []
        while row is not None:
            key = row[: len(by)]

            def series(first, key=key):
                nonlocal row
                row = first
                while row is not None and row[: len(by)] == key:
                    waiting.append(row)
                    yield 0.0 if row[-1] is None or row[-1] != row[-1] else row[-1]
                    row = next(rows_in, None)

            for value in clamped(series(row), threshold, half):
                was = waiting.popleft()
                out.append((*was[:-1], value if was[-1] is not None and was[-1] == was[-1] else was[-1]))
                if len(out) == 4096:
                    yield _batch(out, names, types)
                    out = []
        if out:
            yield _batch(out, names, types)

    types = [f.type for f in rows.limit(0).toArrow().schema]
    return rows.mapInArrow(run, rows.schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def binary_vector(spark: SparkSession, path: str) -> DataFrame:
    """``series_id`` (file), ``t, flag`` of files (gzip too) with a 0 or 1 on each line."""
    lines = text_lines(spark, path).select("entity", "t", F.nullif(F.trim("value"), F.lit("")).cast("int").alias("flag")).where("flag is not null")
    rows = numbered(lines, "n", F.col("t"), by=["entity"])  # blank lines do not count
    return rows.select(F.col("entity").alias("series_id"), (F.col("n") - 1).alias("t"), "flag")


def entities(df: DataFrame, chosen: str = "all") -> DataFrame:
    """The entities of a list such as ``1,2,5`` (places in natural order of their names, from 1), or all."""
    if chosen == "all":
        return df
    names = df.select("entity").distinct().withColumn("place", F.row_number().over(Window.orderBy(natural_key(F.col("entity")))))
    return df.join(names.where(F.col("place").isin([int(x) for x in chosen.split(",")])).select("entity"), "entity", "left_semi")


def dump_rows(sql: str, table: str) -> list[tuple]:
    """The value tuples of a table's INSERT statements in a dump; quotes, escapes and NULL are read."""
    out: list[tuple] = []
    for m in re.finditer(rf"INSERT INTO `{re.escape(table)}`[^;]*?VALUES\s*", sql, re.I):
        at, row, cell, quoted, was = m.end(), None, "", False, False
        while at < len(sql):
            c = sql[at]
            if quoted:
                if c == "\\" and at + 1 < len(sql):
                    at += 1
                    cell += sql[at]
                elif c == "'" and sql[at + 1 : at + 2] == "'":
                    at += 1
                    cell += "'"
                elif c == "'":
                    quoted = False
                else:
                    cell += c
            elif c == "'":
                quoted = was = True
            elif c == "(" and row is None:
                row, cell, was = [], "", False
            elif c in ",)" and row is not None:
                row.append(cell if was else None if cell.strip().upper() == "NULL" else cell.strip())
                cell, was = "", False
                if c == ")":
                    out.append(tuple(row))
                    row = None
            elif c == ";":
                break
            elif row is not None:
                cell += c
            at += 1
    return out


def dump_table(spark: SparkSession, sql: str, table: str, schema: str) -> DataFrame:
    """A table of a dump, its text cells cast to ``schema``."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    raw = spark.createDataFrame(dump_rows(sql, table), ", ".join(f"{n} string" for n, _ in fields))
    return raw.select(*[F.col(n).cast(t).alias(n) for n, t in fields])
