"""Ranges of a global order, numbers and running sums along it, by many tasks.

Rows are dealt to ranges of the order by cut points from a small sample, counted or summed by range, and each range is
numbered on from those before it.  Only the ranges pass through one task; their number follows the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, ranges at most (above, ranges grow), and cells of a range, of which each has a sampled key as its end.
RANGE_ROWS, MOST_RANGES, CELLS = 1 << 16, 1 << 14, 16


def _sampled(keys: DataFrame, rows: int, ranges: int | None) -> DataFrame | None:
    """One row with ``__cuts``, the sorted keys of a sample of about CELLS for each range; None for one range.

    The sample is taken once and its keys are then constants of the plan: at most some 300,000.
    """
    n = keys.count()
    ranges = ranges or min(MOST_RANGES, math.ceil(n / rows))
    if ranges <= 1:
        return None
    few = keys.sample(fraction=min(1.0, ranges * CELLS / max(n, 1)), seed=7)
    row = few.agg(F.sort_array(F.collect_list("__key")).alias("__cuts"))
    return keys.sparkSession.createDataFrame(row.collect(), row.schema)


def _below(cuts: str, key: str) -> Column:
    """How many of the sorted ``cuts`` are below ``key``, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in range((MOST_RANGES * CELLS * 2).bit_length(), -1, -1)])
    further = lambda at, step: F.coalesce((at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) < F.col(key)), F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def ranged(df: DataFrame, *order: Column, rows: int = RANGE_ROWS, ranges: int | None = None) -> DataFrame:
    """``df`` with ``__key`` (the order as a struct), ``__cell`` and ``__range``, which do not fall along it.

    There is a range for every ``rows`` rows (or ``ranges`` ranges).  Equal keys share a cell; CELLS cells make a range.
    """
    return placed(df, *order, rows=rows, ranges=ranges)[0]


def placed(df: DataFrame, *order: Column, rows: int = RANGE_ROWS, ranges: int | None = None) -> tuple[DataFrame, bool]:
    """``ranged``, and whether all rows are in one range."""
    keyed = df.withColumn("__key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    cuts = _sampled(keyed.select("__key"), rows, ranges)
    if cuts is None:
        return keyed.withColumns({"__cell": F.lit(0), "__range": F.lit(0)}), True
    cells = keyed.join(F.broadcast(cuts)).withColumn("__cell", _below("__cuts", "__key")).drop("__cuts")  # one row
    return cells.withColumn("__range", (F.col("__cell") / CELLS).cast("int")), False


def _earlier(totals: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """For each range the sums of the ranges before it; as many rows as there are ranges (of a series)."""
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return dealt(totals.select(*by, "__range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__before_{n}") for n in names]), by)


def dealt(ends: DataFrame, by: list[str]) -> DataFrame:
    """A table of ranges, made in the order of its series, ready to be joined to the rows without gathering them there.

    Ranges of one order are MOST_RANGES at most and are broadcast; those of many series are dealt as the rows are.
    """
    return ends.repartition(*by, "__range") if by else F.broadcast(ends)


def numbered(df: DataFrame, name: str, *order: Column, by: list[str] | None = None, rows: int = RANGE_ROWS, ranges: int | None = None) -> DataFrame:
    """Rows numbered from 1 in an order, or in that of each series ``by``; rows that the order does not tell apart are
    numbered in any order, by one task."""
    by = by or []
    rows_of, single = placed(df, *map(F.col, by), *order, rows=rows, ranges=ranges)
    if single:
        return rows_of.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("__key")).cast("long")).select(*df.columns, name)
    first = _earlier(rows_of.groupBy(*by, "__range").agg(F.count("*").alias("n")), ["n"], by)
    place = F.row_number().over(Window.partitionBy(*by, "__range").orderBy("__key"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "__range")]
    out = rows_of.withColumn("__place", place).alias("a").join(first.alias("b"), [*same], "inner")
    return out.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("__before_n") + F.col("__place")).cast("long").alias(name))


def running(df: DataFrame, sums: dict[str, str], *order: Column, rows: int = RANGE_ROWS, ranges: int | None = None) -> DataFrame:
    """Adds running sums (new name -> column) along an order with no two equal keys, each row's own value included."""
    rows_of, single = placed(df, *order, rows=rows, ranges=ranges)
    if single:
        whole = Window.orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
        return rows_of.withColumns({n: F.sum(c).over(whole) for n, c in sums.items()}).select(*df.columns, *sums)
    first = _earlier(rows_of.groupBy("__range").agg(*[F.sum(c).alias(n) for n, c in sums.items()]), list(sums), [])
    upto = Window.partitionBy("__range").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
    out = rows_of.withColumns({f"__own_{n}": F.sum(c).over(upto) for n, c in sums.items()}).join(first, "__range")
    return out.select(*df.columns, *[(F.col(f"__before_{n}") + F.col(f"__own_{n}")).alias(n) for n in sums])
