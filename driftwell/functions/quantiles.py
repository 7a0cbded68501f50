"""Exact quantiles of any number of rows: counted by ranges of values, of which only those that hold a wanted rank are
looked into."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import RANGE_ROWS, ranged


def quantiles(df: DataFrame, columns: list[str], qs: list[float], by: list[str] | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """``by, channel, quantiles`` (an array along ``qs``), interpolated linearly between neighbouring ranks.

    Nulls are left out; NaN is above all numbers; a series (or a column) without values has no row.  All columns and series
    are done at once: cut points from a sample deal the values to ranges, the counts of the ranges say where each wanted
    rank lies, and the values of these ranges alone are shuffled, summed by value first, so ties of any number are one row.
    """
    by = by or []
    values = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(*by, F.explode(values).alias("v")).select(*by, "v.channel", (F.col("v.x") + F.lit(0.0)).alias("x")).where("x is not null")
    key = [*by, "channel"]
    placed = ranged(long, *map(F.col, key), F.col("x"), rows=rows).select(*key, "x", F.col("__cell").alias("cell"))
    counts = placed.groupBy(*key, "cell").agg(F.count("*").alias("n"))
    along, whole = Window.partitionBy(*key).orderBy("cell"), Window.partitionBy(*key)
    counts = counts.withColumn("before", F.sum("n").over(along) - F.col("n")).withColumn("all", F.sum("n").over(whole))
    # ranks from 0 that quantile i lies between, those in this cell alone
    def ranks(q, i):
        at = (F.col("all") - 1) * q
        share = at - F.floor(at)
        named = lambda rank, share: F.struct(i.alias("i"), rank.cast("long").alias("rank"), share.alias("share"))
        return F.array(named(F.floor(at), 1 - share), named(F.floor(at) + 1, share))

    wanted = F.flatten(F.transform(F.array(*[F.lit(float(q)) for q in qs]), ranks))
    here = F.filter(wanted, lambda r: (r["share"] > 0) & (r["rank"] >= F.col("before")) & (r["rank"] < F.col("before") + F.col("n")))
    cells = counts.select(*key, "cell", "before", here.alias("wanted")).where(F.size("wanted") > 0)
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*key, "cell")]
    near = placed.alias("p").join(cells.select(*key, "cell").alias("c"), same, "left_semi").groupBy(*key, "cell", "x").agg(F.count("*").alias("m"))
    upto = Window.partitionBy(*key, "cell").orderBy("x")
    near = near.withColumn("stop", F.sum("m").over(upto))
    found = near.alias("p").join(cells.alias("c"), same).select(*[F.col(f"p.{c}").alias(c) for c in key], "x", F.explode(
        F.filter("wanted", lambda r: (r["rank"] - F.col("before") < F.col("stop")) & (r["rank"] - F.col("before") >= F.col("stop") - F.col("m")))
    ).alias("r"))
    # the share of a rank times its value, lower rank first; a single rank gives its value as it is
    each = found.groupBy(*key, F.col("r.i").alias("i")).agg(F.array_sort(F.collect_list(F.struct("r.rank", "x", "r.share"))).alias("two"))
    value = F.when(F.size("two") == 1, F.col("two")[0]["x"]).otherwise(F.col("two")[0]["x"] * F.col("two")[0]["share"] + F.get("two", F.lit(1))["x"] * F.get("two", F.lit(1))["share"])
    return each.select(*key, "i", value.alias("x")).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("quantiles"))


def quantile_values(df: DataFrame, columns: list[str], qs: list[float], rows: int = RANGE_ROWS) -> dict[str, list[float]]:
    """Quantiles of whole columns on the driver, a list for each column that has values."""
    return {r["channel"]: list(r["quantiles"]) for r in quantiles(df, columns, qs, rows=rows).collect()}
