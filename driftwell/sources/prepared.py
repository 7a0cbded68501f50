"""The benchmark datasets as one prepared table: ``entity, part, t, ts, x, label``.

``part`` is ``init`` (training, label 0) or ``test``; ``x`` holds the channels in order.  Where a dataset has no clock,
rows are a minute apart: the first entity's training rows begin at START, its test rows at its last training row, and the
next entity's training rows there too, so that the clocks of training and test rows overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key
from .datasets import attack_clock, csv_lines, csv_series, labelled_intervals, npy_series

SCHEMA = "entity string, part string, t long, ts timestamp_ntz, x array<double>, label int"
START = "2024-01-01 00:00:00"
#: Channels of the spacecraft datasets, and rows that the water treatment dataset drops at the start.
WIDTHS = {"SMAP": 25, "MSL": 55}
SETTLING = 100_000


def chained(init: DataFrame, test: DataFrame, start: str = START, order: str = "name") -> DataFrame:
    """``init`` and ``test`` (``entity, t, x, label``, and ``order`` if it is no name) on one clock."""
    key = natural_key(F.col("entity")) if order == "name" else F.col(order)
    length = init.groupBy("entity", key.alias("__key")).agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)  # a row for each entity
    clock = length.select("entity", "__n", F.coalesce(F.sum(F.col("__n") - 1).over(earlier), F.lit(0)).alias("__from"))
    parts = [init.select("entity", F.lit("init").alias("part"), "t", "x", "label"), test.select("entity", F.lit("test").alias("part"), "t", "x", "label")]
    rows = parts[0].unionByName(parts[1]).join(clock, "entity")
    minute = F.col("__from") + F.col("t") + F.when(F.col("part") == "test", F.col("__n") - 1).otherwise(0)
    ts = F.timestamp_add("MINUTE", minute.cast("int"), F.lit(start).cast("timestamp_ntz"))
    return rows.select("entity", "part", "t", ts.alias("ts"), "x", "label")


def _vector(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("entity", "t", F.array(*columns).alias("x"))


def server_metrics(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """One table in ``train.csv``, ``test.csv``, ``test_label.csv`` with a header and a first column that is a stamp."""
    named = lambda df: df.withColumn("entity", F.lit("0"))
    read = lambda name, cols: named(csv_series(spark, f"{folder}/{name}.csv", cols, header=True, drop_first=True))
    label = read("test_label", ["label"]).select("entity", "t", F.col("label").cast("int").alias("label"))
    test = _vector(read("test", columns), columns).join(label, ["entity", "t"])
    return chained(_vector(read("train", columns), columns).withColumn("label", F.lit(0)), test)


def machines(spark: SparkSession, folder: str, width: int = 38) -> DataFrame:
    """A file without a header for each machine in ``train``, ``test`` and ``test_label``."""
    columns = [f"c{i}" for i in range(width)]
    read = lambda part, cols: csv_series(spark, f"{folder}/{part}", cols, header=False)
    label = read("test_label", ["label"]).select("entity", "t", F.col("label").cast("int").alias("label"))
    test = _vector(read("test", columns), columns).join(label, ["entity", "t"])
    return chained(_vector(read("train", columns), columns).withColumn("label", F.lit(0)), test)


def spacecraft(spark: SparkSession, folder: str, name: str, widths: dict[str, int] = WIDTHS) -> DataFrame:
    """Channels of a spacecraft: ``train`` and ``test`` matrices, and ``labeled_anomalies.csv`` with the intervals.

    Channels stand on the clock in the order of the list.  It is an error if a matrix has other channels than the
    spacecraft, or a test matrix other rows than the list says.
    """
    listed = csv_lines(spark, f"{folder}/labeled_anomalies.csv", ["chan_id", "spacecraft", "anomaly_sequences", "class", "num_values"], skip=1)
    listed = listed.where(F.col("spacecraft") == name).select("chan_id", "anomaly_sequences", F.col("num_values").cast("long").alias("num_values"), F.col("t").alias("place"))
    chosen = F.broadcast(listed.select(F.col("chan_id").alias("entity"), "place", "num_values"))
    read = lambda part: npy_series(spark, f"{folder}/{part}", widths[name], listed.select("chan_id")).join(chosen, "entity")
    label = labelled_intervals(listed).select(F.col("chan_id").alias("entity"), "t", "label")
    test = read("test")
    rows = F.max("t").over(Window.partitionBy("entity")) + 1
    test = test.withColumn("t", F.when(rows == F.col("num_values"), F.col("t")).otherwise(F.raise_error(F.concat("entity", F.lit(": other rows than the list says")))))
    return chained(read("train").withColumn("label", F.lit(0)), test.join(label, ["entity", "t"]), order="place")


def water_treatment(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """``SWaT_Dataset_Normal_v1.csv`` and ``SWaT_Dataset_Attack_v0.csv``: a line above the header, a clock in the first
    column, a verdict in the last; any verdict but ``Normal`` is an attack."""
    def read(name: str, part: str) -> DataFrame:
        rows = csv_lines(spark, f"{folder}/{name}.csv", ["Timestamp", *columns, "verdict"], skip=2)
        label = F.lit(0) if part == "init" else (F.col("verdict") != "Normal").cast("int")
        values = F.array(*[F.expr(f"try_cast(`{c}` as double)") for c in columns])
        return rows.select(F.lit("0").alias("entity"), F.lit(part).alias("part"), "t", attack_clock().alias("ts"), values.alias("x"), label.alias("label"))

    return read("SWaT_Dataset_Normal_v1", "init").unionByName(read("SWaT_Dataset_Attack_v0", "test"))


def without_settling(prepared: DataFrame, rows: int = SETTLING) -> DataFrame:
    """The training rows without the first ``rows`` of each entity; ``t`` counts on."""
    return prepared.where((F.col("part") != "init") | (F.col("t") >= rows))


def scaled(prepared: DataFrame, width: int, first_only: bool = False) -> DataFrame:
    """``x`` standardised by the training rows of all entities; with ``first_only`` the first channel alone.

    A channel without spread keeps its scale; NaN and null become 0.
    """
    used = range(1 if first_only else width)
    at = lambda i: F.get("x", F.lit(i))
    row = prepared.where("part = 'init'").agg(*[f(at(i)).alias(f"{k}{i}") for i in used for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    fit = {i: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i in used}
    scale = lambda i: F.coalesce(F.nanvl((at(i) - fit[i][0]) / fit[i][1], F.lit(0.0)), F.lit(0.0))
    return prepared.withColumn("x", F.array(*[scale(i) if i in fit else at(i) for i in range(width)]))
