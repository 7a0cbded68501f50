"""Sinks: tables that replace another safely, result lines, event logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside a table, then swaps the folders, so that a plan may read what it replaces."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    df.write.parquet(new)
    of = jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(conf)
    if fs.exists(of(path)):
        fs.rename(of(path), of(old))
    fs.rename(of(new), of(path))
    fs.delete(of(old), True)


def append_results(spark: SparkSession, path: str, **values) -> None:
    """A line ``name=value, ...`` appended to a folder of text."""
    line = ", ".join(f"{k}={v}" for k, v in values.items())
    spark.createDataFrame([(line,)], "value string").write.mode("append").text(path)


def write_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def console_lines(events: DataFrame) -> DataFrame:
    """Events as lines, a row each."""
    stage = F.when(F.col("stage").isNotNull(), F.concat(F.lit("["), F.col("stage"), F.lit("] "))).otherwise("")
    return events.orderBy("seq").select(F.concat(F.date_format(F.timestamp_seconds("timestamp"), "HH:mm:ss"), F.lit(" "), F.rpad("kind", 22, " "), F.lit(" "), stage, F.col("message")).alias("line"))
