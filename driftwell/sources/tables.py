"""Schemas of the pin-board application's ten tables, and views of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

#: Names and columns of the tables.
SCHEMAS = {
    "category": "cat_name string",
    "comment": "commentID long, email string, added_time timestamp_ntz, content string, pushPinID long",
    "corkboard": "corkBoardID long, email string, cat_name string, title string, last_update timestamp_ntz",
    "follow": "followID long, email string, owner_email string",
    "likes": "LikesID long, email string, pushPinID long",
    "privatecorkboard": "corkBoardID long, last_update timestamp_ntz, password string",
    "pushpin": "pushPinID long, corkBoardID long, image_URL string, description string, pinned_time timestamp_ntz",
    "tag": "tagID long, pushPinID long, tag string",
    "user": "userID long, email string, pin string, name string",
    "watch": "WatchID long, email string, corkBoardID long",
}


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    """Every table without rows."""
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def create(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Makes the tables that a folder does not hold yet, without rows, and returns all of them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, df in empty(spark).items():
        where = path(f"{folder}/{name}")
        if not where.getFileSystem(conf).exists(where):
            df.write.parquet(f"{folder}/{name}")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()}


#: Rows of a table that a connection reads, and connections at a time.
CONNECTION_ROWS, CONNECTIONS = 1_000_000, 64


def database_table(spark: SparkSession, url: str, name: str, key: str | None, properties: dict[str, str] | None = None, rows: int = CONNECTION_ROWS, most: int = CONNECTIONS) -> DataFrame:
    """A table by JDBC, read by ranges of its integer ``key`` at several connections.

    The database tells the least and greatest key and the rows (one row of answer); a connection reads ``rows`` rows or so,
    more where ``most`` connections do not suffice.  Null keys are read with the first range.  Without a key, or with few
    rows, one connection reads all.
    """
    properties = properties or {}
    if key is None:
        return spark.read.jdbc(url, name, properties=properties)
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    told = spark.read.jdbc(url, f"(SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi, COUNT(*) AS n FROM {name}) bounds", properties=properties).first()
    lo, hi, n = told
    parts = min(most, math.ceil(n / rows))
    if parts < 2 or lo is None:
        return spark.read.jdbc(url, name, properties=properties)
    return spark.read.jdbc(url, name, column=key, lowerBound=int(lo), upperBound=int(hi) + 1, numPartitions=parts, properties=properties)


def from_database(spark: SparkSession, url: str, properties: dict[str, str] | None = None, rows: int = CONNECTION_ROWS, most: int = CONNECTIONS) -> dict[str, DataFrame]:
    """The tables of a database by JDBC, cast to SCHEMAS, those with an integer column by ranges of their first one; the
    database's driver must be on the class path."""
    out = {}
    for name, schema in SCHEMAS.items():
        fields = [c.split() for c in schema.split(", ")]
        key = next((c for c, kind in fields if kind in ("int", "long", "bigint")), None)
        raw = database_table(spark, url, name, key, properties, rows, most)
        out[name] = raw.select(*[raw[c].cast(kind) for c, kind in fields])
    return out


def views(tables: dict[str, DataFrame]) -> None:
    """Temporary views with the tables' names, for SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
