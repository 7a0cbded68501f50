"""Root causes: ranked channels of window attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent
from .signals import KEYS


def ranked(results: DataFrame, channels: list[str], top_k: int = 3) -> DataFrame:
    """``stream_id, stage, rank, channel, weight``: the heaviest channels first, ties in channel order; 0 or less: all."""
    parts = results.select(*KEYS, F.posexplode(F.array(*[F.struct(F.lit(c).alias("channel"), F.element_at("attribution", F.lit(c)).alias("weight")) for c in channels])).alias("ix", "p"))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("p.weight").desc(), "ix"))
    out = parts.select(*KEYS, rank.alias("rank"), F.col("p.channel").alias("channel"), F.col("p.weight").alias("weight"))
    return out if top_k <= 0 else out.where(F.col("rank") <= top_k)


def summary(ranking: DataFrame) -> DataFrame:
    """``channel (share), ...`` of each window."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "channel", "weight"))), lambda p: F.concat(p["channel"], F.lit(" ("), percent(p["weight"]), F.lit(")")))
    return ranking.groupBy(*KEYS).agg(F.array_join(parts, ", ").alias("root_cause"))


def aggregate(results: DataFrame, channels: list[str], by: list[str]) -> DataFrame:
    """Attributions of several windows summed and brought to a sum of 1 (left as they are where they sum to 0)."""
    sums = results.groupBy(*by).agg(*[F.sum(F.element_at("attribution", F.lit(c))).alias(c) for c in channels])
    total = sum((F.col(c) for c in channels[1:]), F.col(channels[0]))
    return sums.select(*by, *[F.when(total > 0, F.col(c) / total).otherwise(F.col(c)).alias(c) for c in channels])
