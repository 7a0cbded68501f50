"""Online forms: event-time windows, gates on micro-batches, ring buffers and online clustering as keyed state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ahsc import StreamClusters
from ..operators.detectors import Detector


def windowed_counts(events: DataFrame, channels: list[str], every: str = "1 hour", late: str = "2 hours", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts per event-time window and channel, for streams and tables; rows later than ``late`` are dropped by a stream."""
    at = F.col(ts).cast("timestamp")
    counted = events.withColumn(ts, at).withWatermark(ts, late).groupBy(F.window(ts, every))
    out = counted.agg(*[F.count(F.when(F.col(kind) == c, 1)).cast("double").alias(c) for c in channels])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *channels)


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Events of each session of a key: a session ends after ``gap`` without an event."""
    at = F.col(ts).cast("timestamp")
    out = events.withColumn(ts, at).withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("events"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def trailing_stats(rows: DataFrame, capacity: int, value: str = "value", key: str = "stream_id") -> DataFrame:
    """For each row of a stream (``key, t, value``) the number and sum of the last ``capacity`` values of its key.

    The ring buffer is keyed state; within a micro-batch the rows of a key are taken in order of ``t``.
    """
    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(json.loads(state.get[0])) if state.exists else []
        batch = pd.concat(list(frames)).sort_values("t")
        out = []
        for t, v in zip(batch["t"], batch[value], strict=True):
            held = [*held, float(v)][-capacity:]
            out.append((name[0], int(t), len(held), float(np.sum(held))))
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=[key, "t", "n", "total"])

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} string, t long, n long, total double", "held string", "append", GroupStateTimeout.NoTimeout)


def cluster_scores(rows: DataFrame, channels: list[str], model: StreamClusters, key: str = "stream_id") -> DataFrame:
    """Outlier scores of stream rows by a fitted clustering, row by row without state."""
    schema = rows.select(key, "t").withColumn("score", F.lit(0.0)).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[[key, "t"]].assign(score=model.scores(f[channels].to_numpy(float)))

    return rows.select(key, "t", *channels).mapInPandas(run, schema)


def gate_batches(detector: Detector, policy, sink: Callable[[DataFrame, int], None], tier: str = "standard") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch holds whole windows (``stage``), which are scored and decided."""
    def run(batch: DataFrame, epoch: int) -> None:
        sink(policy.evaluate(detector.results(batch), tier), epoch)

    return run
