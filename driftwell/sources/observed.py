"""Where a deployment's windows come from: a table, or a function of the stage."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.errors import SignalError
from ..plans.rollout import Stage


class SignalSource(Protocol):
    """Gives the window that a stage observes, as wide rows; a ``stage`` column is set anew."""

    def observe(self, stage: Stage) -> DataFrame: ...


class StaticSource:
    """Windows of a table by ``stage``; stages beyond the last see the last."""

    def __init__(self, windows: DataFrame) -> None:
        self.windows = windows

    def observe(self, stage: Stage) -> DataFrame:
        last = self.windows.agg(F.max("stage").alias("__last"))
        return self.windows.join(F.broadcast(last), F.col("stage") == F.least(F.lit(stage.index), "__last")).drop("__last")


class CallableSource:
    """A function from stages to windows."""

    def __init__(self, fn: Callable[[Stage], DataFrame]) -> None:
        self.fn = fn

    def observe(self, stage: Stage) -> DataFrame:
        return self.fn(stage)


def windows_of(source: DataFrame | SignalSource, stages: list[Stage]) -> DataFrame:
    """One table of the windows of all stages, which are then scored in one plan."""
    if isinstance(source, DataFrame):
        return source
    if not stages:
        raise SignalError("there is no stage to observe")
    out = None
    for stage in stages:
        one = source.observe(stage).withColumn("stage", F.lit(stage.index))
        out = one if out is None else out.unionByName(one)
    return out
