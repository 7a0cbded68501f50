"""Rollout strategies: the stages that a candidate goes through."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigError
from .registry import ROLLOUTS


@dataclass(frozen=True)
class Stage:
    name: str
    exposure: float
    index: int
    region: str | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.exposure <= 1:
            raise ValueError("exposure must be between 0 and 1")


def _share(p: float) -> str:
    return f"{int(p * 100)}%"


@ROLLOUTS.register("percentage")
@dataclass
class PercentageRollout:
    steps: tuple[float, ...] = (0.1, 0.25, 0.5, 1.0)

    def stages(self) -> list[Stage]:
        return [Stage(_share(p), p, i) for i, p in enumerate(self.steps)]


@ROLLOUTS.register("canary")
@dataclass
class CanaryRollout:
    canary: float = 0.01
    steps: tuple[float, ...] = (0.05, 0.25, 0.5, 1.0)

    def stages(self) -> list[Stage]:
        return [Stage("canary", self.canary, 0), *(Stage(_share(p), p, i) for i, p in enumerate(self.steps, 1))]


@ROLLOUTS.register("regional")
@dataclass
class RegionalRollout:
    regions: tuple[str, ...] = ("us-east", "us-west", "eu", "apac")

    def stages(self) -> list[Stage]:
        if not self.regions:
            raise ConfigError("a regional rollout needs regions")
        return [Stage(r, (i + 1) / len(self.regions), i, r) for i, r in enumerate(self.regions)]


@ROLLOUTS.register("blue_green")
@dataclass
class BlueGreenRollout:
    def stages(self) -> list[Stage]:
        return [Stage("shadow", 0.0, 0), Stage("cutover", 1.0, 1)]


def stage_table(spark: SparkSession, stages: list[Stage]) -> DataFrame:
    return spark.createDataFrame([(s.index, s.name, float(s.exposure), s.region) for s in stages], "stage int, name string, exposure double, region string")
