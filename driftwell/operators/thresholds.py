"""Thresholds of anomaly scores, and fusion of several scores."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import RANGE_ROWS
from ..functions.quantiles import quantile_values, quantiles
from ..functions.series import EPSILON
from ..plans.errors import ConfigError, NotFittedError
from ..plans.registry import THRESHOLDS
from ..session import kept


class Threshold(Protocol):
    def fit(self, scores: DataFrame) -> Threshold: ...

    def column(self, by: list[str]) -> Column: ...


@THRESHOLDS.register("static")
@dataclass
class StaticThreshold:
    value: float = 3.0

    def fit(self, scores: DataFrame) -> StaticThreshold:
        return self

    def column(self, by: list[str]) -> Column:
        return F.lit(float(self.value))


@THRESHOLDS.register("sigma")
@dataclass
class SigmaThreshold:
    """Mean and ``k`` population standard deviations of the baseline's scores."""

    k: float = 3.0
    value: float | None = None

    def fit(self, scores: DataFrame) -> SigmaThreshold:
        row = scores.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
        self.value = row["m"] + self.k * (row["s"] + EPSILON)
        return self

    def column(self, by: list[str]) -> Column:
        if self.value is None:
            raise NotFittedError("threshold is not fitted")
        return F.lit(self.value)


@THRESHOLDS.register("quantile")
@dataclass
class QuantileThreshold:
    """A quantile of the baseline's scores, interpolated linearly."""

    q: float = 0.99
    value: float | None = None
    rows: int = RANGE_ROWS

    def __post_init__(self) -> None:
        if not 0 < self.q < 1:
            raise ConfigError("q must be between 0 and 1")

    def fit(self, scores: DataFrame) -> QuantileThreshold:
        self.value = quantile_values(scores, ["score"], [self.q], self.rows).get("score", [None])[0]
        return self

    def column(self, by: list[str]) -> Column:
        if self.value is None:
            raise NotFittedError("threshold is not fitted")
        return F.lit(self.value)


@THRESHOLDS.register("adaptive")
@dataclass
class AdaptiveThreshold:
    """The sigma threshold as a floor under the window's own exponentially weighted mean and ``k`` deviations.

    The latest row of a window weighs 1, each earlier one ``1 - alpha`` times the next; a window sees its own rows, so a
    long shift raises its own threshold.
    """

    k: float = 3.0
    alpha: float = 0.1
    floor: float | None = None
    std: float | None = None

    def fit(self, scores: DataFrame) -> AdaptiveThreshold:
        row = scores.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
        self.std = row["s"] + EPSILON
        self.floor = row["m"] + self.k * self.std
        return self

    def column(self, by: list[str]) -> Column:
        if self.floor is None:
            raise NotFittedError("threshold is not fitted")
        whole = Window.partitionBy(*by)
        age = F.max("t").over(whole) - F.col("t")
        weight = F.pow(F.lit(1 - self.alpha), age)
        mean = F.sum(weight * F.col("score")).over(whole) / F.sum(weight).over(whole)
        return F.greatest(F.lit(self.floor), mean + self.k * self.std)


def robust_scaled(df: DataFrame, scores: list[str], by: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """``(s - median) / (1.4826 (MAD + 1e-8))`` of each score column with the statistics of its own window ``by``: the
    medians of all windows first, then those of the deviations from them."""

    def joined(df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
        middle = quantiles(df, columns, [0.5], by, rows)
        wide = middle.groupBy(*by).agg(*[F.max(F.when(F.col("channel") == c, F.col("quantiles")[0])).alias(n) for c, n in zip(columns, names, strict=True)])
        return df.join(wide, by, "left")

    out = joined(kept(df), scores, [f"__m_{c}" for c in scores])
    out = out.withColumns({f"__a_{c}": F.abs(F.col(c) - F.col(f"__m_{c}")) for c in scores})
    out = joined(out, [f"__a_{c}" for c in scores], [f"__d_{c}" for c in scores])
    out = out.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / ((F.col(f"__d_{c}") + EPSILON) * 1.4826) for c in scores})
    return out.drop(*[f"__{k}_{c}" for k in "mad" for c in scores])


def fuse(scores: list[Column], method: str = "mean", weights: list[float] | None = None) -> Column:
    """One score of several: their mean, maximum, or sum weighted by ``weights / (sum + 1e-8)``."""
    if not scores:
        raise ConfigError("there is no score to fuse")
    if method == "mean":
        return sum(scores[1:], scores[0]) / len(scores)
    if method == "max":
        return F.greatest(*scores) if len(scores) > 1 else scores[0]
    if method == "weighted":
        if weights is None or len(weights) != len(scores):
            raise ConfigError("a weight is needed for each score")
        total = sum(weights) + EPSILON
        parts = [s * (w / total) for s, w in zip(scores, weights, strict=True)]
        return sum(parts[1:], parts[0])
    raise ConfigError(f"unknown fusion method '{method}'")
