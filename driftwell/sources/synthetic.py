"""Seeded synthetic streams and fault scenarios; the random part is drawn by numpy on the driver (small windows)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import SCENARIOS


@dataclass
class SyntheticStream:
    n_channels: int = 4
    seasonality: float = 50
    ar: float = 0.5
    noise: float = 0.15
    seed: int = 0

    def baseline(self, n: int, offset: int = 0) -> np.ndarray:
        """Two sines with a phase for each channel, and autoregressive noise that starts at 0.

        Fixed values: the weight and period of the second sine, the order of the draws and the offsets of the seed.
        """
        rng = np.random.default_rng(self.seed + offset)
        t = np.arange(n)[:, None]
        phase = np.linspace(0, np.pi, self.n_channels)[None, :]
        out = np.sin(2 * np.pi * t / self.seasonality + phase) + 0.4 * np.sin(2 * np.pi * t / (2 * self.seasonality))
        shocks = rng.normal(0, self.noise, size=(n, self.n_channels))
        state = np.zeros(self.n_channels)
        for i in range(1, n):
            state = self.ar * state + shocks[i]
            out[i] += state
        return out

    def noisy(self, x: np.ndarray, scale: float = 1.0, offset: int = 99) -> np.ndarray:
        """Heavy-tailed noise; the same for every window of a shape."""
        rng = np.random.default_rng(self.seed + offset)
        return x + rng.standard_t(3, size=x.shape) * self.noise * scale


def frame(spark: SparkSession, windows: dict[int, np.ndarray], stream: str = "synthetic") -> DataFrame:
    """Wide rows ``stream_id, stage, t, ch0, ...`` of windows by stage."""
    width = next(iter(windows.values())).shape[1]
    rows = [(stream, stage, t, *map(float, row)) for stage, x in windows.items() for t, row in enumerate(x)]
    return spark.createDataFrame(rows, "stream_id string, stage int, t long, " + ", ".join(f"ch{i} double" for i in range(width)))


def inject_spike(df: DataFrame, start: int, length: int = 5, magnitude: float = 4.0, channels: list[str] | None = None) -> DataFrame:
    """Adds a constant to rows ``start`` to ``start + length - 1``, and labels them 1."""
    hit = (F.col("t") >= start) & (F.col("t") < start + length)
    return _injected(df, hit, lambda c: F.lit(magnitude), channels)


def inject_drift(df: DataFrame, start: int, slope: float = 0.05, channels: list[str] | None = None) -> DataFrame:
    """Adds a line that leaves 0 at ``start``."""
    return _injected(df, F.col("t") >= start, lambda c: (F.col("t") - start) * slope, channels)


def inject_regression(df: DataFrame, start: int, shift: float = 0.8, channels: list[str] | None = None) -> DataFrame:
    """Shifts the level from ``start`` on."""
    return _injected(df, F.col("t") >= start, lambda c: F.lit(shift), channels)


def _injected(df: DataFrame, hit, add, channels: list[str] | None) -> DataFrame:
    channels = channels if channels is not None else [c for c in df.columns if c not in ("stream_id", "stage", "t", "label")]
    label = F.greatest(F.col("label"), hit.cast("int")) if "label" in df.columns else hit.cast("int")
    return df.withColumns({c: F.when(hit, F.col(c) + add(c)).otherwise(F.col(c)) for c in channels} | {"label": label})


@dataclass
class Scenario:
    name: str
    baseline: DataFrame
    windows: DataFrame
    description: str
    anomalous_from: int | None = None


def _stages(spark: SparkSession, s: SyntheticStream, n_stages: int, window: int, change=None) -> DataFrame:
    made = {i: s.baseline(window, offset=100 + i) for i in range(n_stages)}
    return frame(spark, {i: change(x) if change else x for i, x in made.items()})


def _scenario(name: str, text: str, begins=None, fault=None, change=None):
    @SCENARIOS.register(name)
    def make(spark: SparkSession, n_channels: int = 4, seed: int = 0, n_stages: int = 5, window: int = 120, train: int = 600) -> Scenario:
        s = SyntheticStream(n_channels=n_channels, seed=seed)
        baseline = frame(spark, {-1: s.baseline(train)})
        windows = _stages(spark, s, n_stages, window, (lambda x: change(s, x)) if change else None)
        first = max(1, begins(n_stages)) if begins else None
        if fault:
            good = windows.where(F.col("stage") < first)
            for i in range(first, n_stages):
                good = good.unionByName(fault(windows.where(F.col("stage") == i), i - first).drop("label"))
            windows = good
        return Scenario(name, baseline, windows, text, first)

    return make


_scenario("healthy", "no fault: should roll out in full")
_scenario("regression", "two channels shift at the later stages", lambda n: n - 2, lambda w, k: inject_regression(w, 20, 1.2, ["ch0", "ch1"]))
_scenario("drift", "a channel drifts, more with each stage", lambda n: n // 2, lambda w, k: inject_drift(w, 15, 0.04 * (k + 1), ["ch0"]))
_scenario("spike", "a channel jumps for a while at the later stages", lambda n: n - 2, lambda w, k: inject_spike(w, 40, 18, 4.0, ["ch2"]))
_scenario("noisy", "heavy noise and no fault", change=lambda s, x: s.noisy(x, 2.0))


def build_scenario(spark: SparkSession, name: str, **params) -> Scenario:
    return SCENARIOS.create(name, spark=spark, **params)
