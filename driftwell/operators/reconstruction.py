"""A dense network that reconstructs windows, trained by gradients that tasks sum up, and the detector around it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.errors import NotFittedError
from ..plans.registry import DETECTORS
from ..session import kept, workers_find_package
from . import signals
from .detectors import Detector
from .signals import KEYS

#: Windows that a task computes at a time, and tasks that sum the gradients of the others before the driver does.
BLOCK, FAN = 1024, 32


@dataclass
class Network:
    """Layers of ``sizes`` units, tanh between them and none at the end; ``flat`` holds all weights and offsets."""

    sizes: list[int]
    flat: np.ndarray = field(repr=False)

    @classmethod
    def draw(cls, sizes: list[int], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        parts = [x for a, b in zip(sizes, sizes[1:], strict=False) for x in (rng.normal(0, a**-0.5, a * b), np.zeros(b))]
        return cls(list(sizes), np.concatenate(parts))

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Weights and offsets of each layer, as views."""
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def run(self, x: np.ndarray) -> list[np.ndarray]:
        """What every layer makes of rows, the rows themselves first."""
        made, layers = [x], self.layers(self.flat)
        for i, (w, b) in enumerate(layers):
            z = made[-1] @ w + b
            made.append(z if i == len(layers) - 1 else np.tanh(z))
        return made

    def losses(self, x: np.ndarray) -> np.ndarray:
        return ((self.run(x)[-1] - x) ** 2).mean(axis=1)

    def gradient(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Sums over rows of the mean squared error and of its gradient."""
        made, out = self.run(x), np.zeros_like(self.flat)
        error = 2 * (made[-1] - x) / x.shape[1]
        for (w, _), (to_w, to_b), before in reversed(list(zip(self.layers(self.flat), self.layers(out), made[:-1], strict=True))):
            to_w += before.T @ error
            to_b += error.sum(axis=0)
            error = (error @ w.T) * (1 - before * before)
        return float(((made[-1] - x) ** 2).mean(axis=1).sum()), out


@dataclass
class Adam:
    """Steps by running means of the gradient and its square, after the gradient is cut to a length of ``clip``."""

    rate: float = 1e-3
    clip: float = 1.0
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0
    count: int = 0

    def step(self, flat: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        gradient = gradient * min(1.0, self.clip / (float(np.linalg.norm(gradient)) + 1e-6))
        self.count += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        mean, spread = self.first / (1 - 0.9**self.count), self.second / (1 - 0.999**self.count)
        return flat - self.rate * mean / (np.sqrt(spread) + 1e-8)


@dataclass
class EarlyStop:
    """Keeps the weights with the least loss so far; stops after ``patience`` losses in a row above it."""

    patience: int = 3
    least: float = float("inf")
    worse: int = 0
    best: np.ndarray | None = None

    def stops(self, loss: float, flat: np.ndarray) -> bool:
        if loss > self.least:
            self.worse += 1
        else:
            self.least, self.worse, self.best = loss, 0, flat.copy()
        return self.worse >= self.patience


def _matrices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.column(column).slice(lo, BLOCK)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


_SUMS = "n long, loss double, gradient array<double>"


def _row(n: int, loss: float, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([gradient], pa.list_(pa.float64()))], ["n", "loss", "gradient"])


def summed_gradient(windows: DataFrame, network: Network, gradient: bool = True) -> tuple[int, float, np.ndarray]:
    """Windows, and sums over them of the loss and its gradient: one row for each task, these summed by FAN tasks, and
    their few rows by the driver.  The weights travel with the tasks; both are as large as the network alone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, np.zeros_like(network.flat) if gradient else np.zeros(0)
        for x in _matrices(batches):
            n += len(x)
            if gradient:
                part, slope = network.gradient(x)
                loss, total = loss + part, total + slope
            else:
                loss += float(network.losses(x).sum())
        yield _row(n, loss, total)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, 0.0
        for batch in batches:
            for a, b, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, loss, total = n + a, loss + b, total + np.array(g)
        if n:
            yield _row(n, loss, total)

    rows = windows.select("x").mapInArrow(each, _SUMS).repartition(FAN).mapInArrow(together, _SUMS).collect()
    return sum(r["n"] for r in rows), sum(r["loss"] for r in rows), sum((np.array(r["gradient"]) for r in rows), np.zeros_like(network.flat) if gradient else np.zeros(0))


def train(batches: list[DataFrame], valid: DataFrame | None, sizes: list[int], epochs: int = 10, rate: float = 1e-3, clip: float = 1.0, patience: int = 3, seed: int = 0) -> tuple[Network, list[tuple[float, float]]]:
    """A network fitted to windows ``x``, and the mean losses of each epoch (training, validation).

    Each of ``batches`` is a step; the gradient of all its windows is summed by many tasks.  After an epoch the loss over
    ``valid`` (or the training loss) decides whether to go on, and the weights with the least one stay.
    """
    network, adam, stop, told = Network.draw(sizes, seed), Adam(rate, clip), EarlyStop(patience), []
    for _ in range(epochs):
        seen, losses = 0, 0.0
        for batch in batches:
            n, loss, slope = summed_gradient(batch, network)
            if n:
                network.flat = adam.step(network.flat, slope / n)
            seen, losses = seen + n, losses + loss
        n, loss, _ = summed_gradient(valid, network, gradient=False) if valid is not None else (0, 0.0, None)
        told.append((losses / max(seen, 1), loss / n if n else losses / max(seen, 1)))
        if stop.stops(told[-1][1], network.flat):
            break
    network.flat = stop.best if stop.best is not None else network.flat
    return network, told


def window_rows(df: DataFrame, channels: list[str], size: int, step: int, by: list[str] = KEYS) -> DataFrame:
    """``by, window_start, rows, x``: windows of ``size`` rows, their rows' ``t`` and whether they are padding, and all
    channels of all rows in one array.  Null and NaN count as 0."""
    rows = signals.padded_windows(df, size, step, tuple(by))
    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    held = F.struct(F.col("position").cast("int").alias("position"), "t", "padded", F.array(*map(value, channels)).alias("v"))
    out = rows.groupBy(*by, "window_start").agg(F.array_sort(F.collect_list(held)).alias("rows"))
    return out.select(*by, "window_start", F.transform("rows", lambda r: F.struct(r["position"].alias("position"), r["t"].alias("t"), r["padded"].alias("padded"))).alias("rows"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("x"))


@DETECTORS.register("reconstruction")
class ReconstructionDetector(Detector):
    """Windows are reconstructed by a narrow network; a row's error of a channel, weighted by what the row adds to the
    divergence of the two windows, is averaged over the windows that hold it.

    The network learns from the baseline's windows, a fifth of which (chosen by hash) decide when to stop.
    """

    name = "reconstruction"

    def __init__(self, window_size: int = 64, step_size: int = 16, hidden: tuple[int, ...] = (32, 8, 32), epochs: int = 10, batches: int = 1, rate: float = 5e-3, patience: int = 3, seed: int = 0, **kw) -> None:
        super().__init__(**kw)
        self.window_size, self.step_size, self.hidden = int(window_size), int(step_size), list(hidden)
        self.epochs, self.batches, self.rate, self.patience, self.seed = int(epochs), int(batches), float(rate), int(patience), int(seed)
        self.network: Network | None = None
        self.losses: list[list[float]] = []

    def learn(self, df: DataFrame) -> None:
        workers_find_package(df.sparkSession)
        windows = window_rows(df, self.channels, self.window_size, self.step_size).select(F.pmod(F.xxhash64(*KEYS, "window_start"), F.lit(5)).alias("fold"), F.pmod(F.hash(*KEYS, "window_start"), F.lit(self.batches)).alias("batch"), "x")
        windows = kept(windows)
        valid = windows.where("fold = 0")
        held = valid.head(1)
        training = windows.where("fold <> 0") if held and windows.where("fold <> 0").head(1) else windows
        steps = [training.where(F.col("batch") == i) for i in range(self.batches)]
        sizes = [self.window_size * len(self.channels), *self.hidden, self.window_size * len(self.channels)]
        self.network, told = train(steps, valid if held else None, sizes, self.epochs, self.rate, patience=self.patience, seed=self.seed)
        self.losses = [list(x) for x in told]

    def _reconstructed(self, df: DataFrame) -> DataFrame:
        """``KEYS, window_start, t, padded``, the channels and their reconstructions ``r_<channel>``."""
        if self.network is None:
            raise NotFittedError("reconstruction is not fitted")
        network, size, width = self.network, self.window_size, len(self.channels)
        windows = window_rows(df, self.channels, size, self.step_size)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [network.run(x)[-1] for x in _matrices([batch], batch.num_columns - 1)]
                lists = [row for m in made for row in m]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.float64()))], [*batch.schema.names, "y"])

        workers_find_package(df.sparkSession)
        out = windows.mapInArrow(run, f"{kinds}, y array<double>").select(*KEYS, "window_start", "x", "y", F.explode("rows").alias("r"))
        at = lambda c, i: F.get(c, F.col("r.position") * width + i)
        return out.select(*KEYS, "window_start", "r.t", "r.padded", *[at("x", i).alias(c) for i, c in enumerate(self.channels)], *[at("y", i).alias(f"r_{c}") for i, c in enumerate(self.channels)])

    def contributions(self):
        return {c: F.col(f"e_{c}") for c in self.channels}

    def _scored(self, prepared: DataFrame) -> DataFrame:
        rows = self._reconstructed(prepared)
        shares = signals.kl_contributions(rows, {f"k_{c}": (f"r_{c}", c) for c in self.channels}, [*KEYS, "window_start"])
        errors = {f"e_{c}": (F.col(c) - F.col(f"r_{c}")) * (F.col(c) - F.col(f"r_{c}")) * F.abs(F.col(f"k_{c}")) for c in self.channels}
        means = signals.overlap_average(prepared, shares.where("not padded").withColumns(errors), list(errors), tuple(KEYS))
        return prepared.join(means, [*KEYS, "t"])
