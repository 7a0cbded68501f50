"""Stream clustering of sparse codes with anti-habituation.

A row becomes a sparse code: random units sum a few channels each, and the strongest units stay.  A background trace is
taken off, and spheres are grown over the codes in the order of the rows.  Only the trace and the spheres are
sequential; codes and scores are matrix operations over blocks of rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..session import kept, keyed, workers_find_package

TINY = 1e-8
#: Rows that are coded at a time; a code has ``expansion`` numbers for each channel.
BLOCK = 4096


@dataclass
class Units:
    """Random units as lists of channels: unit ``u`` sums ``channel[first[u]:first[u + 1]]``."""

    channel: np.ndarray
    first: np.ndarray
    share: float

    @classmethod
    def draw(cls, channels: int, expansion: int = 40, density: float = 0.1, share: float = 0.05, seed: int = 0) -> Units:
        """The order of the draws is fixed: a uniform number for each unit and channel, then a channel for each unit
        that got none."""
        rng = np.random.default_rng(seed)
        unit, channel = np.nonzero(rng.random((expansion * channels, channels)) < density)
        silent = np.setdiff1d(np.arange(expansion * channels), unit)
        unit, channel = np.append(unit, silent), np.append(channel, rng.integers(0, channels, len(silent)))
        order = np.lexsort([channel, unit])
        return cls(channel[order], np.searchsorted(unit[order], np.arange(expansion * channels)), share)

    def __len__(self) -> int:
        return len(self.first)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """Sums of the units, with all but the strongest share of them (one at least) at 0."""
        sums = np.add.reduceat(rows[:, self.channel], self.first, axis=1)
        weak = len(self) - min(len(self), max(1, round(self.share * len(self))))
        if weak:  # which of equal sums stay is numpy's choice
            np.put_along_axis(sums, np.argpartition(sums, weak, axis=1)[:, :weak], 0.0, axis=1)
        return sums


def traces(codes: np.ndarray, trace: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """The background before each code, and after the last: it fades by ``beta``, and where a code exceeds it, takes
    ``alpha`` of the excess, so the new value is the larger of the two."""
    out = np.empty((len(codes) + 1, codes.shape[1]))
    out[0] = trace
    for before, after, code in zip(out[:-1], out[1:], codes, strict=True):
        np.maximum((1 - beta) * before, (1 - beta - alpha) * before + alpha * code, out=after)
    return out


POTENTIAL, CORE, BUFFER = 0, 1, 2


def grown_radius(radius: float, distance: float, theta: float, most: float) -> float:
    """The radius after a hit in the shell: a point at more than half of it widens it, up to ``most``."""
    return min(radius + (2 * distance / radius - 1) / theta, most)


def gaps(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distances, a row for each row and a column for each centre."""
    return np.stack([np.linalg.norm(rows - c, axis=1) for c in centers], axis=1)


def seeds(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centres spread over the rows, and the number of rows nearest to each: the first drawn evenly, others with the
    squared distance to the nearest before as weight, then a few rounds of means."""
    centers = rows[[rng.integers(len(rows))]]
    far = np.full(len(rows), np.inf)
    while len(centers) < min(k, len(rows)):
        far = np.minimum(far, ((rows - centers[-1]) ** 2).sum(axis=1))
        weight = far if far.any() else np.ones(len(rows))
        centers = np.vstack([centers, rows[rng.choice(len(rows), p=weight / weight.sum())]])
    for _ in range(rounds):
        member = gaps(rows, centers).argmin(axis=1) == np.arange(len(centers))[:, None]
        some = member.any(axis=1)
        centers[some] = member[some] @ rows / member[some].sum(axis=1, keepdims=True)
    return centers, np.bincount(gaps(rows, centers).argmin(axis=1), minlength=len(centers))


class Space:
    """Microclusters as rows of arrays, and the groups that overlapping ones form."""

    def __init__(self, dim: int, theta: float, most_radius: float, delta: int) -> None:
        self.theta, self.most_radius, self.delta = theta, most_radius, delta
        self.center = np.zeros((0, dim))
        self.radius, self.weight = np.zeros(0), np.zeros(0)
        self.core_hits, self.shell_hits, self.status = (np.zeros(0, np.int64) for _ in range(3))
        self.pivot, self.touch = np.zeros(0), np.zeros((0, 0), bool)
        self.group, self.group_center = np.zeros(0, np.int64), np.zeros((0, dim))
        self.stale = True

    def __len__(self) -> int:
        return len(self.radius)

    def add(self, center: np.ndarray, radius: float, hits: int, status: int) -> None:
        self.center = np.vstack([self.center, center])
        self.radius, self.weight = np.append(self.radius, radius), np.append(self.weight, 1.0)
        self.core_hits, self.shell_hits, self.status = np.append(self.core_hits, hits), np.append(self.shell_hits, 0), np.append(self.status, status)
        self.pivot = np.append(self.pivot, 0.0)
        self.touch = np.pad(self.touch, ((0, 1), (0, 1)))
        self.moved(len(self) - 1)

    def moved(self, i: int) -> None:
        """Finds anew which spheres touch sphere ``i``.

        Two that touch are no farther from a pivot (the origin) than their radii let them be apart, so distances are
        measured for those alone of which this holds.
        """
        self.pivot[i] = np.linalg.norm(self.center[i])
        reach = self.radius + self.radius[i]
        near = np.flatnonzero(np.abs(self.pivot - self.pivot[i]) <= reach * (1 + 1e-9) + 1e-9)
        touches = np.linalg.norm(self.center[near] - self.center[i], axis=1) <= reach[near]
        self.touch[i] = False
        self.touch[i, near] = touches
        self.touch[:, i] = self.touch[i]
        self.stale = True

    def regroup(self) -> None:
        """Groups of spheres that touch, in the order of their first member, and the mean of each group's centres."""
        n = len(self)
        self.group = np.full(n, -1)
        count = 0
        for i in range(n):
            if self.group[i] >= 0:
                continue
            reached, edge = np.zeros(n, bool), np.zeros(n, bool)
            reached[i] = edge[i] = True
            while edge.any():
                edge = self.touch[edge].any(axis=0) & ~reached
                reached |= edge
            self.group[reached] = count
            count += 1
        self.group_center = np.array([self.center[self.group == g].mean(axis=0) for g in range(count)])
        self.stale = False

    def nearest(self, row: np.ndarray) -> tuple[int, float]:
        """The nearest microcluster of the nearest group, or -1."""
        if not len(self):
            return -1, float("inf")
        if self.stale:
            self.regroup()
        g = int(np.linalg.norm(self.group_center - row, axis=1).argmin())
        members = np.flatnonzero(self.group == g)
        d = np.linalg.norm(self.center[members] - row, axis=1)
        best = int(d.argmin())
        return int(members[best]), float(d[best])

    def absorb(self, i: int, row: np.ndarray, distance: float, core_share: float) -> None:
        if distance <= core_share * self.radius[i]:
            self.core_hits[i] += 1
        else:
            self.shell_hits[i] += 1
            self.center[i] += (row - self.center[i]) / self.shell_hits[i]
            self.radius[i] = grown_radius(self.radius[i], distance, self.theta, self.most_radius)
            self.moved(i)
        self.weight[i] += max(self.radius[i] - distance, 0.0) / self.radius[i] / self.theta
        if self.core_hits[i] + self.shell_hits[i] >= self.delta and self.weight[i] > 0:
            self.status[i] = CORE

    def fade(self) -> None:
        """All lose weight; of those without any left, core ones become a buffer of weight 0.5 and others go."""
        self.weight -= 1 / self.theta
        spent = self.weight <= 0
        saved = spent & (self.status == CORE)
        self.weight[saved], self.status[saved] = 0.5, BUFFER
        keep = ~spent | saved
        if not keep.all():
            for name in ("center", "radius", "weight", "core_hits", "shell_hits", "status", "pivot"):
                setattr(self, name, getattr(self, name)[keep])
            self.touch = self.touch[np.ix_(keep, keep)]
            self.stale = True

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Distance of codes from the nearest sphere of the nearest group, by its radius; infinite without spheres."""
        if not len(self):
            return np.full(len(rows), np.inf)
        if self.stale:
            self.regroup()
        group = gaps(rows, self.group_center).argmin(axis=1)
        away = np.where(self.group == group[:, None], gaps(rows, self.center), np.inf)
        best = away.argmin(axis=1)
        return away[np.arange(len(rows)), best] / (self.radius[best] + TINY)


def _matrix(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, float)
    return rows[:, None] if rows.ndim == 1 else rows


@dataclass
class StreamClusters:
    """Codes, background and spheres learned in one pass over a baseline, and scores against them."""

    expansion: int = 40
    density: float = 0.1
    wta_frac: float = 0.05
    alpha: float = 0.1
    beta: float = 0.05
    n_init: int = 8
    theta: float = 100.0
    delta: int = 2
    core_share: float = 0.5
    rebuild_every: int = 50
    seed: int = 0
    rows: int = field(default=0, repr=False)
    space: Space | None = None
    units: Units | None = field(default=None, repr=False)
    background: np.ndarray | None = field(default=None, repr=False)

    def begin(self, channels: int) -> StreamClusters:
        """Ready for the first row of a stream, with the same units each time."""
        self.units = Units.draw(channels, self.expansion, self.density, self.wta_frac, self.seed)
        self.background = np.zeros(len(self.units))
        self.space, self.rows = None, 0
        return self

    def excess(self, rows: np.ndarray) -> np.ndarray:
        """Codes of the next rows less the background before each; leaves the last background behind."""
        codes = self.units.codes(rows)
        trace = traces(codes, self.background, self.alpha, self.beta)
        self.background = trace[-1]
        return np.maximum(codes - trace[:-1], 0.0)

    def grow(self, block: np.ndarray, radius: float) -> None:
        """Grows spheres over the next block of excesses; the first ones (a stream's first block holds BLOCK rows, or all)
        come from its head."""
        if self.space is None:
            self.space = Space(len(self.units), self.theta, 10 * radius, self.delta)
            head = min(len(block), max(5 * self.n_init, 50))
            for center, n in zip(*seeds(block[:head], self.n_init, np.random.default_rng(self.seed)), strict=True):
                if n:
                    self.space.add(center, radius, int(n), CORE if n >= self.delta else POTENTIAL)
            block = block[head:]
        space = self.space
        for code in block:
            best, distance = space.nearest(code)
            if best >= 0 and distance <= space.radius[best]:
                space.absorb(best, code, distance, self.core_share)
            else:
                space.add(code, radius, 1, POTENTIAL)
            self.rows += 1
            if self.rows % self.rebuild_every == 0:
                space.fade()

    def end(self) -> StreamClusters:
        self.space.fade()
        self.space.regroup()
        return self

    def fit(self, rows: np.ndarray) -> StreamClusters:
        """Three passes over the rows, so that codes are never held for more than a block of them: their mean, the
        median distance from it (the first radius), the spheres."""
        rows = _matrix(rows)
        blocks = [rows[lo : lo + BLOCK] for lo in range(0, len(rows), BLOCK)]

        def passed():
            self.begin(rows.shape[1])
            return map(self.excess, blocks)

        mean = sum(x.sum(axis=0) for x in passed()) / len(rows)
        radius = float(np.median(np.concatenate([np.linalg.norm(x - mean, axis=1) for x in passed()]))) + TINY
        for block in passed():
            self.grow(block, radius)
        return self.end()

    def to_json(self) -> str:
        """Parameters, background and spheres; the units are drawn again from the seed."""
        numbers = {k: v for k, v in vars(self).items() if k not in ("space", "units", "background")}
        space = {k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in vars(self.space).items() if k not in ("touch", "pivot")}
        return json.dumps({"model": numbers, "channels": len(self.background) // self.expansion, "background": self.background.tolist(), "space": space})

    @classmethod
    def from_json(cls, text: str) -> StreamClusters:
        """A model for scoring: which spheres touch is not kept, their groups are."""
        told = json.loads(text)
        out = cls(**told["model"])
        out.units = Units.draw(told["channels"], out.expansion, out.density, out.wta_frac, out.seed)
        out.background = np.array(told["background"])
        out.space = Space(len(out.units), out.theta, 0.0, out.delta)
        for k, v in told["space"].items():
            setattr(out.space, k, np.array(v, getattr(out.space, k).dtype) if isinstance(v, list) else v)
        return out

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Scores of rows against the spheres; the background stays as the baseline left it."""
        if self.space is None:
            raise RuntimeError("the clustering is not fitted")
        rows = _matrix(rows)
        parts = [self.space.scores(np.maximum(self.units.codes(rows[lo : lo + BLOCK]) - self.background, 0.0)) for lo in range(0, len(rows), BLOCK)]
        return np.concatenate([np.zeros(0), *parts])


# --- many streams, each a keyed fold ---------------------------------------------------------------------------------


def _fold(start: Callable, step: Callable, end: Callable) -> Callable:
    """A map over batches sorted by stream (first column): a state for each stream, stepped by blocks of BLOCK rows.

    The last column is set in the head of a stream, a row with ``t`` -1 before the others, if it has one.  A task holds a
    block and a state, whatever the length of a stream.  ``step`` and ``end`` make batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, held = None, None, []

        def flushed():
            rows = [np.concatenate(held)] if held else []
            held.clear()
            return (out for m in rows for out in step(name, state, m))

        for batch in batches:
            names, heads = batch.column(0).to_pylist(), batch.column(batch.num_columns - 1)
            is_head = batch.column(1).to_numpy() < 0
            matrix = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:-1]], axis=1)
            turns = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
            for lo, hi in zip([0, *turns] if names else [], [*turns, len(names)], strict=False):
                if state is None or names[lo] != name:
                    if state is not None:
                        yield from flushed()
                        yield from end(name, state)
                    name = names[lo]
                    state = start(heads[lo].as_py())
                lo += int(is_head[lo])
                while lo < hi:
                    stop = min(hi, lo + BLOCK - sum(map(len, held)))
                    held.append(matrix[lo:stop])
                    lo = stop
                    if sum(map(len, held)) == BLOCK:
                        yield from flushed()
        if state is not None:
            yield from flushed()
            yield from end(name, state)

    return run


def fit_streams(df: DataFrame, channels: list[str], params: dict, by: str = "stream_id", order: tuple[str, ...] = ("t",)) -> DataFrame:
    """``by, model``: the clustering of every stream as a text, fitted in parallel, a stream by one task.

    A stream's rows are folded in order, as ``StreamClusters.fit`` does with a matrix, in the same three passes; neither the
    length of a stream nor the number of streams is bounded, and no row goes to the driver.  The median distance, which
    ``fit`` takes from all rows of a stream, is an exact quantile over the rows of all streams at once.
    """
    workers_find_package(df.sparkSession)
    kind, width = df.schema[by].dataType, len(channels)
    values = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(channels)]
    rows = keyed(df, by).sortWithinPartitions(by, *order).select(F.col(by).alias("stream"), F.lit(0).alias("t"), *values)
    rows = kept(rows.withColumn("n", F.monotonically_increasing_id()))

    def mapped(fn: Callable, schema: str, heads: DataFrame | None = None) -> DataFrame:
        table = rows.withColumn("head", F.lit(None).cast("array<double>"))
        if heads is not None:
            table = table.unionByName(heads.withColumns({"t": F.lit(-1), "n": F.lit(0).cast("long")}), allowMissingColumns=True)
        table = keyed(table, "stream").sortWithinPartitions("stream", "t", "n").drop("n")
        return table.mapInArrow(fn, f"stream {kind.simpleString()}, {schema}")

    def batch(name, column: str, of: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(of), from_arrow), pa.array(of)], ["stream", column])

    from_arrow = rows.limit(0).select("stream").toArrow().schema.field("stream").type
    fresh = lambda: StreamClusters(**params).begin(width)

    def summed(name, state, matrix):
        state["n"] += len(matrix)
        state["sum"] = state["sum"] + state["model"].excess(matrix).sum(axis=0)
        return ()

    means = mapped(_fold(lambda _: {"model": fresh(), "n": 0, "sum": 0.0}, summed, lambda name, s: [batch(name, "head", [(s["sum"] / s["n"]).tolist()])]), "head array<double>")

    def distances(name, state, matrix):
        yield batch(name, "away", np.linalg.norm(state["model"].excess(matrix) - state["mean"], axis=1).tolist())

    away = mapped(_fold(lambda head: {"model": fresh(), "mean": np.array(head)}, distances, lambda name, s: ()), "away double", means)
    radius = quantiles(kept(away), ["away"], [0.5], ["stream"]).select("stream", F.col("quantiles").alias("head"))

    def grown(name, state, matrix):
        state["model"].grow(state["model"].excess(matrix), state["radius"])
        return ()

    fitted = _fold(lambda head: {"model": fresh(), "radius": head[0] + TINY}, grown, lambda name, s: [batch(name, "model", [s["model"].end().to_json()])])
    return mapped(fitted, "model string", radius).withColumnRenamed("stream", by)


def score_streams(df: DataFrame, models: DataFrame, channels: list[str], extra: list[str], by: str = "stream_id") -> DataFrame:
    """``by, extra, score`` of rows against the model of their own stream, which travels to the stream's rows; null where a
    stream has none.  For any number of models; a stream is scored by one task."""
    workers_find_package(df.sparkSession)
    names = [by, *[c for c in extra if c != by], *[c for c in channels if c not in extra]]
    rows = df.select(*names).withColumn("model", F.lit(None).cast("string")).unionByName(models.select(by, "model"), allowMissingColumns=True)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [by, *[c for c in extra if c != by]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, model, some = None, None, False
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(b.num_columns - 1)
            turns = [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
            for lo, hi in zip([0, *turns] if ids else [], [*turns, len(ids)], strict=False):
                if not some or ids[lo] != name:
                    name, model, some = ids[lo], None, True
                if texts[lo].is_valid:
                    model = StreamClusters.from_json(texts[lo].as_py())
                    lo += 1
                part = b.slice(lo, hi - lo)
                matrix = np.stack([part.column(names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in channels], axis=1)
                score = pa.array(model.scores(matrix)) if model is not None else pa.nulls(len(matrix), pa.float64())
                yield pa.RecordBatch.from_arrays([*[part.column(names.index(c)) for c in out], score], [*out, "score"])

    ordered = keyed(rows, by).sortWithinPartitions(by, F.col("model").asc_nulls_last())
    return ordered.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in out) + ", score double")
