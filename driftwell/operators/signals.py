"""Signals: forms of a multivariate series, channel schemas, normalisers, count windows and buffers.

Wide form: ``stream_id, stage, t`` and one double column per channel.  Long form: ``..., channel, value``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as S
from ..functions.order import RANGE_ROWS
from ..functions.quantiles import quantile_values
from ..functions.tiles import tiled, with_totals
from ..plans.errors import SignalError
from ..session import workers_find_package

KEYS = ["stream_id", "stage"]
ROLES = ("outputs", "features", "indicators")


@dataclass
class SignalSchema:
    """Channel names in order, and the role of some of them."""

    names: list[str]
    roles: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, role in self.roles.items():
            if name not in self.names:
                raise SignalError(f"unknown channel '{name}'")
            if role not in ROLES:
                raise SignalError(f"unknown role '{role}'")

    @classmethod
    def default(cls, n: int) -> SignalSchema:
        return cls([f"ch{i}" for i in range(n)])

    def index_of(self, name: str) -> int:
        if name not in self.names:
            raise SignalError(f"unknown channel '{name}'")
        return self.names.index(name)

    def columns_for(self, role: str) -> list[str]:
        """The channels of a role; all of them where no channel has it."""
        return [n for n in self.names if self.roles.get(n) == role] or list(self.names)

    def select(self, df: DataFrame, role: str) -> DataFrame:
        rest = [c for c in df.columns if c not in self.names]
        return df.select(*rest, *self.columns_for(role))


def hourly_counts(events: DataFrame, channels: list[str], ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """``stream_id, t, channels``: events per hour since the first one, and type; hours without events are zero.

    Counts are aggregated before the spine of hours (one row each) is joined.
    """
    hour = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / 3600)
    counts = events.where(F.col(kind).isin(channels)).groupBy(hour.alias("h")).agg(*[F.count(F.when(F.col(kind) == c, 1)).cast("double").alias(c) for c in channels])
    span = events.agg(F.min(hour).alias("lo"), F.max(hour).alias("hi"))
    spine = span.select("lo", F.explode(F.sequence("lo", "hi")).alias("h"))
    return spine.join(counts, "h", "left").select(
        F.lit("events").alias("stream_id"), (F.col("h") - F.col("lo")).cast("long").alias("t"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in channels]
    )


def staged(df: DataFrame, baseline: int, window: int) -> DataFrame:
    """Rows before ``baseline`` are stage -1; later ones stages 0, 1, ... of ``window`` rows; ``t`` restarts in each."""
    stage = F.when(F.col("t") < baseline, -1).otherwise(F.floor((F.col("t") - baseline) / window)).cast("int")
    start = F.when(F.col("t") < baseline, 0).otherwise(baseline + stage * window)
    return df.withColumn("stage", stage).withColumn("t", F.col("t") - start)


def to_long(df: DataFrame, channels: list[str], keys: tuple[str, ...] = ("stream_id", "stage", "t")) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(i).alias("channel_ix"), F.col(c).alias("value")) for i, c in enumerate(channels)])).alias("c")).select(*keys, "c.*")


@dataclass
class Normaliser:
    """Centre and scale of each channel, learned in one aggregation."""

    channels: list[str]
    centre: list[float]
    scale: list[float]

    @classmethod
    def z(cls, df: DataFrame, channels: list[str]) -> Normaliser:
        """Mean and population standard deviation."""
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(channels)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(channels)]).first()
        return cls(channels, [row[f"m{i}"] or 0.0 for i in range(len(channels))], [row[f"s{i}"] or 0.0 for i in range(len(channels))])

    @classmethod
    def robust(cls, df: DataFrame, channels: list[str], rows: int = RANGE_ROWS) -> Normaliser:
        """Median and range between the quartiles, interpolated linearly."""
        q = quantile_values(df, channels, [0.25, 0.5, 0.75], rows)
        return cls(channels, [q[c][1] for c in channels], [q[c][2] - q[c][0] for c in channels])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: S.zscore(F.col(c), m, s) for c, m, s in zip(self.channels, self.centre, self.scale, strict=True)})

    def to_json(self) -> str:
        return json.dumps([self.channels, self.centre, self.scale])

    @classmethod
    def from_json(cls, text: str) -> Normaliser:
        return cls(*json.loads(text))


def standard_scaled(df: DataFrame, channels: list[str], fit_on: DataFrame) -> DataFrame:
    """Standardised with the statistics of another table: constant channels keep their scale, NaN and null become 0."""
    n = Normaliser.z(fit_on, channels)
    out = {c: F.coalesce(F.nanvl((F.col(c) - m) / (s or 1.0), F.lit(0.0)), F.lit(0.0)) for c, m, s in zip(channels, n.centre, n.scale, strict=True)}
    return df.withColumns(out)


def sliding_windows(df: DataFrame, size: int, stride: int = 1, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Rows repeated for each full count window they are in: ``window`` 0, 1, ... starting at ``window * stride``.

    A row is in ``size / stride`` windows or so; no window is gathered.
    """
    if size <= 0 or stride <= 0:
        raise ValueError("size and stride must be positive")
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - size + 1) / stride)).cast("long")
    last = F.least(F.floor(F.col("t") / stride), F.floor((F.col("__n") - size) / stride)).cast("long")
    out = with_totals(df, list(by), __n=F.count("*")).withColumn("__first", first).withColumn("__last", last).where("__n >= " + str(int(size)) + " and __first <= __last")
    return out.withColumn("window", F.explode(F.sequence("__first", "__last"))).drop("__n", "__first", "__last")


def aligned_windows(df: DataFrame, size: int, step: int, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Windows that start every ``step`` rows, and one more that ends with the series where these leave rows over.

    A series of at most ``size`` rows has the one window that starts at 0; ``window_start`` names it.
    """
    out = with_totals(df, list(by), __n=F.count("*"))
    last = F.greatest(F.col("__n") - size, F.lit(0))
    regular = F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))
    starts = F.array_union(regular, F.array(last))
    inside = F.filter(starts, lambda s: (F.col("t") >= s) & (F.col("t") < s + size))
    return out.withColumn("window_start", F.explode(inside)).drop("__n")


def padded_windows(df: DataFrame, size: int, step: int, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """``aligned_windows`` with ``position`` in the window and ``padded``: a series of fewer than ``size`` rows repeats its
    last row, marked, until its one window is full."""
    last = with_totals(df, list(by), __n=F.count("*")).where((F.col("__n") < size) & (F.col("t") == F.col("__n") - 1))
    extra = last.withColumn("position", F.explode(F.sequence("__n", F.lit(size - 1).cast("long")))).drop("__n")
    extra = extra.withColumns({"window_start": F.lit(0).cast("long"), "padded": F.lit(True)})
    whole = aligned_windows(df, size, step, by).withColumns({"position": F.col("t") - F.col("window_start"), "padded": F.lit(False)})
    return whole.unionByName(extra)


def last_rows(windowed: DataFrame, size: int, step: int) -> DataFrame:
    """Of rows with their ``position`` in a window of ``size`` rows the last ``step``."""
    return windowed.where(F.col("position") >= size - step)


def overlap_average(df: DataFrame, windowed: DataFrame, errors: list[str], by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """``by, t, errors, score``: the mean error of each row of ``df`` and channel over the windows that hold the row (0
    where none does), and the mean over channels."""
    mean = windowed.groupBy(*by, "t").agg(*[F.avg(c).alias(c) for c in errors])
    out = df.select(*by, "t").join(mean, [*by, "t"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in errors})
    return out.withColumn("score", S.mean_of([F.col(c) for c in errors]))


def kl_contributions(windowed: DataFrame, pairs: dict[str, tuple[str, str]], window: list[str]) -> DataFrame:
    """For each name -> (reconstruction, value) what a row adds to the weighted divergence of the two within its window.

    Both go through a softplus and are divided by their sums over the window; a row adds ``p d ln(1 + d**2)`` with ``d``
    the difference of their logarithms.
    """
    w = Window.partitionBy(*window)
    out = {}
    for name, columns in pairs.items():
        p, q = (S.softplus(F.col(c)) / F.sum(S.softplus(F.col(c))).over(w) for c in columns)
        d = F.ln(p) - F.ln(q)
        out[name] = p * d * F.log1p(d * d)
    return windowed.withColumns(out)


def _window_matrix(windowed: DataFrame, columns: list[str], window: list[str]) -> DataFrame:
    """``window`` and ``rows``, its rows by position: one row for each window, as long as the window."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return windowed.groupBy(*window).agg(F.collect_list(F.struct(F.col("position").cast("long").alias("position"), values.alias("x"))).alias("rows"))


def _transformed(batches: Iterator[pa.RecordBatch], size: int, width: int, fn: Callable) -> Iterator[pa.RecordBatch]:
    """``fn`` of an array of windows, rows and columns (0 where a row is absent), as lists of its real and imaginary parts."""
    for batch in batches:
        rows = batch.column(batch.num_columns - 1)
        of = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy())
        flat = rows.flatten()
        x = np.zeros((len(rows), size, width))
        x[of, flat.field(0).to_numpy()] = flat.field(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        out = fn(x).reshape(len(rows), -1)
        lists = [pa.array(list(part), pa.list_(pa.float64())) for part in (out.real, out.imag)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], [*batch.schema.names[:-1], "re", "im"])


def _spectra(windowed: DataFrame, columns: list[str], size: int, window: list[str], fn: Callable) -> DataFrame:
    workers_find_package(windowed.sparkSession)
    rows, width = _window_matrix(windowed, columns, window), len(columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda batches: _transformed(batches, size, width, fn), f"{kinds}, re array<double>, im array<double>")


def spectrum(windowed: DataFrame, column: str, size: int, window: list[str]) -> DataFrame:
    """``window, frequency, re, im, power`` of a column over windows of ``size`` rows by ``position``: the fast Fourier
    transform of each window, any size, at the frequencies 0 to ``size // 2``.

    A window is one row of a batch, so rows are moved once and not repeated by frequency; rows that a window lacks count 0.
    """
    got = _spectra(windowed, [column], size, window, lambda x: np.fft.rfft(x[:, :, 0], axis=1))
    rows = got.select(*window, F.posexplode(F.arrays_zip("re", "im")).alias("frequency", "f")).select(*window, "frequency", "f.re", "f.im")
    return rows.withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def spectrum_2d(windowed: DataFrame, columns: list[str], size: int, window: list[str]) -> DataFrame:
    """``window, frequency, channel_frequency, re, im``: the transform of each window over its rows and its channels, at
    all ``size`` by ``len(columns)`` frequencies."""
    got = _spectra(windowed, columns, size, window, lambda x: np.fft.fft2(x, axes=(1, 2)))
    rows = got.select(*window, F.posexplode(F.arrays_zip("re", "im")).alias("__at", "f"))
    at = F.col("__at")
    return rows.select(*window, F.floor(at / len(columns)).cast("int").alias("frequency"), (at % len(columns)).alias("channel_frequency"), "f.re", "f.im")


def trailing_buffer(df: DataFrame, channels: list[str], capacity: int, by: tuple[str, ...] = ("stream_id",), rows: int = RANGE_ROWS) -> DataFrame:
    """What a ring buffer holds after each row: ``buffer_rows, full`` and each channel's values, oldest first."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    tiles = tiled(df.select(*by, "t", *channels), list(by), "t", before=capacity - 1, rows=rows)
    w = tiles.window.rowsBetween(-(capacity - 1), 0)
    held = {"buffer_rows": F.count("*").over(w), "full": F.count("*").over(w) == capacity}
    out = tiles.own(tiles.rows.select("*", *[v.alias(k) for k, v in held.items()], *[F.collect_list(c).over(w).alias(f"__l_{c}") for c in channels]))
    return out.select(*by, "t", *held, *[F.col(f"__l_{c}").alias(c) for c in channels])


def drop_zero_channels(df: DataFrame, channels: list[str]) -> tuple[DataFrame, list[str]]:
    """Drops the channels that are zero in every row; returns those that stay too."""
    row = df.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in channels]).first()
    gone = [c for c in channels if not row[c]]
    return df.drop(*gone), [c for c in channels if c not in gone]


def train_valid_split(df: DataFrame, by: str = "entity", long_series: int = 100_000, share: float = 0.8) -> DataFrame:
    """``split``: the first 80 % of a series train, the rest validate; a long one in two halves, each split so."""
    out = with_totals(df, [by], __n=F.count("*")).withColumn("__half", F.floor(F.col("__n") / 2))
    start = F.when((F.col("__n") > long_series) & (F.col("t") >= F.col("__half")), F.col("__half")).otherwise(0)
    size = F.when(F.col("__n") <= long_series, F.col("__n")).when(F.col("t") < F.col("__half"), F.col("__half")).otherwise(F.col("__n") - F.col("__half"))
    return out.withColumn("split", F.when(F.col("t") - start < F.floor(size * share), "train").otherwise("valid")).drop("__n", "__half")
