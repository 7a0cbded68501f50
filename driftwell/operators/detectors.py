"""Anomaly detectors: learned from a baseline in a few aggregations, applied as column expressions over windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import series as S
from ..functions.order import RANGE_ROWS
from ..functions.tiles import ewma_forecasts, islands, tiled, with_totals
from ..plans.errors import ConfigError, NotFittedError
from ..plans.registry import DETECTORS, THRESHOLDS
from ..session import kept, workers_find_package
from .signals import KEYS, Normaliser, SignalSchema
from .thresholds import SigmaThreshold, fuse, robust_scaled


class Detector:
    """Template: z-normalise by the baseline, learn, score the baseline, fit the threshold.

    Tables are wide: ``stream_id, stage, t`` and the channels.  Scores see only the rows of their own stage.
    """

    name = "base"
    #: Rows of a tile of a series, which is what one task works on.
    tile_rows = RANGE_ROWS

    def __init__(self, threshold=None, normalize: bool = True, min_anomaly_rate: float = 0.05, schema: SignalSchema | None = None) -> None:
        self.threshold = threshold or SigmaThreshold()
        self.normalize = normalize
        self.min_anomaly_rate = float(min_anomaly_rate)
        self.schema = schema
        self.channels: list[str] = []
        self.norm: Normaliser | None = None
        self.fitted = False

    def fit(self, baseline: DataFrame) -> Detector:
        names = self.schema.names if self.schema else [c for c in baseline.columns if c not in (*KEYS, "t", "label")]
        self.channels = list(names)
        self.schema = self.schema or SignalSchema(self.channels)
        self.norm = Normaliser.z(baseline, self.channels) if self.normalize else None
        prepared = self.prepare(baseline)
        self.learn(prepared)
        self.fitted = True
        self.threshold.fit(self._scored(prepared))
        return self

    def prepare(self, df: DataFrame) -> DataFrame:
        return self.norm.transform(df) if self.norm else df

    def learn(self, df: DataFrame) -> None:
        """Sets what ``parts`` needs."""

    def reach(self) -> tuple[int, int]:
        """Rows before and after a row that its score sees."""
        return 0, 0

    def parts(self, w: WindowSpec) -> tuple[list[dict[str, Column]], Column]:
        """Columns to add one after another, and the score over them; ``w`` orders a tile of a series."""
        raise NotImplementedError

    def contributions(self) -> dict[str, Column]:
        """What each channel adds to a row's anomaly, over prepared columns."""
        return {c: F.abs(F.col(c)) for c in self.channels}

    def _scored(self, prepared: DataFrame) -> DataFrame:
        tiles = tiled(prepared, KEYS, "t", *self.reach(), rows=self.tile_rows) if any(self.reach()) else None
        steps, score = self.parts(tiles.window if tiles else S.ordered(KEYS))
        out = tiles.rows if tiles else prepared
        for step in steps:
            out = out.withColumns(step)
        out = out.withColumn("score", score)
        return tiles.own(out) if tiles else out

    def score(self, df: DataFrame) -> DataFrame:
        """``stream_id, stage, t, score`` and the contributions ``by_<channel>``."""
        if not self.fitted:
            raise NotFittedError(f"{self.name} is not fitted")
        out = self._scored(self.prepare(df))
        return out.select(*KEYS, "t", "score", *[v.alias(f"by_{k}") for k, v in self.contributions().items()])

    def flagged(self, df: DataFrame) -> DataFrame:
        """The scores with ``threshold`` and ``flag``."""
        out = self.score(df).withColumn("threshold", self.threshold.column(KEYS))
        return out.withColumn("flag", S.exceeds(F.col("score"), F.col("threshold")))

    def results(self, df: DataFrame) -> DataFrame:
        """A row for each window: ``score`` (the largest), ``threshold, anomaly_rate, is_anomaly, run, n_points,
        attribution`` (a map over channels that sums to 1)."""
        return summarise(self.flagged(df), self.channels, self.min_anomaly_rate, self.name)


def longest_runs(flagged: DataFrame, by: list[str] = KEYS, rows: int = RANGE_ROWS) -> DataFrame:
    """The longest run of flagged rows of each window that has a flagged row; a run may go on over any number of tiles."""
    runs = islands(flagged.select(*by, "t", "flag"), F.col("flag"), "island", by, rows=rows)
    return runs.where("flag").groupBy(*by, "island").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("run"))


def summarise(flagged: DataFrame, channels: list[str], min_anomaly_rate: float = 0.05, name: str = "") -> DataFrame:
    flagged = kept(flagged)
    flags = F.col("flag").cast("double")
    hit = lambda c: F.avg(F.when(F.col("flag"), F.col(f"by_{c}")))
    agg = flagged.groupBy(*KEYS).agg(
        F.max("score").alias("score"), F.max("threshold").alias("threshold"), F.avg(flags).alias("anomaly_rate"), F.count("*").alias("n_points"),
        *[F.coalesce(hit(c), F.avg(f"by_{c}")).alias(f"w_{c}") for c in channels],
    )
    agg = agg.join(longest_runs(flagged), KEYS, "left")
    total = sum((F.col(f"w_{c}") for c in channels[1:]), F.col(f"w_{channels[0]}"))
    weights = [F.when(total > 0, F.col(f"w_{c}") / total).otherwise(F.lit(1.0 / len(channels))) for c in channels]
    return agg.select(
        *KEYS, "score", "threshold", "anomaly_rate", (F.col("anomaly_rate") >= min_anomaly_rate).alias("is_anomaly"),
        F.coalesce("run", F.lit(0)).cast("long").alias("run"), "n_points", F.lit(name).alias("detector"),
        F.map_from_arrays(F.array(*map(F.lit, channels)), F.array(*weights)).alias("attribution"),
    )


@DETECTORS.register("ewma")
class EwmaDetector(Detector):
    """Mean distance of the channels from their exponentially weighted forecasts."""

    name = "ewma"

    def __init__(self, alpha: float = 0.3, **kw) -> None:
        super().__init__(**kw)
        self.alpha = float(alpha)

    def _scored(self, prepared):
        out = ewma_forecasts(prepared, {f"f_{c}": F.col(c) for c in self.channels}, self.alpha, KEYS, rows=self.tile_rows)
        return out.withColumn("score", S.mean_of([F.abs(F.col(c) - F.col(f"f_{c}")) for c in self.channels]))


def moments(df: DataFrame, channels: list[str]) -> np.ndarray:
    """Sums of products of the channels and a column of ones, from one pass: a (C + 1) square matrix."""
    cols = [F.col(c) for c in channels] + [F.lit(1.0)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"m{i}_{j}"]
    return out


def linear(weights: np.ndarray, columns: list[Column]) -> Column:
    terms = [c * float(w) for w, c in zip(weights, columns, strict=True)]
    return sum(terms[1:], terms[0])


@DETECTORS.register("causal")
class CausalDetector(Detector):
    """Ridge regression of each channel on the others and a constant; root mean square of the scaled residuals."""

    name = "causal"

    def __init__(self, ridge: float = 1e-2, **kw) -> None:
        super().__init__(**kw)
        self.ridge = float(ridge)
        self.weights: list[np.ndarray] = []
        self.spread: list[float] = []

    def learn(self, df: DataFrame) -> None:
        if len(self.channels) < 2:
            return
        m, c = moments(df, self.channels), len(self.channels)
        self.weights, self.spread = [], []
        for j in range(c):
            rest = [i for i in range(c + 1) if i != j]
            w = np.zeros(c + 1)
            w[rest] = np.linalg.solve(m[np.ix_(rest, rest)] + self.ridge * np.eye(c), m[rest, j])
            v = -w
            v[j] = 1.0  # the residual as a combination of all columns
            mean, square = v @ m[:, c] / m[c, c], v @ m @ v / m[c, c]
            self.weights.append(v)
            self.spread.append(float(np.sqrt(max(square - mean * mean, 0.0))) + S.EPSILON)

    def residual(self, j: int) -> Column:
        return linear(self.weights[j], [*map(F.col, self.channels), F.lit(1.0)]) / self.spread[j]

    def parts(self, w):
        if len(self.channels) < 2:
            return [], F.abs(F.col(self.channels[0]))
        added = {f"r_{c}": self.residual(j) for j, c in enumerate(self.channels)}
        return [added], S.root_mean_square([F.col(f"r_{c}") for c in self.channels])

    def contributions(self):
        if len(self.channels) < 2:
            return super().contributions()
        return {c: F.abs(F.col(f"r_{c}")) for c in self.channels}


@DETECTORS.register("diffusion")
class DiffusionDetector(Detector):
    """Distance from the baseline's principal subspace that remains at every degree of smoothing (the least of them)."""

    name = "diffusion"

    def __init__(self, energy: float = 0.9, steps: tuple[float, ...] = (0.0, 1.0, 2.0, 4.0), **kw) -> None:
        super().__init__(**kw)
        self.energy, self.steps = float(energy), tuple(map(float, steps))
        self.mean = self.rest = None

    def learn(self, df: DataFrame) -> None:
        m, c = moments(df, self.channels), len(self.channels)
        n = m[c, c]
        self.mean = m[:c, c] / n
        scatter = m[:c, :c] - n * np.outer(self.mean, self.mean)
        value, vector = np.linalg.eigh(scatter)
        value, vector = np.maximum(value[::-1], 0.0), vector[:, ::-1]
        share = np.cumsum(value) / value.sum()
        k = max(1, min(int(np.searchsorted(share, self.energy)) + 1, c))
        self.rest = np.eye(c) - vector[:, :k] @ vector[:, :k].T

    def reach(self):
        radius = max(len(S.gaussian_kernel(sigma)) // 2 if sigma > 0 else 0 for sigma in self.steps)
        return radius, radius

    def parts(self, w):
        steps, norms, radius = [], [], self.reach()[0]
        steps.append({f"a_{c}": S.framed(F.col(c), radius, w) for c in self.channels})  # one frame for all degrees
        steps.append({f"s{i}_{c}": S.smooth_frame(F.col(f"a_{c}"), sigma, radius) for i, sigma in enumerate(self.steps) for c in self.channels})
        for i in range(len(self.steps)):
            centred = [F.col(f"s{i}_{c}") - float(self.mean[j]) for j, c in enumerate(self.channels)]
            parts = [linear(self.rest[j], centred) for j in range(len(self.channels))]
            norms.append(F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0])))
        return steps, F.least(*norms) if len(norms) > 1 else norms[0]


@DETECTORS.register("spatiotemporal")
class SpatiotemporalDetector(Detector):
    """Level, change and deviation from the other channels of smoothed series, scaled by the baseline."""

    name = "spatiotemporal"

    def __init__(self, detrend_window: int = 5, smooth_sigma: float = 1.0, **kw) -> None:
        super().__init__(**kw)
        self.detrend_window, self.smooth_sigma = int(detrend_window), float(smooth_sigma)
        self.norm3: Normaliser | None = None

    def _featured(self, df: DataFrame) -> DataFrame:
        radius, size = len(S.gaussian_kernel(self.smooth_sigma)) // 2 if self.smooth_sigma > 0 else 0, self.detrend_window
        tiles = tiled(df, KEYS, "t", radius + max(1, size // 2), radius + max(0, (size - 1) // 2), rows=self.tile_rows)
        out = tiles.rows.withColumns({f"s_{c}": S.smooth(F.col(c), self.smooth_sigma, tiles.window) for c in self.channels})
        mean = S.mean_of([F.col(f"s_{c}") for c in self.channels])
        level = {f"l_{c}": S.detrend(F.col(f"s_{c}"), size, tiles.window, F.lit(0.0)) for c in self.channels}
        others = {f"{k}_{c}": v for c in self.channels for k, v in (("d", S.difference(F.col(f"s_{c}"), tiles.window)), ("p", F.col(f"s_{c}") - mean))}
        out = tiles.own(out.withColumns(level | others))
        if size > 1:
            return out
        means = with_totals(out, KEYS, **{f"m_{c}": F.avg(f"s_{c}") for c in self.channels})
        return means.withColumns({f"l_{c}": F.col(f"s_{c}") - F.col(f"m_{c}") for c in self.channels}).drop(*[f"m_{c}" for c in self.channels])

    def learn(self, df: DataFrame) -> None:
        self.norm3 = Normaliser.z(self._featured(df), [f"{k}_{c}" for k in "ldp" for c in self.channels])

    def _scored(self, prepared: DataFrame) -> DataFrame:
        n = self.norm3
        scaled = [S.zscore(F.col(c), m, s) for c, m, s in zip(n.channels, n.centre, n.scale, strict=True)]
        return self._featured(prepared).withColumn("score", S.root_mean_square(scaled))


@DETECTORS.register("habituation")
class HabituationDetector(Detector):
    """Distance from the nearest microcluster of a habituating stream clustering, by its radius.

    Every stream of the baseline is clustered row by row in the order of its windows and of ``t``, streams in parallel, each
    as keyed state of one task.  Rows are scored against the model of their own stream, in Arrow batches by any number of
    tasks while the models together are small (``MODEL_BYTES``), else where the stream's model travels to.  With a single
    model all streams are scored by it; else a stream that the baseline lacks has no score and raises no flag.
    """

    name = "habituation"
    #: Bytes of all models as texts that tasks may carry.
    MODEL_BYTES = 32 << 20

    def __init__(self, n_clusters: int = 8, expansion: int = 40, density: float = 0.1, wta_frac: float = 0.05, alpha: float = 0.1, beta: float = 0.05, theta: float = 100.0, delta: int = 2, seed: int = 0, **kw) -> None:
        super().__init__(**kw)
        self.params = {"n_init": n_clusters, "expansion": expansion, "density": density, "wta_frac": wta_frac, "alpha": alpha, "beta": beta, "theta": theta, "delta": delta, "seed": seed}
        self.models: dict | None = None
        self.table: DataFrame | None = None

    def learn(self, df: DataFrame) -> None:
        from .ahsc import fit_streams

        table = kept(fit_streams(df, self.channels, self.params, "stream_id", ("stage", "t")))
        size = table.agg(F.sum(F.length("model"))).first()[0] or 0
        self.models, self.table = ({r["stream_id"]: r["model"] for r in table.collect()}, None) if size <= self.MODEL_BYTES else (None, table)

    def _scored(self, prepared: DataFrame) -> DataFrame:
        from .ahsc import StreamClusters, score_streams

        channels = self.channels
        if self.models is None:
            return score_streams(prepared, self.table, channels, [*KEYS, "t", *channels])
        texts, one = self.models, len(self.models) == 1
        rows = prepared.select(*KEYS, "t", *channels)
        schema = rows.withColumn("score", F.lit(None).cast("double")).schema
        workers_find_package(prepared.sparkSession)

        def run(frames):
            ready = {}
            for f in frames:
                score = np.full(len(f), np.nan)
                for stream in f["stream_id"].unique():
                    key = next(iter(texts)) if one else stream
                    if key in texts:
                        ready[key] = ready.get(key) or StreamClusters.from_json(texts[key])
                        mine = (f["stream_id"] == stream).to_numpy()
                        score[mine] = ready[key].scores(f.loc[mine, channels].to_numpy(float))
                yield f.assign(score=score)

        return rows.mapInPandas(run, schema)


@DETECTORS.register("ensemble")
class EnsembleDetector(Detector):
    """Fused scores of several detectors, each scaled within the window; attributions are summed and renormalised."""

    name = "ensemble"

    def __init__(self, members: list, method: str = "mean", weights: list[float] | None = None, **kw) -> None:
        super().__init__(**kw)
        self.members = [DETECTORS.create(m) if isinstance(m, str) else m for m in members]
        if not self.members:
            raise ConfigError("an ensemble needs members")
        self.method, self.weights = method, weights

    def fit(self, baseline: DataFrame) -> EnsembleDetector:
        for m in self.members:
            m.fit(baseline)
        self.channels, self.schema = self.members[0].channels, self.members[0].schema
        self.fitted = True
        self.threshold.fit(self.score(baseline))
        return self

    def score(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise NotFittedError("ensemble is not fitted")
        out = None
        for i, m in enumerate(self.members):
            one = m.score(df).select(*KEYS, "t", F.col("score").alias(f"m{i}"))
            out = one if out is None else out.join(one, [*KEYS, "t"])
        names = [f"m{i}" for i in range(len(self.members))]
        fused = fuse([F.col(c) for c in names], self.method, self.weights)
        return robust_scaled(out, names, KEYS).select(*KEYS, "t", fused.alias("score"))

    def results(self, df: DataFrame) -> DataFrame:
        df = kept(df)
        own = self.flagged(df).withColumns({f"by_{c}": F.lit(0.0) for c in self.channels})
        out = summarise(own, self.channels, self.min_anomaly_rate, self.name).drop("attribution")
        maps = None
        for m in self.members:
            one = m.results(df).select(*KEYS, "attribution")
            maps = one if maps is None else maps.unionByName(one)
        by_channel = maps.select(*KEYS, *[F.element_at("attribution", F.lit(c)).alias(c) for c in self.channels])
        total = by_channel.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in self.channels])
        whole = sum((F.col(c) for c in self.channels[1:]), F.col(self.channels[0]))
        merged = total.select(*KEYS, F.map_from_arrays(F.array(*map(F.lit, self.channels)), F.array(*[F.when(whole > 0, F.col(c) / whole).otherwise(F.col(c)) for c in self.channels])).alias("attribution"))
        return out.join(merged, KEYS)


def _optional(name: str, package: str, what: str):
    @DETECTORS.register(name)
    def make(**_):
        raise ConfigError(f"{what} needs the package {package}, which is not installed")

    return make


try:
    import sklearn  # noqa: F401
except ImportError:
    _optional("sklearn", "scikit-learn", "a detector around a foreign estimator")


@dataclass
class ForeignDetector:
    """Plug-in for a fitted estimator: ``score_rows`` maps a matrix to scores, in Arrow batches on the executors."""

    score_rows: object
    channels: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        fn, channels = self.score_rows, self.channels
        schema = df.select(*KEYS, "t").withColumn("score", F.lit(0.0)).schema

        def run(frames):
            for f in frames:
                yield f[[*KEYS, "t"]].assign(score=np.asarray(fn(f[channels].to_numpy(float)), float))

        return df.select(*KEYS, "t", *channels).mapInPandas(run, schema)


def build_threshold(spec):
    """A threshold from a name, a ``{name, ...}`` mapping or an object."""
    if isinstance(spec, str):
        return THRESHOLDS.create(spec)
    if isinstance(spec, dict):
        params = {k: v for k, v in spec.items() if k not in ("name", "params")} | dict(spec.get("params") or {})
        return THRESHOLDS.create(spec["name"], **params)
    return spec
