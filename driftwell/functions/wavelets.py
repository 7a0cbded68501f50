"""The slow part of a series by a wavelet filter bank, a tile of the series at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import workers_find_package
from .order import numbered
from .tiles import with_totals

#: The low-pass analysis filter of the Daubechies wavelet with four vanishing moments.
DB4 = (
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
)
LEVELS, SMOOTHED, DEGREE = 5, 51, 3
#: Rows of a tile.
TILE = 1 << 14


def reflected(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at any places of a series that is mirrored at its ends, the end values twice."""
    at = at % (2 * len(x))
    return x[np.minimum(at, 2 * len(x) - 1 - at)]


def analysed(x: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high half bands of a mirrored series, every second value of each."""
    high = low[::-1] * (-1.0) ** np.arange(1, len(low) + 1)
    first = np.arange((len(x) + len(low) - 1) // 2) * 2 + 1
    around = reflected(x, first[:, None] - np.arange(len(low))[None, :])
    return around @ low, around @ high


def synthesised(low_band: np.ndarray, high_band: np.ndarray | None, low: np.ndarray) -> np.ndarray:
    """The series of two half bands (none: zero), two values for each of theirs less what the filter overlaps."""
    out = 0.0
    for band, taps in ((low_band, low[::-1]), (high_band, low * (-1.0) ** np.arange(len(low)))):
        if band is None:
            continue
        spaced = np.zeros(2 * len(band))
        spaced[::2] = band
        out = out + np.convolve(spaced, taps)[len(low) - 2 : 2 * len(band)]
    return out


def polynomial_smooth(x: np.ndarray, window: int, degree: int) -> np.ndarray:
    """Local polynomials through ``window`` values; at the ends the first and last polynomial go on."""
    if window > len(x):
        raise ValueError(f"{len(x)} coefficients are too few to smooth over {window}")
    half = window // 2
    base = np.vander(np.arange(window) - half, degree + 1, increasing=True)
    fit = np.linalg.pinv(base)
    out = np.convolve(x, fit[0][::-1], "same")
    out[:half] = (base @ (fit @ x[:window]))[:half]
    out[-half:] = (base @ (fit @ x[-window:]))[-half:]
    return out


def trend(x: np.ndarray, level: int = LEVELS, smooth: bool = False, window: int = SMOOTHED, degree: int = DEGREE, low: tuple[float, ...] = DB4) -> np.ndarray:
    """The series made of the lowest band alone; bands between keep the lengths that the synthesis gives them."""
    taps, band = np.array(low), x
    for _ in range(level):
        band = analysed(band, taps)[0]
    if smooth:
        band = polynomial_smooth(band, window, degree)
    for _ in range(level):
        band = synthesised(band, None, taps)
    return band[: len(x)]


def wavelet_trend(df: DataFrame, columns: list[str], by: list[str], order: str = "t", level: int = LEVELS, smooth: bool = False, window: int = SMOOTHED, degree: int = DEGREE, tile: int = TILE) -> DataFrame:
    """Adds ``trend_<column>`` and ``stable_<column>`` (the value less its trend) to rows of any number of series.

    A value's trend depends on a bounded stretch around it, so a series is worked on in tiles that start at multiples of
    ``2 ** level`` rows (then all tiles take the same every-second values) and hold rows on both sides; only where the
    series itself ends is it mirrored.  Rows are numbered in their order, so gaps and uneven steps of ``order`` do not
    matter.  Null and NaN spread over their stretch.  Smoothing needs ``window`` values of the lowest band.
    """
    workers_find_package(df.sparkSession)
    step = 1 << level
    halo = step * (2 * len(DB4) + (window // 2 + 1 if smooth else 0))
    tile = max(1, tile // step) * step
    rows = with_totals(numbered(df, "__p", F.col(order), by=by), by, __n=F.count("*")).withColumn("__p", F.col("__p") - 1)
    touched = F.sequence(F.greatest(F.floor((F.col("__p") - halo) / tile), F.lit(0)), F.floor((F.col("__p") + halo) / tile))
    copies = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], "__p", "__n", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.explode(touched).alias("__tile")).where(f"__tile * {tile} < __n")
    keys = [f"k{i}" for i in range(len(by))]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__p")
        place, n, at = (table.column(c).to_numpy() for c in ("__p", "__n", "__tile"))
        mine = (place >= at[0] * tile) & (place < min(n[0], (at[0] + 1) * tile))
        out = {c: table.column(c).filter(pa.array(mine)) for c in [*keys, "__p"]}
        for i in range(len(columns)):
            out[f"y{i}"] = trend(table.column(f"x{i}").to_numpy(), level, smooth, window, degree)[mine]
        return pa.table(out)

    kinds = dict(copies.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "__p long", *[f"y{i} double" for i in range(len(columns))]])
    got = copies.groupBy(*keys, "__tile").applyInArrow(run, schema)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{k}")) for c, k in zip(by, keys, strict=True)]
    out = rows.alias("a").join(got.alias("b"), [*same, F.col("a.__p") == F.col("b.__p")])
    trends = [F.col(f"b.y{i}").alias(f"trend_{c}") for i, c in enumerate(columns)]
    stable = [(F.col(f"a.{c}") - F.col(f"b.y{i}")).alias(f"stable_{c}") for i, c in enumerate(columns)]
    return out.select(*[F.col(f"a.{c}") for c in df.columns], *trends, *stable)

