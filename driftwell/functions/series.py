"""Column functions over ordered series; their windows are those of a series, or of a tile of one (``tiles.py``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Added to standard deviations, quartile ranges and median deviations before dividing.
EPSILON = 1e-8


def ordered(by: list[str], order: str = "t") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def zscore(x: Column, mean: float | Column, std: float | Column) -> Column:
    return (x - mean) / (std + F.lit(EPSILON))


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights of a normalised Gaussian kernel of radius ``max(1, int(3 * sigma))``."""
    radius = max(1, int(3 * sigma))
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def smooth(x: Column, sigma: float, w: WindowSpec) -> Column:
    """Gaussian smoothing; rows beyond the ends of a series count as zero and weights are not renormalised."""
    if sigma <= 0:
        return x
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2
    out = x * kernel[radius]
    for k in range(1, radius + 1):
        out = out + F.coalesce(F.lag(x, k).over(w), F.lit(0.0)) * kernel[radius - k] + F.coalesce(F.lead(x, k).over(w), F.lit(0.0)) * kernel[radius + k]
    return out


def framed(x: Column, radius: int, w: WindowSpec) -> Column:
    """The rows up to ``radius`` before and after each row as a struct: their values in order, and how many are before."""
    around = w.rowsBetween(-radius, radius)
    return F.struct(F.collect_list(F.coalesce(x, F.lit(0.0))).over(around).alias("x"), F.least(F.row_number().over(w) - 1, F.lit(radius)).alias("before"))


def smooth_frame(frame: Column, sigma: float, radius: int) -> Column:
    """``smooth`` of the middle row of a frame of ``framed``, whose radius may be larger than the kernel's."""
    kernel = gaussian_kernel(sigma) if sigma > 0 else [1.0]
    edge = [0.0] * (radius - len(kernel) // 2)
    weights = F.array(*[F.lit(k) for k in (*edge, *kernel, *edge)])
    parts = F.transform(frame["x"], lambda v, i: v * F.get(weights, i - frame["before"].cast("int") + radius))
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)


def detrend(x: Column, size: int, w: WindowSpec, mean: Column) -> Column:
    """``x`` less the moving sum over ``size`` rows by ``size``; for a size of 1 or less, less the ``mean`` of the series."""
    if size <= 1:
        return x - mean
    return x - F.sum(x).over(w.rowsBetween(-(size // 2), (size - 1) // 2)) / size


def difference(x: Column, w: WindowSpec) -> Column:
    return F.coalesce(x - F.lag(x).over(w), F.lit(0.0))


def ewma_memory(alpha: float) -> int:
    """Rows after which an earlier value weighs less than 1e-17."""
    return max(1, math.ceil(math.log(1e-17) / math.log(1 - alpha))) if alpha < 1 else 1


def ewma_forecast(x: Column, alpha: float, w: WindowSpec) -> Column:
    """Exponentially weighted forecast of each row from those before it; the first row forecasts itself.

    Folds the rows that still weigh anything in double precision, so memory per row is bounded and long series need no
    state beyond the window frame.
    """
    past = F.collect_list(x).over(w.rowsBetween(-ewma_memory(alpha), -1))
    folded = F.aggregate(past, F.get(past, F.lit(0)), lambda p, v: v * alpha + p * (1 - alpha))
    return F.when(F.size(past) > 0, folded).otherwise(x)


def run_length(flag: Column, by: list[str], order: str = "t") -> Column:
    """An island number that is the same for neighbouring rows of equal ``flag``."""
    return F.row_number().over(ordered(by, order)) - F.row_number().over(Window.partitionBy(*by, flag).orderBy(order))


def exceeds(score: Column, threshold: Column | float) -> Column:
    """Strictly greater; NaN never exceeds."""
    return F.coalesce(~F.isnan(score) & (score > threshold), F.lit(False))


def root_mean_square(columns: list[Column]) -> Column:
    total = columns[0] * columns[0]
    for c in columns[1:]:
        total = total + c * c
    return F.sqrt(total / len(columns))


def mean_of(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / len(columns)


def softplus(x: Column) -> Column:
    """``ln(1 + e**x)``, without overflow for large x."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    """``1 / (1 + e**-x)``, without overflow for large negative x."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))
