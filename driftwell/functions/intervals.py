"""Half-open intervals: algebra, affiliation zones, and the closed forms of precision and recall by affiliation, for
numbers on the driver and as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Interval = tuple[float, float]


def length(i: Interval | None) -> float:
    return 0.0 if i is None else i[1] - i[0]


def overlap(a: Interval, b: Interval) -> Interval | None:
    lo, hi = max(a[0], b[0]), min(a[1], b[1])
    return (lo, hi) if lo < hi else None


def split_by(i: Interval, j: Interval) -> tuple[Interval | None, Interval | None, Interval | None]:
    """The parts of ``i`` before, within and after ``j``."""
    before = (i[0], min(i[1], j[0])) if i[0] < j[0] else None
    after = (max(i[0], j[1]), i[1]) if i[1] > j[1] else None
    return before, overlap(i, j), after


def zones(events: list[Interval], span: Interval) -> list[Interval]:
    """For each event the part of the span nearer to it than to another; the outer zones end with the span.

    With an infinite span the outer zones are infinite.
    """
    cuts = [(a[1] + b[0]) / 2 for a, b in zip(events, events[1:], strict=False)]
    return list(zip([span[0], *cuts], [*cuts, span[1]], strict=True))


def parts_in(events: list[Interval], zone: Interval) -> list[Interval]:
    return [p for e in events if (p := overlap(e, zone))]


def _distance_mass(i: Interval, j: Interval) -> float:
    """Integral over ``i`` of the distance to ``j``."""
    before, _, after = split_by(i, j)
    out = 0.0
    for part, border in ((before, j[0]), (after, j[1])):
        if part:
            out += length(part) * abs(border - (part[0] + part[1]) / 2)
    return out


def _precision_mass(i: Interval, j: Interval, e: Interval) -> float:
    """Integral over ``i`` of the chance that a random point of ``e`` is no nearer to ``j`` than the point of ``i``."""
    before, inside, after = split_by(i, j)
    out = length(inside)
    room, near = e[1] - e[0], min(j[0] - e[0], e[1] - j[1])
    for part in (before, after):
        if part is None:
            continue
        d0, d1 = (part[0] - j[1], part[1] - j[1]) if part[0] >= j[1] else (j[0] - part[1], j[0] - part[0])
        # of a distance d the farther points are the zone less j, less d on the own side, less min(d, near) on the other
        clipped = (min(d1, near) ** 2 - min(d0, near) ** 2) / 2 + near * (max(d1, near) - max(d0, near))
        out += length(part) - (clipped + (d1 * d1 - d0 * d0) / 2 + length(j) * length(part)) / room
    return out


def _clipped_line(a: float, b: float, pivot: float, e: Interval) -> float:
    """Integral over t in (a, b) of ``min(|t - pivot|, min(t - e0, e1 - t)) + |t - pivot|``."""
    knots = {a, b}
    for k in (pivot, (e[0] + e[1]) / 2, (pivot + e[0]) / 2, (pivot + e[1]) / 2):
        if a < k < b:
            knots.add(k)
    points = sorted(knots)
    value = lambda t: min(abs(t - pivot), min(t - e[0], e[1] - t)) + abs(t - pivot)
    return sum((y - x) * (value(x) + value(y)) / 2 for x, y in zip(points, points[1:], strict=False))


def _recall_mass(i: Interval, j: Interval, e: Interval) -> float:
    """Integral over ``j`` of the chance that a random point of ``e`` is no nearer to the point of ``j`` than ``i``."""
    before, inside, after = split_by(j, i)
    out = length(inside)
    for part, pivot in ((before, i[0]), (after, i[1])):
        if part is None or not e[0] <= pivot <= e[1]:
            continue
        out += length(part) - _clipped_line(part[0], part[1], pivot, e) / (e[1] - e[0])
    return out


Bounds = tuple[Column, Column]


def _half_squares(a: Column, b: Column) -> Column:
    """Integral of x from a to b."""
    return (b * b - a * a) / 2


def precision_mass(i: Bounds, j: Bounds, e: Bounds) -> Column:
    """``_precision_mass`` over columns: of a part ``i`` of the zone ``e`` of the event ``j``."""
    room, near = e[1] - e[0], F.least(j[0] - e[0], e[1] - j[1])
    clip = lambda d: F.least(d, near)
    out = F.greatest(F.least(i[1], j[1]) - F.greatest(i[0], j[0]), F.lit(0.0))
    for d0, d1 in ((j[0] - F.least(i[1], j[0]), j[0] - F.least(i[0], j[0])), (F.greatest(i[0], j[1]) - j[1], F.greatest(i[1], j[1]) - j[1])):
        clipped = _half_squares(clip(d0), clip(d1)) + near * ((d1 - clip(d1)) - (d0 - clip(d0)))
        out = out + (d1 - d0) - (clipped + _half_squares(d0, d1) + (j[1] - j[0]) * (d1 - d0)) / room
    return out


def recall_mass(i: Bounds, j: Bounds, e: Bounds) -> Column:
    """``_recall_mass`` over columns: of a stretch ``j`` of the event that is nearest to the part ``i`` of the zone ``e``.

    Left and right of the part the distance from it is a line, and so is the distance to the zone's end on that side; the
    lesser of the two changes where they meet.
    """
    out = F.greatest(F.least(i[1], j[1]) - F.greatest(i[0], j[0]), F.lit(0.0))
    for far0, far1, room in (
        (i[0] - F.least(j[1], i[0]), i[0] - F.least(j[0], i[0]), i[0] - e[0]),
        (F.greatest(j[0], i[1]) - i[1], F.greatest(j[1], i[1]) - i[1], e[1] - i[1]),
    ):
        # over distances d from far0 to far1 the integral of d, and of the lesser of d and room - d
        meet = F.least(F.greatest(room / 2, far0), far1)
        lesser = _half_squares(far0, meet) + _half_squares(room - far1, room - meet)
        out = out + (far1 - far0) - (lesser + _half_squares(far0, far1)) / (e[1] - e[0])
    return out


def precision(pred: list[Interval], j: Interval, e: Interval | None = None) -> float:
    """Precision of the predictions in the zone of ``j`` (a mean distance without a zone); NaN without predictions."""
    if not pred:
        return math.nan
    mass = sum(_distance_mass(i, j) if e is None else _precision_mass(i, j, e) for i in pred)
    return mass / sum(map(length, pred))


def recall(pred: list[Interval], j: Interval, e: Interval | None = None) -> float:
    """Recall of ``j`` by the predictions in its zone: each part of ``j`` is held against the nearest prediction."""
    if not pred:
        return math.inf if e is None else 0.0
    out = 0.0
    for i, zone in zip(pred, zones(pred, (-math.inf, math.inf) if e is None else e), strict=True):
        part = overlap(j, zone)
        if part:
            out += _distance_mass(part, i) if e is None else _recall_mass(i, part, e)
    return out / length(j)


def check_events(events: list[Interval]) -> None:
    """Raises ValueError unless events are ordered, apart and of positive length."""
    for a, b in events:
        if b <= a:
            raise ValueError("events need a positive length")
    for a, b in zip(events, events[1:], strict=False):
        if a[1] > b[0]:
            raise ValueError("events must be ordered and must not overlap")


def affiliation(pred: list[Interval], truth: list[Interval], span: Interval) -> dict[str, float]:
    """Mean precision (zones without predictions left out) and recall over the ground-truth events, and their F1."""
    check_events(pred)
    check_events(truth)
    if not truth:
        raise ValueError("there is no ground-truth event")
    if min(truth[0][0], pred[0][0] if pred else math.inf) < span[0] or max(truth[-1][1], pred[-1][1] if pred else -math.inf) > span[1]:
        raise ValueError("events leave the span of the series")
    p, r = [], []
    for j, e in zip(truth, zones(truth, span), strict=True):
        inside = parts_in(pred, e)
        p.append(precision(inside, j, e))
        r.append(recall(inside, j, e))
    known = [x for x in p if not math.isnan(x)]
    mean_p = sum(known) / len(known) if known else math.nan
    mean_r = sum(r) / len(r)
    f1 = 2 * mean_p * mean_r / (mean_p + mean_r) if mean_p + mean_r > 0 else 0.0
    return {"precision": mean_p, "recall": mean_r, "f1": f1}
