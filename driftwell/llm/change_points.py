"""Penalised change points: the daily series of many vendors cut into segments of even spread, many vendors at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, trimmed

#: Days of the shortest segment, and cost of a cut.
MIN_DAYS, PENALTY = 5, 10_000
#: Cells (vendors by padded days) of a batch of series; a dozen arrays of this size are held at a time.
CELLS = 1 << 16
#: Above, ``n * Q`` may not fit into 63 bits and a batch is computed with Python's integers.
SAFE = 1 << 62
_NEVER = 1 << 60

SEGMENTS = "segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"


def daily_sums(rows: DataFrame, by: list[str], day: Column, value: Column) -> DataFrame:
    """``by, first_day, days, sums``: what each key has summed up to on each of its days, days since 1970.

    Days are summed before the days of a key meet, so a key with a third of all rows sends one row per task and day.
    Rows without a day or value are left out; a null key is a key.
    """
    rows = rows.select(*by, F.unix_date(day.cast("date")).alias("__day"), value.cast("long").alias("__value")).where("__day is not null and __value is not null")
    days = rows.groupBy(*by, "__day").agg(F.sum("__value").alias("__sum"))
    series = days.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__day", "__sum"))).alias("__s"))
    return series.select(*by, F.col("__s.__day").alias("days"), F.col("__s.__sum").alias("sums"))


def _cost(n: np.ndarray | int, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spread and cost of segments of ``n`` days with sum ``s`` and sum of squares ``q``."""
    spread = (n * q - s * s) // (n * n) + 1
    return spread, n * np.floor(1000 * np.log(spread.astype(np.float64))).astype(np.int64)


def best_segments(values: np.ndarray, length: np.ndarray, least: int = MIN_DAYS, penalty: int = PENALTY) -> dict[str, np.ndarray]:
    """Cuts the rows of a padded tensor (series by days, beyond ``length`` anything) at the least penalised cost.

    One sweep over the days: for every end the costs of all starts of all series are one masked matrix, and argmin takes,
    of the least totals with the fewest segments, the earliest start.  Returns columns of segments, by row and start.
    """
    rows, width = values.shape
    one = values.astype(object) if values.dtype == object else values.astype(np.int64)
    sums = np.zeros((rows, width + 1), one.dtype)
    squares = np.zeros((rows, width + 1), one.dtype)
    np.cumsum(one, axis=1, out=sums[:, 1:])
    np.cumsum(one * one, axis=1, out=squares[:, 1:])
    shortest = np.minimum(length, least)  # a series shorter than a segment is one
    best = np.full((rows, width + 1), _NEVER, np.int64)
    parts = np.zeros((rows, width + 1), np.int64)
    came = np.zeros((rows, width + 1), np.int64)
    best[:, 0] = -penalty
    everyone = np.arange(rows)
    for end in range(max(1, int(shortest.min(initial=1))), width + 1):
        n = np.arange(end, 0, -1, dtype=np.int64)
        _, cost = _cost(n, sums[:, end, None] - sums[:, :end], squares[:, end, None] - squares[:, :end])
        total = best[:, :end] + cost + penalty
        total[(n[None, :] < shortest[:, None]) | (best[:, :end] >= _NEVER)] = _NEVER
        least_total = total.min(axis=1)
        count = np.where(total == least_total[:, None], parts[:, :end], width + 1)
        start = count.argmin(axis=1)
        best[:, end] = least_total
        parts[:, end] = count[everyone, start] + 1
        came[:, end] = start
    of, starts, ends = [], [], []
    at, active = length.copy(), everyone
    while len(active):
        of.append(active)
        ends.append(at[active])
        at[active] = came[active, at[active]]
        starts.append(at[active])
        active = active[at[active] > 0]
    of, starts, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (of, starts, ends))
    order = np.lexsort((starts, of))
    of, starts, ends = of[order], starts[order], ends[order]
    n, total = ends - starts, sums[of, ends] - sums[of, starts]
    spread, cost = _cost(n, total, squares[of, ends] - squares[of, starts])
    return {
        "row": of, "start": starts, "segment_no": np.arange(len(of)) - np.searchsorted(of, of) + 1, "n_days": n, "total": total, "spread": spread, "cost": cost,
        "n_segments": parts[of, length[of]], "best_cost": best[of, length[of]],
    }


def _cut(batch: pa.RecordBatch, least: int, penalty: int) -> Iterator[pa.RecordBatch]:
    """Segments of the series of an Arrow batch (keys, days, sums), series of like length together."""
    keys, days, sums = batch.columns[:-2], batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    offset = days.offsets.to_numpy()
    day, value = days.values.to_numpy().astype(np.int64), sums.values.to_numpy()
    first, last = day[offset[:-1]], day[offset[1:] - 1]
    length = last - first + 1
    order, lo = np.argsort(length, kind="stable"), 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * (length[order[hi]] + 1) <= CELLS:
            hi += 1
        rows, lo = order[lo:hi], hi
        width, held = int(length[rows].max()), offset[rows + 1] - offset[rows]
        pick = np.repeat(offset[rows] - np.cumsum(held) + held, held) + np.arange(held.sum())
        most = int(np.abs(value[pick].astype(object)).max())
        values = np.zeros((len(rows), width), object if width * width * most * most >= SAFE else np.int64)
        values[np.repeat(np.arange(len(rows)), held), day[pick] - np.repeat(first[rows], held)] = value[pick]
        out = best_segments(values, length[rows], least, penalty)
        source = rows[out["row"]]
        columns = [k.take(pa.array(source)) for k in keys]
        columns += [pa.array(out["segment_no"].astype(np.int32)), pa.array(first[source] + out["start"])]
        columns += [pa.array(out[c].astype(np.int64)) for c in ("n_days", "total", "spread", "cost", "n_segments", "best_cost")]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-2], *[c.split()[0] for c in SEGMENTS.split(", ")]])


def change_points(series: DataFrame, by: list[str], least: int = MIN_DAYS, penalty: int = PENALTY) -> DataFrame:
    """The segments of every series of ``daily_sums``: ``by`` and the columns of ``SEGMENTS``.

    A series has at least one day; days without a sum count 0.  A segment has ``least`` days or more, a shorter series is
    one segment.  Its cost is ``n * floor(1000 * ln(V))`` with ``V = 1 + floor((n * Q - S * S) / (n * n))`` in exact
    integers, at any size of sums whose totals fit into a long.  Of the cheapest cuts the one with the fewest segments
    stands, then the one with the earliest starts, compared from the last segment backwards.  A series takes memory in
    proportion to its days and time to their square; it is the only thing that one task holds whole.  Empty tables give
    none; columns other than ``by``, ``days`` and ``sums`` are not read.
    """
    bounded_batches(series.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _cut(batch, least, penalty)
        trimmed()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.select(*by).schema.fields)
    return series.select(*by, "days", "sums").mapInArrow(run, f"{kinds}, {SEGMENTS}")


def vendor_changes(lines: DataFrame) -> DataFrame:
    """``vendor_id`` and the segments of its daily quantities, of lines flagged kept or swapped."""
    taken = lines.where(F.col("flag").isin("kept", "swapped"))
    return change_points(daily_sums(taken, ["vendor_id"], F.col("shipped_at"), F.col("quantity")), ["vendor_id"])


#: One row of the recursion per vendor and day; it carries the best totals, segments and starts of all earlier days.
ORACLE = r"""
with recursive t as (
  select vendor_id, date_diff('day', date '1970-01-01', cast(shipped_at as date)) as day, sum(quantity)::bigint as q
  from sale_lines where flag in ('kept', 'swapped') and quantity is not null and shipped_at is not null group by all
), v as (
  select coalesce(vendor_id, -9223372036854775807) as k, min(day) as lo, max(day) as hi from t group by all
), p as (
  select k, any_value(lo) as lo, list(s order by i) as s, list(qq order by i) as qq, max(i) as n, least(max(i), 5) as shortest
  from (
    select k, lo, i, sum(q) over w as s, sum(q * q) over w as qq
    from (
      select v.k, v.lo, g.i, coalesce(t.q, 0)::hugeint as q
      from v, lateral (select unnest(range(0, hi - lo + 2)) as i) g
      left join t on coalesce(t.vendor_id, -9223372036854775807) = v.k and t.day = v.lo + g.i - 1
    ) window w as (partition by k order by i)
  ) group by k
), r as (
  select k, 0 as e, [(-10000)::bigint] as best, [0::bigint] as parts, [0::bigint] as came from p
  union all
  select k, e, list_append(best, (x // 1000000000000)::bigint - 1000000), list_append(parts, ((x // 1000000) % 1000000)::bigint), list_append(came, (x % 1000000)::bigint)
  from (
    select r.k, r.e + 1 as e, r.best, r.parts, r.came, coalesce(list_min(list_transform(
      list_filter(range(0, r.e + 1), lambda a: r.e + 1 - a >= p.shortest and r.best[a + 1] < 1000000000000000),
      lambda a: (r.best[a + 1] + 1010000 + (r.e + 1 - a) * floor(1000 * ln((1 + ((r.e + 1 - a) * (p.qq[r.e + 2] - p.qq[a + 1]) - (p.s[r.e + 2] - p.s[a + 1]) * (p.s[r.e + 2] - p.s[a + 1])) // ((r.e + 1 - a) * (r.e + 1 - a)))::double))::bigint)::hugeint * 1000000000000
        + (r.parts[a + 1] + 1) * 1000000 + a
    )), 2000000000000000::hugeint * 1000000000000) as x
    from r join p using (k) where r.e < p.n
  )
), b as (
  select r.k, p.n as stop, r.came[p.n + 1] as start, r.came, r.parts[p.n + 1] as n_segments, r.best[p.n + 1] as best_cost from r join p on r.k = p.k and r.e = p.n
), c as (
  select * from b
  union all
  select k, start, came[start + 1], came, n_segments, best_cost from c where start > 0
), d as (
  select c.*, p.lo, c.stop - c.start as n, p.s[stop + 1] - p.s[start + 1] as total,
    1 + ((c.stop - c.start) * (p.qq[stop + 1] - p.qq[start + 1]) - (p.s[stop + 1] - p.s[start + 1]) * (p.s[stop + 1] - p.s[start + 1])) // ((c.stop - c.start) * (c.stop - c.start)) as spread
  from c join p using (k)
)
select nullif(k, -9223372036854775807) as vendor_id, (row_number() over (partition by k order by start))::int as segment_no, (lo + start)::bigint as first_day, n::bigint as n_days,
  total::bigint as total, spread::bigint as spread, (n * floor(1000 * ln(spread::double)))::bigint as cost, n_segments::bigint as n_segments, best_cost::bigint as best_cost
from d
"""
