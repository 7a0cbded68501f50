"""DuckDB SQL with the rows of the registered queries."""

from __future__ import annotations

import math

import numpy as np

from .functions.series import ewma_memory, gaussian_kernel
from .functions.wavelets import DB4
from .operators.policy import TIERS
from .plans.observability import TRANSITIONS
from .plans.rollout import ROLLOUTS
from .queries import BASELINE, BOARD_SHARE, CHANNELS, ME, PIN_SHARE, WINDOW

C = CHANNELS
_each = lambda f: ", ".join(f(c) for c in C)

HOURLY = f"""ev as (select floor(epoch(ts) / 3600)::bigint as h, event_type as e from events),
sp as (select min(h) as lo, max(h) as hi from ev),
spine as (select unnest(range(lo, hi + 1)) as h, lo from sp),
cnt as (select h, {_each(lambda c: f"count(*) filter (where e = '{c}') as {c}")} from ev group by h),
hourly as (select 'events' as stream_id, (spine.h - lo)::bigint as t, {_each(lambda c: f"coalesce({c}, 0)::double as {c}")} from spine left join cnt using (h)),
st0 as (select stream_id, case when t < {BASELINE} then -1 else floor((t - {BASELINE}) / {WINDOW}.0)::int end as stage, t as t0, {', '.join(C)} from hourly),
staged as (select stream_id, stage, t0 - case when stage < 0 then 0 else {BASELINE} + stage * {WINDOW} end as t, {', '.join(C)} from st0),
faulty as (select stream_id, stage, t,
  click + case when stage >= 4 and t >= 8 then 40.0 else 0 end as click,
  error + case when stage = 3 and t >= 10 then (t - 10) * 2.0 when stage >= 4 and t >= 8 then 40.0 else 0 end as error, purchase, signup, view from staged)"""


def _norm(source: str) -> str:
    return f""", par as (select {_each(lambda c: f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}")} from {source} where stage = -1),
zn as (select stream_id, stage, t, {_each(lambda c: f"({c} - m_{c}) / (s_{c} + 1e-8) as {c}")} from {source}, par),
sc as (select stream_id, stage, t, ({' + '.join(f'abs({c})' for c in C)}) / {len(C)} as score, {_each(lambda c: f"abs({c}) as by_{c}")} from zn)"""


def _with(source: str = "staged", more: str = "") -> str:
    return f"with {HOURLY}{_norm(source)}{more}"


_SIGMA = "(select avg(score) + 3 * (stddev_pop(score) + 1e-8) from sc where stage = -1)"
FLAGGED = f""", fl as (select *, score > threshold as flag from (select *, {_SIGMA} as threshold from sc where stage >= 0)),
isl as (select *, row_number() over (partition by stream_id, stage order by t) - row_number() over (partition by stream_id, stage, flag order by t) as island from fl),
rn as (select stream_id, stage, max(n) as run from (select stream_id, stage, island, count(*) as n from isl where flag group by all) group by all),
ws as (select stream_id, stage, max(score) as score, max(threshold) as threshold, avg(flag::int) as anomaly_rate, count(*) as n_points,
  {_each(lambda c: f"coalesce(avg(by_{c}) filter (where flag), avg(by_{c})) as w_{c}")} from fl group by stream_id, stage),
res as (select stream_id, stage, score, threshold, anomaly_rate, anomaly_rate >= 0.05 as is_anomaly, coalesce(run, 0) as run, n_points,
  {_each(lambda c: f"w_{c} / ({' + '.join(f'w_{k}' for k in C)}) as {c}")} from ws left join rn using (stream_id, stage))"""


def _action(tier: str) -> str:
    t = TIERS[tier]
    ratio = f"(threshold <= 0 or score / threshold >= {t['severity_ratio']})"
    return f"case when run >= {t['min_persistence']} and (anomaly_rate >= {t['max_anomaly_rate']} or {ratio}) then 'rollback' when anomaly_rate >= {t['max_anomaly_rate']}::double * {t['hold_fraction']}::double then 'hold' else 'promote' end"


def _round(cols: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in cols.split())


def _smoothed(c: str, sigma: float = 1.0, part: str = "o") -> str:
    k = gaussian_kernel(sigma)
    r = len(k) // 2
    terms = [f"{c} * {k[r]!r}"]
    for i in range(1, r + 1):
        terms += [f"coalesce(lag({c}, {i}) over {part}, 0) * {k[r - i]!r}", f"coalesce(lead({c}, {i}) over {part}, 0) * {k[r + i]!r}"]
    return " + ".join(terms)


def _threshold(expr: str) -> str:
    return _with("faulty") + f"""select stream_id, stage, round(max(threshold), 6) as threshold, sum((score > threshold)::int)::bigint as flags
from (select *, {expr} as threshold from sc where stage >= 0) group by stream_id, stage"""


def _robust(names: str) -> str:
    """Columns of ``sc`` scaled by their window's median and median deviation."""
    cols = names.split()
    med = ", ".join(f"median({c}) over w as m_{c}" for c in cols)
    dev = ", ".join(f"median(abs({c} - m_{c})) over w as d_{c}" for c in cols)
    out = ", ".join(f"({c} - m_{c}) / (1.4826 * (d_{c} + 1e-8)) as z_{c}" for c in cols)
    return f"""(select stream_id, stage, t, {out} from (select *, {dev} from (select *, {med} from sc where stage >= 0 window w as (partition by stream_id, stage)) window w as (partition by stream_id, stage)))"""


def _ewma(source: str) -> str:
    n = ewma_memory(0.3)
    past = lambda c: f"list({c}) over (partition by stream_id, stage order by t rows between {n} preceding and 1 preceding)"
    fold = lambda c: f"coalesce(list_reduce(list_prepend(p_{c}[1], p_{c}), lambda p, v: v * 0.3::double + p * (1 - 0.3::double)), {c})"
    return f"""select stream_id, stage, t, round(({' + '.join(f'abs({c} - {fold(c)})' for c in C)}) / {len(C)}, 6) as score
from (select *, {_each(lambda c: f"{past(c)} as p_{c}")} from {source}) where stage >= 0"""


LABELLED = "lb as (select doc_id, toxic::int as label, n_chars / 1000.0::double as score from labels join documents using (doc_id))"
PRF = """round(precision, 6) as precision, round(recall, 6) as recall,
  round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1"""
TRUTH = """ht as (select stream_id, t, (t % 24 >= 20 or t % 24 < 2)::int as label, click as score, (click * 7 + t) % 5 = 0 as flag from hourly)"""


def _best(source: str) -> str:
    return f"""select round(score, 6) as threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, tp as pred_anomaly, n_pos as true_anomaly from (
  select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from (
    select score, tp, n_pos, tp / hits::double as precision, case when n_pos > 0 then tp / n_pos::double else 0 end as recall from (
      select score, sum(pos) over (order by score desc)::bigint as tp, sum(n) over (order by score desc)::bigint as hits, sum(pos) over ()::bigint as n_pos
      from (select score, sum(label) as pos, count(*) as n from {source} group by score))))
order by f1 desc, score limit 1"""


def _events(flag: str, name: str) -> str:
    return f"""{name} as (select stream_id, min(t) as start, max(t) + 1 as stop from (
  select *, row_number() over (partition by stream_id order by t) - row_number() over (partition by stream_id, {flag} order by t) as island from ht) where {flag}::int = 1 group by stream_id, island)"""


ZONES = f"""{HOURLY}, {TRUTH}, {_events('label', 'truth')}, {_events('flag', 'pred')},
span as (select stream_id, max(t) + 1 as hi from ht group by stream_id),
zn as (select stream_id as series_id, start::double as start, stop::double as stop,
  coalesce((lag(stop) over w + start) / 2, 0)::double as zone_lo, coalesce((stop + lead(start) over w) / 2, hi)::double as zone_hi
  from truth join span using (stream_id) window w as (partition by stream_id order by start))"""

HALVES = f"""{HOURLY}, {TRUTH}, te as (select stream_id, t - {BASELINE} as t, label, score from ht where t >= {BASELINE}), ct as (select quantile_cont(score, 0.8) as cut from ht),
rk as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from te),
au as (select round((sum(rk) filter (where label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6)::double as auc from rk)"""


def _affiliated(g: str) -> str:
    """Precision and recall by affiliation of the rows ``hits`` (group, t) against the labels of ``te``, for each group."""
    half = lambda d0, d1: f"((({d1}) * ({d1}) - ({d0}) * ({d0})) / 2)"

    def precise(d0: str, d1: str) -> str:
        clip = lambda d: f"least({d}, near)"
        return f"({d1} - {d0}) - ({half(clip(d0), clip(d1))} + near * (({d1} - {clip(d1)}) - ({d0} - {clip(d0)})) + {half(d0, d1)} + (e - s) * ({d1} - {d0})) / room"

    def recalled(d0: str, d1: str, side: str) -> str:
        meet = f"least(greatest(({side}) / 2, {d0}), {d1})"
        return f"({d1} - {d0}) - ({half(d0, meet)} + {half(f'({side}) - {d1}', f'({side}) - {meet}')} + {half(d0, d1)}) / room"

    return f"""hi as (select max(t) + 1 as hi from te),
tv as (select min(t)::double as s, (max(t) + 1)::double as e from (select t, t - row_number() over (order by t) as island from te where label = 1) group by island),
pe as (select {g}, min(t)::double as p0, (max(t) + 1)::double as p1 from (select {g}, t, t - row_number() over (partition by {g} order by t) as island from hits) group by {g}, island),
zs as (select s, e, coalesce((lag(e) over (order by s) + s) / 2, 0)::double as lo, coalesce((e + lead(s) over (order by s)) / 2, hi)::double as hi from tv, hi),
cut_ as (select {g}, s, e, lo, hi, greatest(p0, lo) as a, least(p1, hi) as b from zs join pe on p1 > lo and p0 < hi),
cell as (select *, hi - lo as room, least(s - lo, hi - e) as near, greatest(s, coalesce((lag(b) over w + a) / 2, lo)) as c0, least(e, coalesce((b + lead(a) over w) / 2, hi)) as c1,
  s - least(b, s) as l0, s - least(a, s) as l1, greatest(a, e) - e as r0, greatest(b, e) - e as r1 from cut_ window w as (partition by {g}, s order by a)),
far as (select *, a - least(c1, a) as x0, a - least(c0, a) as x1, greatest(c0, b) - b as y0, greatest(c1, b) - b as y1 from cell),
mass as (select {g}, s, sum(greatest(least(b, e) - greatest(a, s), 0) + {precise('l0', 'l1')} + {precise('r0', 'r1')}) / sum(b - a) as p,
  sum(case when c0 < c1 then greatest(least(b, c1) - greatest(a, c0), 0) + {recalled('x0', 'x1', 'a - lo')} + {recalled('y0', 'y1', 'hi - b')} else 0 end) / max(e - s) as r from far group by {g}, s),
av as (select {g}, avg(p) as precision, avg(coalesce(r, 0)) as recall from (select distinct {g} from pe) cross join zs left join mass using ({g}, s) group by {g}),
af as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from av)"""


PADDED = f"""sm as (select stream_id, stage, t, click, view, {', '.join(f'{_smoothed(c)} as r_{c}' for c in ('click', 'view'))}, count(*) over (partition by stream_id, stage) as n from staged window o as (partition by stream_id, stage order by t)),
ws2 as (select distinct stream_id, stage, unnest(list_append(range(0, greatest(n - 64, 0) + 1, 50), greatest(n - 64, 0))) as window_start from sm),
pw as (select stream_id, stage, t, window_start, t - window_start as position, false as padded, click, view, r_click, r_view from sm join ws2 using (stream_id, stage) where t >= window_start and t < window_start + 64
  union all select stream_id, stage, t, 0 as window_start, unnest(range(n, 64)) as position, true as padded, click, view, r_click, r_view from sm where n < 64 and t = n - 1)"""


def _causal() -> str:
    """Ridge regression of each channel on the others and 1, by elimination on the sums of products."""
    names = [*C, "one"]
    n = len(names)
    out = ", q as (select *, 1.0::double as one from zn), mo as (select " + ", ".join(f"sum({names[i]} * {names[j]}) as m{min(i, j)}_{max(i, j)}" for i in range(n) for j in range(i, n)) + " from q where stage = -1)"
    m = lambda i, j: f"m{min(i, j)}_{max(i, j)}"
    size = n - 1
    for t in range(size):
        rest = [i for i in range(n) if i != t]
        out += f", e{t}_0 as (select " + ", ".join([f"{m(rest[p], rest[k])}{' + 0.01' if p == k else ''} as a{p}_{k}" for p in range(size) for k in range(size)] + [f"{m(rest[p], t)} as b{p}" for p in range(size)]) + " from mo)"
        for s in range(size):
            cells = [f"a{p}_{k}" if p == s else f"a{p}_{k} - a{p}_{s} / a{s}_{s} * a{s}_{k}" for p in range(size) for k in range(size)]
            ends = [f"b{p}" if p == s else f"b{p} - a{p}_{s} / a{s}_{s} * b{s}" for p in range(size)]
            labels = [f"a{p}_{k}" for p in range(size) for k in range(size)] + [f"b{p}" for p in range(size)]
            out += f", e{t}_{s + 1} as (select " + ", ".join(f"{x} as {y}" for x, y in zip(cells + ends, labels, strict=True)) + f" from e{t}_{s})"
        v = {rest[p]: f"(-b{p} / a{p}_{p})" for p in range(size)} | {t: "1.0::double"}
        out += f", v{t} as (select " + ", ".join(f"{v[i]} as v{i}" for i in range(n)) + f" from e{t}_{size})"
        mean = " + ".join(f"v{i} * {m(i, n - 1)}" for i in range(n))
        square = " + ".join(f"v{i} * v{j} * {m(i, j)}" for i in range(n) for j in range(n))
        out += f", f{t} as (select " + ", ".join(f"v{i} as v{t}_{i}" for i in range(n)) + f", sqrt(greatest(({square}) / {m(n - 1, n - 1)} - power(({mean}) / {m(n - 1, n - 1)}, 2), 0)) + 1e-8 as s{t} from v{t}, mo)"
    residual = lambda t: "(" + " + ".join(f"v{t}_{i} * {names[i]}" for i in range(n)) + f") / s{t}"
    out += ", rs as (select stream_id, stage, t, " + ", ".join(f"{residual(t)} as r_{C[t]}" for t in range(size)) + " from q, " + ", ".join(f"f{t}" for t in range(size)) + ")"
    return out + f", cs as (select *, sqrt(({' + '.join(f'r_{c} * r_{c}' for c in C)}) / {size}) as score from rs)"


def _ensemble() -> str:
    """Two detectors, each scaled within the window, fused by their mean; attributions of both, summed."""
    past = lambda c: f"list({c}) over (partition by stream_id, stage order by t rows between {ewma_memory(0.3)} preceding and 1 preceding)"
    fold = lambda c: f"coalesce(list_reduce(list_prepend(p_{c}[1], p_{c}), lambda p, v: v * 0.3::double + p * (1 - 0.3::double)), {c})"
    scaled = lambda m: f"({m} - m_{m}) / (1.4826 * (d_{m} + 1e-8))"
    w = "(partition by stream_id, stage)"
    whole = " + ".join(f"w_{c}" for c in C)

    def member(name: str, rows: str) -> str:
        return f""", {name}_f as (select *, score > (select avg(score) + 3 * (stddev_pop(score) + 1e-8) from {rows} where stage = -1) as flag from {rows} where stage >= 0),
{name}_w as (select stream_id, stage, {_each(lambda c: f"coalesce(avg(abs(r_{c})) filter (where flag), avg(abs(r_{c}))) as w_{c}")} from {name}_f group by 1, 2),
{name}_a as (select stream_id, stage, {_each(lambda c: f"w_{c} / ({whole}) as {c}")} from {name}_w)"""

    return f""", ew as (select stream_id, stage, t, {_each(lambda c: f"{c} as r_{c}")}, ({' + '.join(f'abs({c} - {fold(c)})' for c in C)}) / {len(C)} as score from (select *, {_each(lambda c: f"{past(c)} as p_{c}")} from zn)),
two as (select ew.stream_id, ew.stage, ew.t, ew.score as a, cs.score as b from ew join cs using (stream_id, stage, t)),
med as (select *, median(a) over {w} as m_a, median(b) over {w} as m_b from two), dev as (select *, median(abs(a - m_a)) over {w} as d_a, median(abs(b - m_b)) over {w} as d_b from med),
fu as (select stream_id, stage, t, ({scaled('a')} + {scaled('b')}) / 2 as score from dev),
th as (select avg(score) + 3 * (stddev_pop(score) + 1e-8) as threshold from fu where stage = -1), ff as (select *, score > threshold as flag from fu, th where stage >= 0),
fi as (select *, row_number() over (partition by stream_id, stage order by t) - row_number() over (partition by stream_id, stage, flag order by t) as island from ff),
fr as (select stream_id, stage, max(n) as run from (select stream_id, stage, island, count(*) as n from fi where flag group by all) group by all),
fs as (select stream_id, stage, max(score) as score, max(threshold) as threshold, avg(flag::int) as anomaly_rate from ff group by 1, 2),
fz as (select stream_id, stage, score, threshold, anomaly_rate, coalesce(run, 0) as run from fs left join fr using (stream_id, stage))
{member('e', 'ew')}{member('k', 'cs')}
select stream_id, stage, round(score, 6) as score, round(threshold, 6) as threshold, round(anomaly_rate, 6) as anomaly_rate, run, {_action('standard')} as action,
  {_each(lambda c: f"round((e_a.{c} + k_a.{c}) / ({' + '.join(f'e_a.{x} + k_a.{x}' for x in C)}), 6) as {c}")} from fz join e_a using (stream_id, stage) join k_a using (stream_id, stage)"""


def _stage_events() -> str:
    """The events of the stages of a canary rollout over decisions ``dc``, by stage and place."""
    names = ROLLOUTS.create("canary").stages()
    always = [("state_changed", "case when stage = 0 then 'canary' else 'ramping' end"), ("stage_entered", "null"), ("signal_observed", "null"), ("gate_evaluated", "null")]
    ends = {"promote": [("promoted", "null")], "rollback": [("rollback_triggered", "null"), ("state_changed", "'rolling_back'"), ("state_changed", "'rolled_back'"), ("rollback_completed", "null")]}
    rows = [f"select stage, {i} as place, '{kind}' as kind, {state} as state from dc" for i, (kind, state) in enumerate(always)]
    rows += [f"select stage, {len(always) + i} as place, '{kind}' as kind, {state} as state from dc where action = '{action}'" for action, more in ends.items() for i, (kind, state) in enumerate(more)]
    place = ", ".join(f"({s.index}, '{s.name}')" for s in names)
    return f""", st2 as (select * from (values {place}) v(stage, stage_name)), ds as (select r.*, st2.stage as place_ from st2, res r where r.stage = least(st2.stage, (select max(stage) from res))),
de as (select place_ as stage, {_action('standard')} as action from ds),
dc as (select stage, action from (select *, coalesce(max((action <> 'promote')::int) over (order by stage rows between unbounded preceding and 1 preceding), 0) as past from de) where past = 0),
ev2 as (select stage, stage_name, place, kind, state from ({' union all '.join(rows)}) join st2 using (stage))"""


EVENTS = _stage_events()


def _wavelet(source: str, key: str, columns: list[str], level: int, smooth: int = 0) -> str:
    """Lists of the series ``source`` (key, t, columns), taken down and up the filter bank; ``up`` has trends by place."""
    taps = list(DB4)
    f = len(taps)
    out = f", w0 as (select {key}, list(t order by t) as ts, {', '.join(f'list({c} order by t) as {c}' for c in columns)} from {source} group by {key})"
    folded = lambda c, i: f"((({i}) % (2 * len({c})) + 2 * len({c})) % (2 * len({c})))"
    at = lambda c, i: f"{c}[least({folded(c, i)}, 2 * len({c}) - 1 - {folded(c, i)}) + 1]"
    for k in range(level):
        band = lambda c: f"list_transform(range(0, (len({c}) + {f - 1}) // 2), lambda k: " + " + ".join(f"{t!r} * {at(c, f'2 * k + 1 - {j}')}" for j, t in enumerate(taps)) + ")"
        out += f", w{k + 1} as (select {key}, ts, {', '.join(f'{band(c)} as {c}' for c in columns)} from w{k})"
    last = f"w{level}"
    if smooth:
        half = smooth // 2
        base = np.vander(np.arange(smooth) - half, 4, increasing=True)
        fit = np.linalg.pinv(base)
        rows = [[repr(float(v)) for v in row] for row in base @ fit]
        dot = lambda c, row, lo: "(" + " + ".join(f"{w} * {c}[{lo} + {j + 1}]" for j, w in enumerate(row)) + ")"
        ends = lambda c, first: " ".join(f"when k = {i if first else f'len({c}) - {smooth - i}'} then {dot(c, rows[i], '0' if first else f'len({c}) - {smooth}')}" for i in (range(half) if first else range(half + 1, smooth)))
        level_out = lambda c: f"list_transform(range(0, len({c})), lambda k: case {ends(c, True)} {ends(c, False)} else {dot(c, rows[half], f'k - {half}')} end)"
        out += f", ws as (select {key}, ts, {', '.join(f'{level_out(c)} as {c}' for c in columns)} from {last})"
        last = "ws"
    for k in range(level):
        # of two neighbouring values the even one takes every second tap, the odd one the others
        value = lambda c: f"list_transform(range(0, 2 * len({c}) - {f - 2}), lambda i: " + " + ".join(f"coalesce(case when (i + {f - 2} - {j}) % 2 = 0 and i + {f - 2} - {j} >= 0 then {taps[f - 1 - j]!r} * {c}[(i + {f - 2} - {j}) // 2 + 1] end, 0)" for j in range(f)) + ")"
        out += f", u{k} as (select {key}, ts, {', '.join(f'{value(c)} as {c}' for c in columns)} from {last})"
        last = f"u{k}"
    return out + f", up as (select {key}, unnest(ts) as t, {', '.join(f'unnest({c}[1:len(ts)]) as trend_{c}' for c in columns)} from {last})"

_mail = lambda e: f"'u' || ({e}) || '@example.org'"
_user = "user_id % (select count(*) from customer)"
BOARDS = f"""usr as (select c_custkey as userID, {_mail('c_custkey')} as email, c_name as name from customer),
board as (select o_orderkey as corkBoardID, {_mail('o_custkey')} as email, o_orderpriority as cat_name, 'Board ' || o_orderkey as title,
  case when o_orderstatus <> 'P' then o_orderdate end as last_update from orders),
priv as (select o_orderkey as corkBoardID, 'p' || o_orderkey as password from orders where o_orderkey % 4 = 1),
pub as (select * from board where corkBoardID not in (select corkBoardID from priv)),
pin as (select l_orderkey * 10 + l_linenumber as pushPinID, l_orderkey as corkBoardID,
  case when l_partkey % 3 = 0 then 'http://' else 'https://' end || 'site' || (l_suppkey % 7) || '.example/img/' || l_partkey as image_URL,
  'Pin by ' || l_returnflag || l_linestatus as description, l_shipdate as pinned_time from lineitem),
tg as (select l_orderkey * 10 + l_linenumber as pushPinID, p_brand as tag from lineitem join part on l_partkey = p_partkey),
fol as (select min(event_id) as followID, {_mail(_user)} as email, {_mail('(user_id * 7 + event_id) % (select count(*) from customer)')} as owner_email from events where event_type = 'signup' group by 2, 3),
lik as (select event_id as LikesID, {_mail(_user)} as email, (event_id % (select greatest(count(*) // {PIN_SHARE}, 1) from orders) + 1) * 10 + 1 as pushPinID from events where event_type = 'click'),
wat as (select event_id as WatchID, {_mail(_user)} as email, event_id % (select greatest(count(*) // {BOARD_SHARE}, 1) from orders) + 1 as corkBoardID from events where event_type = 'purchase'),
com as (select event_id as commentID, {_mail(_user)} as email, ts as added_time, props as content, (event_id % (select greatest(count(*) // {PIN_SHARE}, 1) from orders) + 1) * 10 + 1 as pushPinID from events where event_type = 'error')"""


def _search(term: str) -> str:
    return f"""fd as (
  select pushPinID, description, image_URL, title, name from pin join pub using (corkBoardID) join usr using (email) where cat_name ilike '%{term}%' and exists (select 1 from priv)
  union select pushPinID, description, image_URL, title, name from pin join pub using (corkBoardID) join usr using (email) where description ilike '%{term}%'
  union select pushPinID, description, image_URL, title, name from tg join pin using (pushPinID) join pub using (corkBoardID) join usr using (email) where tag ilike '%{term}%')"""


_B = "corkBoardID, email, cat_name, title, last_update"
_z = lambda cols, p: ", ".join(f"{p}_{c}" for c in cols)

ORACLE_SQL: dict[str, str] = {
    "hourly_signal": f"with {HOURLY} select * from hourly",
    "signal_long": f"with {HOURLY} " + " union all ".join(f"select stream_id, t, '{c}' as channel, {c} as value from hourly" for c in C),
    "znorm": _with() + f"select stream_id, stage, t, {_round(' '.join(C))} from zn where stage >= 0",
    "robust_norm": f"with {HOURLY}, p as (select " + _each(lambda c: f"quantile_cont({c}, 0.25) as a_{c}, quantile_cont({c}, 0.5) as b_{c}, quantile_cont({c}, 0.75) as c_{c}")
    + " from staged where stage = -1) select stream_id, stage, t, " + _each(lambda c: f"round(({c} - b_{c}) / (c_{c} - a_{c} + 1e-8), 6) as {c}") + " from staged, p where stage >= 0",
    "standard_scale": f"with {HOURLY}, p as (select " + _each(lambda c: f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}") + " from staged where stage = -1) select stream_id, stage, t, "
    + _each(lambda c: f"round(({c} - m_{c}) / case when s_{c} = 0 then 1 else s_{c} end, 6) as {c}") + " from staged, p where stage >= 0",
    "sliding_windows": f"with {HOURLY}, n as (select count(*) as n from hourly), w as (select unnest(range(0, ((n - 24) // 12) + 1)) as win from n where n >= 24) "
    + f"select stream_id, win as window, min(t) as first_t, count(*) as n, {_each(lambda c: f'sum({c}) as {c}')} from w join hourly on t >= win * 12 and t < win * 12 + 24 group by stream_id, win",
    "aligned_windows": f"with {HOURLY}, n as (select greatest(count(*) - 64, 0) as last from hourly), w as (select distinct unnest(list_append(range(0, last + 1, 50), last)) as s from n) "
    + "select stream_id, s as window_start, count(*) as n, sum(view) as view from w join hourly on t >= s and t < s + 64 group by stream_id, s",
    "stream_buffer": f"with {HOURLY} select stream_id, t, count(*) over w as buffer_rows, count(*) over w = 24 as \"full\", {_each(lambda c: f'sum({c}) over w as {c}')} from hourly window w as (partition by stream_id order by t rows between 23 preceding and current row)",
    "gaussian_smooth": f"with {HOURLY} select stream_id, stage, t, {_each(lambda c: f'round({_smoothed(c)}, 6) as {c}')} from staged where stage >= 0 window o as (partition by stream_id, stage order by t)",
    "detrended": f"with {HOURLY} select stream_id, stage, t, round(click - sum(click) over (o rows between 2 preceding and 2 following) / 5, 6) as by_five, round(click - sum(click) over (o rows between 2 preceding and 1 following) / 4, 6) as by_four, round(click - avg(click) over (partition by stream_id, stage), 6) as by_mean from staged where stage >= 0 window o as (partition by stream_id, stage order by t)",
    "differenced": f"with {HOURLY} select stream_id, stage, t, {_each(lambda c: f'coalesce({c} - lag({c}) over o, 0) as {c}')} from staged where stage >= 0 window o as (partition by stream_id, stage order by t)",
    "fault_injection": f"with {HOURLY} select stream_id, stage, t, round(click + case when t >= 5 and t < 9 then 4.0 else 0 end, 6) as click, round(error + case when t >= 10 then (t - 10) * 0.5 else 0 end, 6) as error, purchase, signup, round(view + case when t >= 20 then 0.8 else 0 end, 6) as view, ((t >= 5 and t < 9) or t >= 10)::int as label from staged where stage >= 0",
    "time_features_hourly": "select event_id, round(floor(extract(second from ts)) / 59.0 - 0.5, 6) as second_f, round(extract(minute from ts) / 59.0 - 0.5, 6) as minute_f, round(extract(hour from ts) / 23.0 - 0.5, 6) as hour_f, round((extract(isodow from ts) - 1) / 6.0 - 0.5, 6) as weekday_f, round(extract(day from ts) / 30.0 - 0.5, 6) as day_f, round(extract(month from ts) / 365.0 - 0.5, 6) as month_f from events",
    "train_valid": f"with {HOURLY}, x as (select stream_id as entity, t, count(*) over () as n from hourly), y as (select *, floor(n / 2) as half from x), z as (select *, case when n > 500 and t >= half then half else 0 end as s, case when n <= 500 then n when t < half then half else n - half end as size from y) select entity, t, case when t - s < floor(size * 0.8::double) then 'train' else 'valid' end as split from z",
    "gram_matrix": f"with {HOURLY} " + " union all ".join(f"select '{a}' as a, '{b}' as b, sum({a} * {b}) as v from hourly" for i, a in enumerate(C) for b in C[i:]),
    "ewma_scores": f"with {HOURLY} " + _ewma("staged"),
    "detector_ewma": _with() + _ewma("zn"),
    "spatiotemporal_scores": _with() + f""", s as (select stream_id, stage, t, {_each(lambda c: f"{_smoothed(c)} as {c}")} from zn window o as (partition by stream_id, stage order by t)),
f as (select stream_id, stage, t, {_each(lambda c: f"{c} - sum({c}) over (o rows between 2 preceding and 2 following) / 5 as l_{c}, coalesce({c} - lag({c}) over o, 0) as d_{c}, {c} - ({' + '.join(C)}) / {len(C)} as p_{c}")} from s window o as (partition by stream_id, stage order by t)),
q as (select {', '.join(f"avg({k}_{c}) as m_{k}_{c}, stddev_pop({k}_{c}) as s_{k}_{c}" for k in 'ldp' for c in C)} from f where stage = -1)
select stream_id, stage, t, round(sqrt(({' + '.join(f"power(({k}_{c} - m_{k}_{c}) / (s_{k}_{c} + 1e-8), 2)" for k in 'ldp' for c in C)}) / {3 * len(C)}), 6) as score from f, q where stage >= 0""",
    "threshold_static": _threshold("1.5::double"),
    "threshold_sigma": _threshold(_SIGMA),
    "threshold_quantile": _threshold("(select quantile_cont(score, 0.99) from sc where stage = -1)"),
    "threshold_adaptive": _threshold(f"greatest({_SIGMA}, sum(power(0.9::double, n - t) * score) over w / sum(power(0.9::double, n - t)) over w + 3 * (select stddev_pop(score) + 1e-8 from sc where stage = -1))").replace(
        "from sc where stage >= 0)", "from (select *, max(t) over (partition by stream_id, stage) as n from sc) where stage >= 0 window w as (partition by stream_id, stage))"),
    "window_summary": _with("faulty", FLAGGED) + f"select stream_id, stage, {_round('score threshold anomaly_rate')}, is_anomaly, run, n_points from res",
    "longest_run": _with("faulty", FLAGGED) + "select * from rn",
    "gate_decisions": _with("faulty", FLAGGED) + f"select stream_id, stage, {_round('score anomaly_rate')}, run, {_action('standard')} as action from res",
    "gate_tiers": _with("faulty", FLAGGED) + " union all ".join(f"select '{t}' as tier, stream_id, stage, {_action(t)} as action from res" for t in TIERS),
    "rollout_walk": _with("faulty", FLAGGED) + f"select stream_id, stage, action from (select *, coalesce(max((action <> 'promote')::int) over (partition by stream_id order by stage rows between unbounded preceding and 1 preceding), 0) as past from (select stream_id, stage, {_action('standard')} as action from res)) where past = 0",
    "window_attribution": _with("faulty", FLAGGED) + "select stream_id, stage, rank, channel, round(weight, 6) as weight from (select *, row_number() over (partition by stream_id, stage order by weight desc, ix) as rank from (" + " union all ".join(f"select stream_id, stage, {i} as ix, '{c}' as channel, {c} as weight from res" for i, c in enumerate(C)) + ")) where rank <= 3",
    "aggregate_attribution": _with("faulty", FLAGGED) + f"select stream_id, {_each(lambda c: f'round(sum({c}) / (' + ' + '.join(f'sum({k})' for k in C) + f'), 6) as {c}')} from res group by stream_id",
    "robust_zscale": _with() + f"select stream_id, stage, t, round(z_score, 6) + 0.0 as score from {_robust('score')}",
    "fuse_mean": _with() + f"select stream_id, stage, t, round((z_by_click + z_by_view) / 2, 6) + 0.0 as score from {_robust('by_click by_view')}",
    "fuse_max": _with() + f"select stream_id, stage, t, round(greatest(z_by_click, z_by_view), 6) + 0.0 as score from {_robust('by_click by_view')}",
    "fuse_weighted": _with() + f"select stream_id, stage, t, round(z_by_click * (3 / (4 + 1e-8)) + z_by_view * (1 / (4 + 1e-8)), 6) + 0.0 as score from {_robust('by_click by_view')}",
    "prf_eval": f"with {LABELLED}, k as (select count(*) filter (where score > 2 and label = 1) as tp, count(*) filter (where score > 2 and label <> 1) as fp, count(*) filter (where not score > 2 and label = 1) as fn from lb), p as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall from k) select tp, fp, fn, {PRF} from p",
    "best_threshold": f"""with {LABELLED}, s as (select min(score) as lo, (max(score) - min(score)) / 99 as w from lb), g as (select unnest(range(100)) as k), h as (select k, lo + k * w as thr from g, s),
m as (select k, thr, count(*) filter (where score > thr and label = 1) as tp, count(*) filter (where score > thr and label <> 1) as fp, count(*) filter (where not score > thr and label = 1) as fn from h, lb group by k, thr),
p as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall from m),
q as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from p)
select tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(thr, 6) as threshold from q order by q.f1 desc, k limit 1""",
    "best_f1": f"with {LABELLED} " + _best("lb"),
    "roc_auc": f"with {LABELLED}, r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from lb) select round((sum(rk) filter (where label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6)::double as auc from r",
    "point_adjust": f"with {HOURLY}, {TRUTH} select stream_id, t, case when label = 1 and t > 0 then max(flag::int) over (partition by stream_id, label, island) = 1 else flag end as adjusted from (select *, row_number() over (partition by stream_id order by t) - row_number() over (partition by stream_id, label order by t) as island from ht)",
    "best_f1_adjusted": f"with {HOURLY}, {TRUTH}, pa as (select label, case when label = 1 then max(score) over (partition by stream_id, label, island) else score end as score from (select *, row_number() over (partition by stream_id order by t) - row_number() over (partition by stream_id, label order by t) as island from ht)) " + _best("pa"),
    "eval_accuracy": f"with {LABELLED}, k as (select count(*) filter (where score > 2 and label = 1) as tp, count(*) filter (where score > 2 and label <> 1) as fp, count(*) filter (where not score > 2 and label = 1) as fn, count(*) filter (where not score > 2 and label <> 1) as tn from lb), p as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall from k) select tp, fp, fn, tn, {PRF}, round((tp + tn) / (tp + fp + fn + tn)::double, 6) as accuracy from p",
    "macro_average": f"with {HOURLY}, {TRUTH}, k as (select floor(t / 24.0) as day, count(*) filter (where flag and label = 1) as tp, count(*) filter (where flag and label <> 1) as fp, count(*) filter (where not flag and label = 1) as fn from ht group by 1), p as (select case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall from k), f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from p) select count(*) as runs, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1 from f",
    "evaluate_percentile": f"""with {HALVES}, fl as (select *, score > cut as hit from te, ct),
pa as (select label, case when label = 1 and t > 0 then max(hit::int) over (partition by label, island) = 1 else hit end as flag from (select *, row_number() over (order by t) - row_number() over (partition by label order by t) as island from fl)),
k as (select count(*) filter (where flag and label = 1) as tp, count(*) filter (where flag and label <> 1) as fp, count(*) filter (where not flag and label = 1) as fn from pa),
p as (select case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall from k)
select auc, round(cut, 6) as threshold, {PRF} from p, ct, au""",
    "evaluate_best": f"""with {HALVES}, pa as (select label, case when label = 1 then max(score) over (partition by label, island) else score end as score from (select *, row_number() over (order by t) - row_number() over (partition by label order by t) as island from te)),
b as ({_best('pa')}) select auc, threshold, precision, recall, f1 from b, au""",
    "evaluate_affiliated": f"""with {HALVES}, g as (select 0 as g), hits as (select 0 as g, t from te, ct where score >= cut), {_affiliated('g')}
select auc, round(cut, 6) as threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from af, ct, au""",
    "best_affiliation": f"""with {HALVES}, g as (select i as g, quantile_cont(score, [{', '.join(repr(0.001 + i * 0.998 / 199) for i in range(200))}])[i + 1] as cut from te, range(200) r(i) group by i),
hits as (select g, t from te, g where score > cut), {_affiliated('g')}, be as (select g, cut, precision, recall, 2 * precision * recall / (precision + recall + 1e-8) as f1 from af join g using (g))
select 'events' as series_id, round(cut, 6) as threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from be order by be.f1 desc, g limit 1""",
    "affiliation_pr": f"""with {HOURLY}, {TRUTH}, te as (select * from ht), g as (select 0 as g), hits as (select 0 as g, t from ht where flag), {_affiliated('g')}
select 'events' as series_id, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from af""",
    "padded_windows": f"with {HOURLY}, {PADDED} select stream_id, stage, window_start, padded, count(*) as n, sum(position)::bigint as positions, round(sum(view), 6) as view from pw group by all",
    "last_rows": f"with {HOURLY}, {PADDED} select stream_id, stage, window_start, position, t, click from pw where position >= 48",
    "kl_contributions": f"with {HOURLY}, {PADDED}, sp2 as (select *, {', '.join(f'greatest({c}, 0) + ln(1 + exp(-abs({c}))) as p_{c}' for c in ('click', 'view', 'r_click', 'r_view'))} from pw), df as (select *, {', '.join(f'p_r_{c} / sum(p_r_{c}) over w as p{c}, ln(p_r_{c} / sum(p_r_{c}) over w) - ln(p_{c} / sum(p_{c}) over w) as d{c}' for c in ('click', 'view'))} from sp2 window w as (partition by stream_id, stage, window_start)) "
    + "select stream_id, stage, window_start, position, " + ", ".join(f"round(p{c} * d{c} * ln(1 + d{c} * d{c}), 6) + 0.0 as {c}" for c in ("click", "view")) + " from df",
    "overlap_average": f"with {HOURLY}, {PADDED}, er as (select stream_id, stage, t, avg(power(click - r_click, 2) * (position + 1)) as e_click, avg(power(view - r_view, 2) * (position + 1)) as e_view from pw where not padded group by 1, 2, 3) select stream_id, stage, t, round(coalesce(e_click, 0), 6) as e_click, round(coalesce(e_view, 0), 6) as e_view, round((coalesce(e_click, 0) + coalesce(e_view, 0)) / 2, 6) as score from staged left join er using (stream_id, stage, t)",
    "spectrum": f"with {HOURLY}, {PADDED}, tr as (select stream_id, stage, window_start, k::int as frequency, click, ((position * k) % 64) * {2 * math.pi / 64!r}::double as turn from pw, range(33) r(k)), su as (select stream_id, stage, window_start, frequency, sum(click * cos(turn)) as re, sum(-click * sin(turn)) as im from tr group by 1, 2, 3, 4) select stream_id, stage, window_start, frequency, round(re, 4) + 0.0 as re, round(im, 4) + 0.0 as im, round(re * re + im * im, 4) + 0.0 as power from su",
    "spectrum_2d": f"with {HOURLY}, wn as (select stream_id, stage, count(*) as n from staged group by 1, 2), ws2 as (select stream_id, stage, n, unnest(list_distinct(list_append(range(0, greatest(n - 64, 0) + 1, 50), greatest(n - 64, 0)))) as window_start from wn), pw as (select s.*, window_start, t - window_start as position from staged s join ws2 using (stream_id, stage) where t >= window_start and t < window_start + 64 union all select s.*, 0 as window_start, unnest(range(n, 64)) as position from staged s join wn using (stream_id, stage) where n < 64 and t = n - 1), "
    + "lg as (select stream_id, stage, window_start, position, unnest(range(5)) as j, unnest([" + ", ".join(C) + f"]) as x from pw), tr as (select *, ((position * k) % 64) * {2 * math.pi / 64!r}::double + ((j * q) % 5) * {2 * math.pi / 5!r}::double as turn from lg, range(64) r(k), range(5) s(q)) "
    + "select stream_id, stage, window_start, k::int as frequency, q::int as channel_frequency, round(sum(x * cos(turn)), 4) + 0.0 as re, round(sum(-x * sin(turn)), 4) + 0.0 as im from tr group by 1, 2, 3, 4, 5",
    "wavelet_trend": f"with {HOURLY}{_wavelet('hourly', 'stream_id', ['click', 'view'], 5)} select stream_id, t, click, view, round(trend_click, 6) + 0.0 as trend_click, round(trend_view, 6) + 0.0 as trend_view, round(click - trend_click, 6) + 0.0 as stable_click, round(view - trend_view, 6) + 0.0 as stable_view from hourly join up using (stream_id, t)",
    "wavelet_trend_smoothed": f"with mn as (select event_type as kind, floor(epoch(ts) / 60)::bigint % 10080 as t, count(*)::double as n from events group by 1, 2){_wavelet('mn', 'kind', ['n'], 3, 11)} select kind, t, n, round(trend_n, 6) + 0.0 as trend_n, round(n - trend_n, 6) + 0.0 as stable_n from mn join up using (kind, t)",
    "outlier_clamp": f"""with recursive {HOURLY}, s as (select list(click order by t) as x from hourly), r as (select 0 as i, x from s union all
select i + 1, case when x[i + 1] - m > 1.5 * d then list_concat(x[:i], [m], x[i + 2:]) else x end from (select i, x, list_avg(x[greatest(i - 23, 1):i + 25]) as m, list_stddev_pop(x[greatest(i - 23, 1):i + 25]) as d from r where i < len(x)))
select 'events' as stream_id, unnest(range(0, len(x))) as t, round(unnest(x), 6) + 0.0 as click from r where i = len(x)""",
    "affiliation_inferred": f"""with {HOURLY}, {TRUTH}, {_events('label', 'truth')}, {_events('flag', 'pred')}, sp9 as (select min(start) as lo9, max(stop) as hi9 from (from truth union all from pred)),
te as (select stream_id, t - lo9 as t, label, flag from ht, sp9 where t >= lo9 and t < hi9), g as (select 0 as g), hits as (select 0 as g, t from te where flag), {_affiliated('g')}
select 'events' as series_id, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from af""",
    "causal_scores": _with() + _causal() + " select stream_id, stage, t, round(score, 6) as score from cs where stage >= 0",
    "ensemble_results": _with("faulty") + _causal() + _ensemble(),
    "events_from_vector": f"with {HOURLY}, {TRUTH}, {_events('label', 'truth')} select stream_id, start, stop from truth",
    "detection_delay": f"with {HOURLY}, {TRUTH}, d as (select *, floor(t / 24.0)::bigint as day from ht), f as (select stream_id, day, min(t) filter (where label = 1) as first from d group by all), h as (select d.stream_id, d.day, min(t) as hit from d join f using (stream_id, day) where flag and t >= first group by all) select stream_id, day, hit - first as delay from f left join h using (stream_id, day)",
    "affiliation_zones": f"with {ZONES} select * from zn",
    "affiliation_parts": f"with {ZONES} select series_id, zn.start as start, zn.stop as stop, greatest(pred.start, zone_lo)::double as part_lo, least(pred.stop, zone_hi)::double as part_hi from zn join pred on pred.stream_id = series_id and pred.stop > zone_lo and pred.start < zone_hi",
    "metrics_rollup": "with f as (select event_type as name, case when event_type in ('click', 'view') then 'counter' when event_type = 'error' then 'gauge' else 'series' end as kind, event_id as seq, value from events) select name, kind, count(*) as n, round(sum(value), 6) as total, round(case when kind = 'gauge' then arg_max(value, seq) when kind = 'counter' then sum(value) else avg(value) end, 6) as value from f group by name, kind",
    "state_audit_roles": "select conv_id, turn, role, before from (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as before from conversations) where before is not null and before || '>' || role not in ('system>user', 'user>assistant')",
    "deployment_events": _with("faulty", FLAGGED) + f"{EVENTS} select * from ev2",
    "state_transitions": _with("faulty", FLAGGED) + f"{EVENTS}, lg as (select (stage * 100 + place)::bigint as seq, lag(state) over (order by stage, place) as before, state from ev2 where state is not null) select *, before is null or before || '>' || state in ("
    + ", ".join(f"'{a}>{b}'" for a, to in TRANSITIONS.items() for b in sorted(to)) + ") as may from lg",
    "popular_tags": f"with {BOARDS} select tag, count(pushPinID) as pins, count(distinct corkBoardID) as boards from tg join pin using (pushPinID) group by tag order by pins desc, tag limit 5",
    "popular_sites": f"with {BOARDS} select split_part(replace(replace(image_URL, 'https://', ''), 'http://', ''), '/', 1) as site, count(*) as pins from pin group by 1 order by pins desc, site limit 4",
    "page_sites": "select split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 1) as site, count(page_id) as pages from pages group by 1 order by pages desc, site limit 4",
    "board_stats": f"""with {BOARDS}, a as (select email, count(*) as n from pub group by email), b as (select email, count(*) as n from pub join pin using (corkBoardID) group by email),
c as (select email, count(*) as n from board join priv using (corkBoardID) group by email), d as (select email, count(*) as n from board join priv using (corkBoardID) join pin using (corkBoardID) group by email)
select name, coalesce(a.n, 0) as public_boards, coalesce(b.n, 0) as public_pins, coalesce(c.n, 0) as private_boards, coalesce(d.n, 0) as private_pins
from usr left join a using (email) left join b using (email) left join c using (email) left join d using (email)""",
    "my_boards": f"with {BOARDS} select t0.corkBoardID, count(pushPinID) as pins, title, password from (select * from board where email = '{ME}') t0 left join priv using (corkBoardID) left join pin using (corkBoardID) group by t0.corkBoardID, title, password",
    "recent_feed": f"""with {BOARDS}, fd as (
  select {_B}, password from board join priv using (corkBoardID) where email in (select owner_email from fol where email = '{ME}')
  union select {_B}, null from pub where email in (select owner_email from fol where email = '{ME}')
  union select {_B}, null from board where corkBoardID in (select corkBoardID from wat where email = '{ME}')
  union select {_B}, password from board join priv using (corkBoardID) where email = '{ME}'
  union select {_B}, null from pub where email = '{ME}')
select {_B}, password, name from fd join usr using (email) order by last_update desc nulls last, corkBoardID, password nulls last limit 4""",
    "search": f"with {BOARDS}, {_search('brand#1')} select * from fd",
    "search_category": f"with {BOARDS}, {_search('urgent')} select description, count(*) as n from fd group by description",
    "pin_likers": f"with {BOARDS}, l as (select list_sort(list(name)) as n from lik join usr using (email) where pushPinID = 11) select case when len(n) = 0 or n is null then '' when len(n) = 1 then n[1] else array_to_string(n[1:len(n) - 1], ', ') || ' and ' || n[len(n)] end as names from l",
    "pin_comments": f"with {BOARDS} select name, content, added_time, commentID from com join usr using (email) where pushPinID = 21",
    "board_page": f"""with {BOARDS} select {_B}, name, exists (select 1 from priv p where p.corkBoardID = b.corkBoardID) as private,
  exists (select 1 from wat w where w.corkBoardID = b.corkBoardID and w.email = '{ME}') as watched, exists (select 1 from fol f where f.owner_email = b.email and f.email = '{ME}') as followed,
  (select count(*) from wat w where w.corkBoardID = b.corkBoardID) as watchers, (select count(*) from pin p where p.corkBoardID = b.corkBoardID) as pins
from board b join usr using (email) where corkBoardID = 5""",
    "private_anti_join": f"with {BOARDS} select corkBoardID, title from board where corkBoardID not in (select corkBoardID from priv)",
    "likes_toggle": f"""with {BOARDS}, ch as (select email, (WatchID % 40 + 1) * 10 + 1 as pushPinID from wat union select email, pushPinID from lik where LikesID % 3 = 0),
nw as (select email, pushPinID from ch except select email, pushPinID from lik)
select LikesID, email, pushPinID from lik where (email, pushPinID) not in (select (email, pushPinID) from ch)
union all select (select max(LikesID) from lik) + row_number() over (order by email, pushPinID), email, pushPinID from nw""",
    "follow_if_absent": f"""with {BOARDS}, nw as (select email, {_mail('corkBoardID % 150')} as owner_email from wat except select email, owner_email from fol)
select followID, email, owner_email from fol union all select (select max(followID) from fol) + row_number() over (order by email, owner_email), email, owner_email from nw""",
    "comment_insert": f"with {BOARDS} select (select max(commentID) from com) + row_number() over (order by 'like ' || LikesID) as commentID, email, 'like ' || LikesID as content, pushPinID from lik where LikesID % 50 = 0",
    "pin_page": f"""with {BOARDS}, l as (select list_sort(list(name)) as n from lik join usr using (email) where pushPinID = 71)
select pushPinID, corkBoardID, title, last_update as board_update, name as owner, description, image_URL, split_part(replace(replace(image_URL, 'https://', ''), 'http://', ''), '/', 1) as site,
  (select string_agg(tag, ', ' order by tag) from tg where pushPinID = 71) as tags,
  (select case when len(n) = 0 or n is null then '' when len(n) = 1 then n[1] else array_to_string(n[1:len(n) - 1], ', ') || ' and ' || n[len(n)] end from l) as likers,
  (select count(*) from com where pushPinID = 71) as comments, exists (select 1 from lik where pushPinID = 71 and email = '{ME}') as liked,
  email = '{ME}' as own, exists (select 1 from fol where fol.email = '{ME}' and owner_email = b.email) as followed
from pin join board b using (corkBoardID) join usr using (email) where pushPinID = 71""",
    "touch_boards": f"with {BOARDS} select corkBoardID, corkBoardID in (select corkBoardID from wat) or coalesce(last_update = timestamp '2024-06-01', false) as touched from board",
    "register_check": f"with {BOARDS} select {_mail('s_suppkey * 20')} as email, s_name as name, {_mail('s_suppkey * 20')} in (select email from usr) as email_taken, s_name in (select name from usr) as name_taken from supplier",
    "tag_explode": "select doc_id, count(*) as tags, min(tag) as first from (select doc_id, unnest(string_split(text, ',')) as tag from documents) where tag <> '' and length(tag) <= 20 group by doc_id",
    "names_by_region": "with n as (select n_regionkey as region, list_sort(list(n_name)) as n from nation group by 1) select region, case when len(n) = 1 then n[1] else array_to_string(n[1:len(n) - 1], ', ') || ' and ' || n[len(n)] end as names from n",
    "natural_order": "select 'machine-' || s_suppkey % 13 || '-' || s_suppkey as file, row_number() over (order by s_suppkey % 13, s_suppkey) as place from supplier",
    "percent_format": "select l_returnflag, round_even(avg((l_linestatus = 'F')::int) * 100, 0)::bigint || '%' as share from lineitem group by l_returnflag",
    "union_entities": "select nation, count(*) as n from (select c_name as name, c_nationkey as nation from customer union all select s_name, s_nationkey from supplier) group by nation",
}
