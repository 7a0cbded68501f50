"""Series longer than a task: tiles, scans, quantiles and affiliation zones against plain versions, and how rows spread."""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwell.functions import intervals as I, quantiles as Q, series as S, tiles as T
from driftwell.functions.order import numbered, ranged, running
from driftwell.operators import detectors as D, events_eval as E, signals
from driftwell.operators.signals import KEYS
from driftwell.operators.thresholds import QuantileThreshold, robust_scaled

ROWS = 50


@contextmanager
def many_partitions(spark, n=16):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def spread(df) -> list[int]:
    """Rows by task."""
    return [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max(F.hash(*df.columns))).collect()]


@pytest.fixture(scope="module")
def uneven(spark):
    """A long series, one with growing steps, a single row, and one without changes."""
    rng = np.random.default_rng(0)
    rows = [("a", t, float(rng.normal()), bool(rng.random() < 0.4)) for t in range(1000)]
    rows += [("b", t * t, float(rng.normal()), bool(t % 7)) for t in range(57)]
    rows += [("c", 5, 1.0, True), *[("d", t, 2.0, None if t > 250 else True) for t in range(300)]]
    return spark.createDataFrame(rows, "s string, t long, x double, f boolean").repartition(5).cache()


def by_row(df, name):
    return {(r.s, r.t): r[name] for r in df.collect()}


@pytest.mark.parametrize(("before", "after"), [(3, 3), (110, 0), (0, 40), (1, 0), (0, 0), (2000, 1)])
def test_halo(uneven, before, after):
    tiles = T.tiled(uneven, ["s"], "t", before, after, rows=ROWS)
    frame = lambda w: F.collect_list("x").over(w.rowsBetween(-before, after))
    plain = by_row(uneven.withColumn("v", frame(S.ordered(["s"]))), "v")
    got = tiles.own(tiles.rows.withColumn("v", frame(tiles.window)))
    assert got.columns == [*uneven.columns, "v"] and tiles.rows.select("__range").distinct().count() > 20
    if before or after:
        assert by_row(got, "v") == plain
    if before + after < 10:
        assert tiles.rows.count() < 1.3 * uneven.count()


@pytest.mark.parametrize("alpha", [0.05, 0.3, 0.9, 1.0])
def test_exponential_scan(uneven, alpha):
    got = by_row(T.ewma_forecasts(uneven, {"v": F.col("x")}, alpha, ["s"], rows=ROWS), "v")
    plain = {}
    for s in "abcd":
        p = None
        for r in uneven.where(F.col("s") == s).orderBy("t").collect():
            plain[s, r.t] = p = r.x if p is None else p
            p = alpha * r.x + (1 - alpha) * p
    assert got.keys() == plain.keys() and all(abs(got[k] - v) < 1e-12 for k, v in plain.items())


def test_islands(uneven):
    w = S.ordered(["s"])
    for gaps in (False, True):
        same = F.lag("f").over(w).eqNullSafe(F.col("f")) & (F.row_number().over(w) > 1)
        if gaps:
            same = same & (F.lag("t").over(w) + 1 == F.col("t"))
        plain = by_row(uneven.withColumn("i", F.sum(F.when(same, 0).otherwise(1)).over(w)), "i")
        assert by_row(T.islands(uneven, F.col("f"), "i", ["s"], gaps=gaps, rows=ROWS), "i") == plain


def test_last_known(uneven):
    w = S.ordered(["s"]).rowsBetween(Window.unboundedPreceding, 0)
    rare = F.when(F.col("t") % 211 == 3, F.col("x"))
    plain = by_row(uneven.withColumn("v", F.last(rare, True).over(w)), "v")
    assert by_row(T.last_known(uneven, {"v": rare}, ["s"], [F.col("t")], rows=ROWS), "v") == plain


def test_numbers_in_series(uneven):
    plain = by_row(uneven.withColumn("n", F.row_number().over(S.ordered(["s"]))), "n")
    assert by_row(numbered(uneven, "n", F.col("t"), by=["s"], rows=ROWS), "n") == plain
    total = running(uneven.where("s = 'a'"), {"y": "t"}, F.col("t"), rows=ROWS)
    assert by_row(total, "y") == {("a", t): t * (t + 1) // 2 for t in range(1000)}


def test_ranges_follow_the_rows(spark):
    """Ten times the rows make ten times the ranges, of like length."""
    for n in (2000, 20_000):
        counts = [r["count"] for r in ranged(spark.range(n), F.xxhash64("id"), rows=200).groupBy("__range").count().collect()]
        assert 0.5 * n / 200 < len(counts) < 2 * n / 200 and max(counts) < 800


def test_one_series_is_worked_on_by_many_tasks(spark):
    df = spark.range(4000).select(F.lit("s").alias("stream_id"), F.lit(0).alias("stage"), F.col("id").alias("t"), (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 900 > 400).alias("flag"))
    with many_partitions(spark):
        tiles = T.tiled(df, KEYS, "t", 3, 3, rows=100)
        smooth = tiles.own(tiles.rows.withColumn("y", S.smooth(F.col("x"), 1.0, tiles.window)))
        forecast = T.ewma_forecasts(df, {"f": F.col("x")}, 0.3, KEYS, rows=100)
        runs = T.islands(df, F.col("flag"), "i", KEYS, rows=100)
        for name, out in (("smooth", smooth), ("forecast", forecast), ("runs", runs)):
            rows = spread(out)
            assert sum(rows) == 4000 and len(rows) >= 8 and max(rows) < 1200, (name, rows)
        plan = D.longest_runs(df, rows=100)
        assert plan.first().run == 499


def test_detectors_over_tiles(spark, monkeypatch):
    """Scores and runs with tiles of 16 rows are those of whole windows."""
    rng = np.random.default_rng(4)
    rows = [("s", g, t, *map(float, rng.normal(size=3))) for g in (-1, 0, 1) for t in range(200)]
    df = spark.createDataFrame(rows, "stream_id string, stage int, t long, a double, b double, c double")
    for name, params in (("ewma", {}), ("diffusion", {}), ("spatiotemporal", {}), ("spatiotemporal", {"detrend_window": 1, "smooth_sigma": 0.0})):
        got = {}
        for size in (16, 1 << 16):
            monkeypatch.setattr(D.Detector, "tile_rows", size)
            d = D.DETECTORS.create(name, **params).fit(df.where("stage = -1"))
            got[size] = {(r.stage, r.t): r.score for r in d.score(df.where("stage >= 0")).collect()}
        assert got[16].keys() == got[1 << 16].keys() and all(abs(v - got[1 << 16][k]) < 1e-9 for k, v in got[16].items())


def test_trailing_buffer_over_tiles(spark):
    df = spark.range(300).select(F.lit("s").alias("stream_id"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    got = {r.t: (r.buffer_rows, r.full, r.x) for r in signals.trailing_buffer(df, ["x"], 24, rows=30).collect()}
    assert got == {t: (min(24, t + 1), t >= 23, [float(v) for v in range(max(0, t - 23), t + 1)]) for t in range(300)}


# --- quantiles ---------------------------------------------------------------------------------------------------


def test_quantiles(spark, uneven):
    """Ties of any number, nulls, NaN, negative zero, columns without values."""
    df = uneven.withColumns({"y": F.round("x", 0), "z": F.when(F.col("t") % 3 > 0, F.lit(-0.0)), "none": F.lit(None).cast("double"), "nan": F.when(F.col("t") % 5 == 0, float("nan")).otherwise(F.col("x"))})
    qs = [0.25, 0.5, 0.75, 0.0, 1.0, 0.333, 0.99]
    got = {(r.s, r.channel): r.quantiles for r in Q.quantiles(df, ["x", "y", "z", "none", "nan"], qs, ["s"], rows=40).collect()}
    for r in df.groupBy("s").agg(*[F.percentile(c, F.array(*map(F.lit, qs))).alias(c) for c in ("x", "y", "z", "none", "nan")]).collect():
        for c in ("x", "y", "z", "none", "nan"):
            if r[c] is None:
                assert (r.s, c) not in got
            else:
                assert all((math.isnan(a) and math.isnan(b)) or abs(a - b) < 1e-12 for a, b in zip(r[c], got[r.s, c], strict=True)), (r.s, c)
    assert Q.quantile_values(uneven.limit(0), ["x"], [0.5]) == {}


def test_quantiles_sort_few_ranges(spark):
    """Only the ranges that hold a wanted rank are shuffled, and a value that all rows share is one row."""
    df = spark.range(40_000).select((F.xxhash64("id") % 100_000).cast("double").alias("x"), F.lit(7.0).alias("same"))
    n = normal = Q.quantile_values(df, ["x", "same"], [0.5, 0.99], rows=500)
    x = np.sort([r.x for r in df.select("x").collect()])
    assert normal["same"] == [7.0, 7.0] and np.allclose(n["x"], np.quantile(x, [0.5, 0.99]))
    assert QuantileThreshold(0.99, rows=500).fit(df.select(F.col("x").alias("score"))).value == pytest.approx(np.quantile(x, 0.99))


def test_robust_scale_of_windows(spark):
    rng = np.random.default_rng(2)
    rows = [("s", g, t, float(rng.normal())) for g in range(3) for t in range(80 if g else 1)]
    df = spark.createDataFrame(rows, "stream_id string, stage int, t long, score double")
    got = {(r.stage, r.t): r.score for r in robust_scaled(df, ["score"], KEYS, rows=20).collect()}
    for g in range(3):
        x = np.array([r[3] for r in rows if r[1] == g])
        m = np.median(x)
        z = (x - m) / (1.4826 * (np.median(np.abs(x - m)) + 1e-8))
        assert np.allclose([got[g, t] for t in range(len(x))], z)


# --- events and affiliation --------------------------------------------------------------------------------------


def test_segments_over_many_tiles(spark):
    """A labelled segment longer than many tiles, flagged once; row 0 keeps its own flag."""
    rows = [("s", t, int(t < 300 or 400 <= t < 460), t in (299, 500), float(t in (299, 450))) for t in range(600)]
    df = spark.createDataFrame(rows, "stream_id string, t long, label int, flag boolean, score double").repartition(4)
    got = {r.t: r.adjusted for r in E.point_adjusted(df, ["stream_id"], rows=40).collect()}
    assert got == {t: (0 < t < 300 or t == 500) for t in range(600)}
    assert {(r.start, r.stop) for r in E.events_of(df, "label", ["stream_id"], rows=40).collect()} == {(0, 300), (400, 460)}
    assert {(r.start, r.stop) for r in E.events_of(df.where("t % 100 <> 50"), "label", ["stream_id"], gaps=True, rows=40).collect()} == {(0, 50), (51, 150), (151, 250), (251, 300), (400, 450), (451, 460)}
    assert E.best_f1_adjusted(df, ["stream_id"], rows=40).first().threshold == 1.0


def plain_affiliation(pred, truth, span):
    return I.affiliation(pred, truth, span)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_affiliation_of_uneven_zones(spark, seed):
    """Many short zones beside long ones, events over many zones and many events in a zone."""
    rng = np.random.default_rng(seed)

    def events(n, gap):
        at, out = float(rng.random()), []
        for i in range(n):
            length = float(rng.random()) * (400 if i % 17 == seed else 1) + 0.01
            out.append((at, at + length))
            at += length + float(rng.random()) * gap
        return out

    sets = {f"s{k}": (events(60, 3), events(40, 9 if k else 0.5)) for k in range(3)}
    spans = {s: (0.0, max(p[-1][1], t[-1][1]) + 5) for s, (p, t) in sets.items()}
    rows = [(s, kind, *e) for s, both in sets.items() for kind, es in zip(("pred", "truth"), both, strict=True) for e in es]
    df = spark.createDataFrame(rows, "series_id string, kind string, start double, stop double").repartition(3)
    span = spark.createDataFrame([(s, *v) for s, v in spans.items()], "series_id string, lo double, hi double")
    for given, bounds in ((span, spans), (None, {s: (min(p[0][0], t[0][0]), max(p[-1][1], t[-1][1])) for s, (p, t) in sets.items()})):
        got = {r.series_id: r for r in E.affiliation(df, given, rows=16).collect()}
        for s, (p, t) in sets.items():
            plain = plain_affiliation(p, t, bounds[s])
            assert all(got[s][m] == pytest.approx(plain[m], abs=1e-9) for m in ("precision", "recall", "f1"))


def test_zone_parts_stay_linear(spark):
    """10,000 short zones and a long one, and as many events: a row for each at most, and no task with most of them."""
    n = 10_000
    truth = spark.range(n + 1).select(F.lit("s").alias("series_id"), F.when(F.col("id") == n, 9e6).otherwise(F.col("id") * 2.0).alias("start")).withColumn("stop", F.col("start") + F.when(F.col("start") == 9e6, 1e6).otherwise(1.0))
    pred = spark.range(n).select(F.lit("s").alias("series_id"), (F.col("id") * 2.0 + 0.5).alias("start")).withColumn("stop", F.col("start") + 1.0)
    span = spark.createDataFrame([("s", 0.0, 1e7)], "series_id string, lo double, hi double")
    with many_partitions(spark):
        zone = E.zones(truth, span, rows=1000)
        parts = E.in_zones(pred, zone, rows=1000)
        rows = spread(parts)
        assert sum(rows) == parts.count() <= 2 * n + 1 and len(rows) >= 8 and max(rows) < 0.4 * sum(rows)
    assert parts.where("start = 9000000").count() == 0


def test_faulty_events_are_errors(spark):
    schema = "series_id string, kind string, start double, stop double"
    for bad in ([("pred", 1.0, 1.0)], [("pred", 1.0, 3.0), ("pred", 2.0, 4.0)], [("truth", 3.0, 3.0)], [("pred", 8.0, 12.0)]):
        df = spark.createDataFrame([("s", "truth", 0.5, 0.75), *[("s", *b) for b in bad]], schema)
        with pytest.raises(Exception, match="events overlap"):
            E.affiliation(df, spark.createDataFrame([("s", 0.0, 10.0)], "series_id string, lo double, hi double")).collect()
    assert E.affiliation(spark.createDataFrame([("s", "pred", 1.0, 2.0)], schema)).count() == 0


def test_threshold_events_grow_with_changes(spark):
    """Runs above each cut, equal to those of the rows that exceed it; rows without a change make none."""
    rng = np.random.default_rng(3)
    score = np.concatenate([np.repeat(rng.random(8), 100), rng.random(40), [np.nan, 2.0, 2.0]])
    df = spark.createDataFrame([("s", t, float(x)) for t, x in enumerate(score)], "series_id string, t long, score double").repartition(3)
    cuts = [0.1, 0.3, 0.3, 0.5, 0.9, 1.5, 3.0]
    got = {(r.place, r.start, r.stop) for r in E.threshold_events(df, spark.createDataFrame([("s", cuts)], "series_id string, cuts array<double>"), rows=60).collect()}
    plain = set()
    for i, c in enumerate(cuts):
        on = np.concatenate([[False], score > c, [False]])
        turn = np.flatnonzero(on[1:] != on[:-1])
        plain |= {(i, int(a), int(b)) for a, b in zip(turn[::2], turn[1::2], strict=True)}
    assert got == plain and len(got) < 200


def test_evaluate_several_series_is_one_row(spark):
    rng = np.random.default_rng(5)
    rows = [(s, t, int(30 <= t < 40), float(rng.random() + (30 <= t < 42))) for s in ("a", "b", "c") for t in range(80)]
    df = spark.createDataFrame(rows, "series_id string, t long, label int, score double")
    for best in (True, False):
        for affiliated in (True, False):
            out = E.evaluate(df, df, anomaly_ratio=10.0, best=best, affiliated=affiliated).collect()
            assert len(out) == 1 and 0 < out[0].f1 <= 1
