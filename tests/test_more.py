"""Global order, affiliation in columns, window measures, prepared datasets, saved detectors, sources, schemas."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.functions import intervals as I
from driftwell.functions import series as S
from driftwell.functions.order import numbered, running
from driftwell.operators import events_eval as E, signals
from driftwell.operators.detectors import DETECTORS
from driftwell.plans import models
from driftwell.plans.config import DeploymentConfig
from driftwell.plans.deployment import build
from driftwell.plans.errors import ConfigError
from driftwell.plans.rollout import ROLLOUTS
from driftwell.sources import prepared, tables
from driftwell.sources.observed import CallableSource, StaticSource, windows_of
from driftwell.sources.synthetic import SyntheticStream, frame


def test_global_order(spark):
    """Numbers and running sums equal those of one task, also where one key holds a third of the rows."""
    rng = np.random.default_rng(0)
    rows = [(int(i), int(k), f"n{k}") for i, k in enumerate(np.where(rng.random(900) < 0.33, 7, rng.integers(0, 500, 900)))] + [(-1, None, None)]
    df = spark.createDataFrame(rows, "i long, k long, s string").repartition(5)
    got = numbered(df, "n", F.col("s"), F.col("i"), ranges=7).collect()
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0])), 1)}
    assert {r.i: r.n for r in got} == want
    down = {r.i: (r.sum, r.rows) for r in running(df.withColumn("one", F.lit(1)), {"sum": "k", "rows": "one"}, -F.col("i"), ranges=5).collect()}
    total = 0
    for n, (i, k, _) in enumerate(sorted(rows, key=lambda r: -r[0]), 1):
        total += k or 0
        assert down[i] == (total, n)
    assert numbered(df.where("false"), "n", F.col("i")).count() == 0


def test_affiliation_in_columns(spark):
    """Equal to the closed forms on the driver for random events, also of series with one event or no prediction."""
    rng = np.random.default_rng(5)
    events, spans, want = [], [], {}
    for s in range(12):
        cuts = np.sort(rng.choice(2000, 2 * int(rng.integers(1, 12)), replace=False)).astype(float)
        truth = list(zip(cuts[::2], cuts[1::2], strict=True))
        cuts = np.sort(rng.choice(2000, 2 * int(rng.integers(0 if s % 3 else 1, 15)), replace=False)).astype(float)
        pred = [] if s == 5 else list(zip(cuts[::2], cuts[1::2], strict=True))
        events += [(f"s{s}", k, float(a), float(b)) for k, x in (("pred", pred), ("truth", truth)) for a, b in x]
        spans.append((f"s{s}", 0.0, 2000.0))
        want[f"s{s}"] = I.affiliation(pred, truth, (0.0, 2000.0))
    make = lambda rows: spark.createDataFrame(rows, "series_id string, kind string, start double, stop double")
    span = spark.createDataFrame(spans, "series_id string, lo double, hi double")
    for r in E.affiliation(make(events), span).collect():
        for k, v in want[r.series_id].items():
            assert math.isclose(r[k], v, abs_tol=1e-9) or (math.isnan(r[k]) and math.isnan(v)), (r, k, v)
    for bad in ([("s0", "truth", 5.0, 5.0)], [("s0", "truth", 1.0, 9.0), ("s0", "truth", 8.0, 12.0)], [("s0", "truth", -1.0, 3.0)]):
        with pytest.raises(Exception, match="events"):
            E.affiliation(make(bad), span).collect()


def test_best_affiliation(spark):
    """The grid's best threshold, against one evaluation after another."""
    rng = np.random.default_rng(2)
    label = (rng.random(300) < 0.05).astype(int)
    label[40:60] = label[200:215] = 1
    score = np.round(rng.random(300) + label * 0.4, 2)
    df = spark.createDataFrame([("s", t, int(y), float(x)) for t, (y, x) in enumerate(zip(label, score, strict=True))], "series_id string, t long, label int, score double")
    runs = lambda on: [(float(a), float(b)) for a, b in zip(*(np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])) == d) for d in (1, -1)), strict=True)]
    best = (-1.0, None)
    for cut in np.quantile(score, np.linspace(0.001, 0.999, 20)):
        pred = runs((score > cut).astype(int))
        if pred:
            got = I.affiliation(pred, runs(label), (0.0, 300.0))
            f1 = 2 * got["precision"] * got["recall"] / (got["precision"] + got["recall"] + 1e-8)
            best = max(best, (f1, -cut), key=lambda x: x[0])
    r = E.best_affiliation_f1(df, steps=20).first()
    assert math.isclose(r.f1, best[0], rel_tol=1e-9) and math.isclose(r.threshold, -best[1], rel_tol=1e-9)
    assert math.isclose(E.accuracy(df, 0.7).first().accuracy, ((score > 0.7) == (label == 1)).mean())


def test_window_measures(spark):
    df = spark.createDataFrame([("a", t, float(t)) for t in range(5)] + [("b", t, float(t % 3)) for t in range(20)], "stream_id string, t long, x double")
    w = signals.padded_windows(df, 8, 6)
    short = w.where("stream_id = 'a'").orderBy("position").collect()
    assert [(r.position, r.x, r.padded) for r in short] == [(i, float(min(i, 4)), i > 4) for i in range(8)]
    assert {r.window_start for r in w.where("stream_id = 'b'").select("window_start").distinct().collect()} == {0, 6, 12}
    assert signals.last_rows(w, 8, 2).where("stream_id = 'b'").count() == 6
    y = signals.spectrum(w, "x", 8, ["stream_id", "window_start"]).where("stream_id = 'b' and window_start = 6").orderBy("frequency").collect()
    want = np.fft.rfft([float((6 + i) % 3) for i in range(8)])
    assert np.allclose([complex(r.re, r.im) for r in y], want)
    one = w.where("stream_id = 'b' and window_start = 0").withColumn("r", F.col("x") * 0.5 + 1)
    got = signals.kl_contributions(one, {"c": ("r", "x")}, ["window_start"]).orderBy("position").collect()
    p, q = (np.log1p(np.exp([r[k] for r in one.orderBy("position").collect()])) for k in ("r", "x"))
    d = np.log(p / p.sum()) - np.log(q / q.sum())
    assert np.allclose([r.c for r in got], p / p.sum() * d * np.log1p(d * d))
    flat = signals.overlap_average(df, w.where("not padded and window_start > 0"), ["x"]).where("stream_id = 'b'").orderBy("t").collect()
    assert [r.score for r in flat] == [0.0] * 6 + [float(t % 3) for t in range(6, 20)]
    v = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "v double").select(S.softplus(F.col("v")).alias("p"), S.sigmoid(F.col("v")).alias("s")).collect()
    assert [(round(r.p, 6), round(r.s, 6)) for r in v] == [(0.0, 0.0), (round(math.log(2), 6), 0.5), (800.0, 1.0)]


def test_prepared_datasets(spark, tmp_path):
    """Clocks that go on from training to test rows, quoted cells, spacecraft, scaling."""
    at = lambda df: [(r.entity, r.part, r.t, str(r.ts)[11:16], r.x, r.label) for r in df.orderBy("entity", "part", "t").collect()]
    (tmp_path / "psm").mkdir()
    for name, rows in (("train", "ts,a,b\n0,1,2\n1,3,\n"), ("test", 'ts,a,b\n"0,5",4,5\n1,6,7\n'), ("test_label", "ts,label\n0,0\n1,1\n")):
        (tmp_path / "psm" / f"{name}.csv").write_text(rows)
    psm = prepared.server_metrics(spark, f"{tmp_path}/psm", ["a", "b"])
    assert at(psm) == [("0", "init", 0, "00:00", [1.0, 2.0], 0), ("0", "init", 1, "00:01", [3.0, None], 0), ("0", "test", 0, "00:01", [4.0, 5.0], 0), ("0", "test", 1, "00:02", [6.0, 7.0], 1)]
    for part, n in (("train", 3), ("test", 2), ("test_label", 2)):
        (tmp_path / "smd" / part).mkdir(parents=True)
        for m in ("m-2.txt", "m-10.txt"):
            (tmp_path / "smd" / part / m).write_text("\n".join("1" if part == "test_label" else f"{i},{i}" for i in range(n)) + "\n")
    smd = prepared.machines(spark, f"{tmp_path}/smd", 2)
    clock = {(r[0], r[1], r[2]): r[3] for r in at(smd)}
    assert [clock["m-2.txt", "init", 2], clock["m-2.txt", "test", 1], clock["m-10.txt", "init", 0], clock["m-10.txt", "test", 0]] == ["00:02", "00:03", "00:02", "00:04"]
    for part, n in (("train", 4), ("test", 3)):
        (tmp_path / "nasa" / part).mkdir(parents=True)
        for chan in ("Z-1", "A-1", "P-9"):
            np.save(tmp_path / "nasa" / part / f"{chan}.npy", np.arange(n * 2).reshape(n, 2))
    (tmp_path / "nasa" / "labeled_anomalies.csv").write_text('chan_id,spacecraft,anomaly_sequences,class,num_values\nZ-1,MSL,"[[0, 1], [2, 3]]","[point, point]",3\nP-9,SMAP,"[[0, 1]]",[point],3\nA-1,MSL,"[[1, 2]]",[point],3\n')
    msl = prepared.spacecraft(spark, f"{tmp_path}/nasa", "MSL", {"MSL": 2})
    rows = at(msl)
    assert {r[0] for r in rows} == {"Z-1", "A-1"}
    assert [r[5] for r in rows if r[:2] == ("Z-1", "test")] == [1, 0, 1] and [r[3] for r in rows if r[:3] == ("A-1", "init", 0)] == ["00:03"]
    with pytest.raises(Exception, match="channels"):
        prepared.spacecraft(spark, f"{tmp_path}/nasa", "MSL", {"MSL": 3}).collect()
    scaled = prepared.scaled(msl, 2, first_only=True).where("entity = 'Z-1' and part = 'init'").orderBy("t").collect()
    assert [r.x[1] for r in scaled] == [1.0, 3.0, 5.0, 7.0] and math.isclose(sum(r.x[0] for r in scaled), 0.0, abs_tol=1e-9)
    (tmp_path / "swat").mkdir()
    for name, verdict in (("SWaT_Dataset_Normal_v1", "Normal"), ("SWaT_Dataset_Attack_v0", "A ttack")):
        (tmp_path / "swat" / f"{name}.csv").write_text(f"group\n Timestamp,L1,Normal/Attack\n 28/12/2015 10:00:00 AM,1.5,{verdict}\n 28/12/2015 10:00:01 AM,2.5,Normal\n")
    swat = prepared.water_treatment(spark, f"{tmp_path}/swat", ["L1"])
    assert [(r[1], r[4], r[5]) for r in at(swat)] == [("init", [1.5], 0), ("init", [2.5], 0), ("test", [1.5], 1), ("test", [2.5], 0)]
    assert prepared.without_settling(swat, 1).count() == 3


@pytest.mark.parametrize("name", ["ewma", "causal", "diffusion", "spatiotemporal", "habituation"])
def test_saved_detectors(spark, tmp_path, name):
    s = SyntheticStream(n_channels=3, seed=3)
    baseline, x = frame(spark, {-1: s.baseline(200)}), frame(spark, {0: s.baseline(40, 4)})
    d = DETECTORS.create(name).fit(baseline)
    models.save(spark, d, f"{tmp_path}/model")
    again = models.load(spark, f"{tmp_path}/model")
    score = lambda m: [(r.score, r.threshold) for r in m.flagged(x).orderBy("t").collect()]
    assert np.allclose(score(d), score(again), atol=1e-12)
    with pytest.raises(ConfigError):
        models.encoded(object())


def test_sources(spark):
    s = SyntheticStream(n_channels=2, seed=1)
    windows = frame(spark, {i: s.baseline(30, i) for i in range(2)})
    stages = ROLLOUTS.create("canary").stages()
    got = windows_of(StaticSource(windows), stages)
    assert {r.stage: r.n for r in got.groupBy("stage").agg(F.count("*").alias("n")).collect()} == {i: 30 for i in range(5)}
    made = CallableSource(lambda stage: frame(spark, {0: s.baseline(20, stage.index)}))
    d = build(DeploymentConfig.from_dict({"detector": "ewma", "rollout": "blue_green", "policy": "risk_aware"})).fit(frame(spark, {-1: s.baseline(300)}))
    assert [x["n_points"] for x in d.run(made).decisions] == [20, 20]


def test_tables(spark, tmp_path):
    made = tables.create(spark, str(tmp_path))
    assert set(made) == set(tables.SCHEMAS) and all(df.count() == 0 for df in made.values())
    spark.createDataFrame([("Food",)], tables.SCHEMAS["category"]).write.mode("append").parquet(f"{tmp_path}/category")
    tables.views(tables.create(spark, str(tmp_path)))
    assert spark.sql("select cat_name from category").first()[0] == "Food"
