"""Detectors, policies, deployments, evaluation and sources."""

from __future__ import annotations

import gzip
import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.functions import intervals as I
from driftwell.functions.text import name_list, natural_key, percent, tag_list
from driftwell.operators import ahsc, attribution, events_eval as E, policy, signals, social
from driftwell.operators.detectors import DETECTORS, EnsembleDetector, longest_runs
from driftwell.operators.signals import KEYS, SignalSchema
from driftwell.operators.thresholds import THRESHOLDS, fuse
from driftwell.plans import cli, observability
from driftwell.plans.config import ComponentSpec, DeploymentConfig
from driftwell.plans.deployment import build, render_report
from driftwell.plans.errors import ConfigError, DeploymentError, NotFittedError, PolicyError, RegistryError, RollbackError, SignalError
from driftwell.plans.registry import Registry
from driftwell.plans.rollout import ROLLOUTS, Stage, stage_table
from driftwell.sources import datasets, sinks
from driftwell.sources.synthetic import SyntheticStream, build_scenario, frame, inject_regression

NAMES = ["ewma", "causal", "diffusion", "spatiotemporal", "habituation"]


@pytest.fixture(scope="module")
def stream(spark):
    s = SyntheticStream(n_channels=4, seed=7)
    windows = frame(spark, {0: s.baseline(120, 42), 1: s.baseline(120, 9), 2: s.noisy(s.baseline(120, 5), 2.0)})
    shifted = inject_regression(windows.where("stage = 1"), 30, 1.5, ["ch0", "ch1"]).drop("label")
    return frame(spark, {-1: s.baseline(600)}).cache(), windows.where("stage <> 1").unionByName(shifted).cache()


@pytest.mark.parametrize("name", NAMES)
def test_detector(spark, stream, name):
    baseline, windows = stream
    with pytest.raises(NotFittedError):
        DETECTORS.create(name).score(windows)
    got = {r.stage: r for r in DETECTORS.create(name).fit(baseline).results(windows).collect()}
    assert got[0].anomaly_rate <= 0.15 and got[0].n_points == 120
    assert got[1].anomaly_rate >= got[0].anomaly_rate
    for r in got.values():
        assert math.isclose(sum(r.attribution.values()), 1.0, abs_tol=1e-6)
    if name == "diffusion":
        assert got[2].anomaly_rate < 0.12


def reference_scores(name: str, base: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Plain numpy forms of the detectors' scores."""
    mean, std = base.mean(0), base.std(0) + 1e-8
    base, x = (base - mean) / std, (x - mean) / std
    if name == "ewma":
        p = np.empty_like(x)
        p[0] = x[0]
        for i in range(1, len(x)):
            p[i] = 0.3 * x[i - 1] + 0.7 * p[i - 1]
        return np.abs(x - p).mean(1)
    if name == "causal":
        out = []
        for j in range(x.shape[1]):
            a = lambda m: np.hstack([np.delete(m, j, 1), np.ones((len(m), 1))])  # noqa: B023, E731
            w = np.linalg.solve(a(base).T @ a(base) + 1e-2 * np.eye(x.shape[1]), a(base).T @ base[:, j])
            out.append((x[:, j] - a(x) @ w) / ((base[:, j] - a(base) @ w).std() + 1e-8))
        return np.sqrt((np.array(out) ** 2).mean(0))
    if name == "diffusion":
        center = base.mean(0)
        _, s, vt = np.linalg.svd(base - center, full_matrices=False)
        v = vt[: max(1, min(int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.9) + 1), len(vt)))]
        best = np.inf
        for sigma in (0, 1, 2, 4):
            y = x
            if sigma:
                r = max(1, int(3 * sigma))
                k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
                y = np.stack([np.convolve(c, k / k.sum(), "same") for c in x.T], 1)
            e = y - center
            best = np.minimum(best, np.linalg.norm(e - e @ v.T @ v, axis=1))
        return best
    return ahsc.StreamClusters().fit(base).scores(x)


@pytest.mark.parametrize("name", ["ewma", "causal", "diffusion", "habituation"])
def test_scores_equal_numpy(spark, name):
    s = SyntheticStream(n_channels=3, seed=3)
    base, x = s.baseline(300), s.baseline(80, 4)
    got = DETECTORS.create(name).fit(frame(spark, {-1: base})).score(frame(spark, {0: x})).orderBy("t").toPandas()["score"].to_numpy()
    assert np.allclose(got, reference_scores(name, base, x), atol=1e-7)


def test_single_channel(spark):
    s = SyntheticStream(n_channels=1, seed=1)
    d = DETECTORS.create("causal").fit(frame(spark, {-1: s.baseline(200)}))
    assert d.results(frame(spark, {0: s.baseline(50, 2)})).first().attribution == {"ch0": 1.0}


def test_causal_names_channel(spark):
    s = SyntheticStream(n_channels=4, seed=7)
    w = inject_regression(frame(spark, {0: s.baseline(120, 3)}), 20, 1.5, ["ch0"]).drop("label")
    r = DETECTORS.create("causal").fit(frame(spark, {-1: s.baseline(600)})).results(w)
    assert attribution.ranked(r, [f"ch{i}" for i in range(4)], 1).first().channel == "ch0"
    assert attribution.summary(attribution.ranked(r, [f"ch{i}" for i in range(4)], 2)).first().root_cause.startswith("ch0 (")


def test_ensemble(spark, stream):
    baseline, windows = stream
    d = EnsembleDetector(["ewma", "causal"]).fit(baseline)
    for r in d.results(windows).collect():
        assert math.isclose(sum(r.attribution.values()), 1.0, abs_tol=1e-6)
    with pytest.raises(ConfigError):
        EnsembleDetector([])
    with pytest.raises(ConfigError):
        fuse([F.col("a")], "weighted")
    with pytest.raises(ConfigError):
        fuse([], "mean")


def test_adaptive_masks_itself(spark, stream):
    baseline, windows = stream
    fixed = DETECTORS.create("ewma").fit(baseline)
    own = DETECTORS.create("ewma", threshold=THRESHOLDS.create("adaptive")).fit(baseline)
    a, b = ({r.stage: r.threshold for r in d.results(windows).collect()} for d in (fixed, own))
    assert all(b[k] >= a[k] - 1e-9 for k in a)
    with pytest.raises(ConfigError):
        THRESHOLDS.create("quantile", q=1.0)


OUTCOMES = {"ewma": "CCCRR", "causal": "CRRRR"}


@pytest.mark.parametrize("detector", sorted(OUTCOMES))
def test_outcomes(spark, detector):
    got = ""
    for name in ("healthy", "regression", "drift", "spike", "noisy"):
        s = build_scenario(spark, name, seed=0)
        config = DeploymentConfig.from_dict({"detector": detector, "rollout": "canary", "policy": "risk_aware"})
        r = build(config).fit(s.baseline).run(s.windows)
        got += "C" if r.success else "R" if r.rolled_back else "H"
    assert got == OUTCOMES[detector]


def test_report(spark):
    s = build_scenario(spark, "regression", seed=0)
    r = build(DeploymentConfig.from_dict({"detector": "diffusion", "rollout": "regional", "policy": "risk_aware", "risk_tier": "high_impact"})).fit(s.baseline).run(s.windows)
    assert r.rolled_back and r.final_state == "rolled_back" and r.detection_delay == 3.0 and r.mitigation_time == 1.0
    assert r.root_cause.split(" ")[0] in ("ch0", "ch1")
    assert "failure isolated to 'apac'" in render_report(r)
    with pytest.raises(NotFittedError):
        build(DeploymentConfig.from_dict({"detector": "ewma", "rollout": "canary", "policy": "threshold"})).run(s.windows)


def window(spark, scores, threshold=1.0):
    rows = [("s", 0, t, float(x), threshold, x > threshold) for t, x in enumerate(scores)]
    df = spark.createDataFrame(rows, "stream_id string, stage int, t long, score double, threshold double, flag boolean")
    agg = df.groupBy(*KEYS).agg(F.max("score").alias("score"), F.max("threshold").alias("threshold"), F.avg(F.col("flag").cast("double")).alias("anomaly_rate"))
    return agg.join(longest_runs(df), KEYS, "left").withColumn("run", F.coalesce("run", F.lit(0)))


def test_policy(spark):
    act = lambda scores, tier="standard", thr=1.0: policy.RiskAwarePolicy().evaluate(window(spark, scores, thr), tier).first()
    assert act([0.0] * 50).action == "promote"
    sustained = act([0.0] * 30 + [5.0] * 20)
    assert sustained.action == "rollback" and "run=20, rate=40%, peak=5.0x threshold" in sustained.reason
    assert act([5.0 if i % 4 == 0 else 0.0 for i in range(50)]).action != "rollback"
    assert act([0.0, 0.0, -1.0, 0.5, 0.6, 0.7], thr=0.0).action == "rollback"
    with pytest.raises(PolicyError):
        policy.tier_limits("none")
    assert policy.tier_limits("HIGH_IMPACT")["min_persistence"] == 2
    assert policy.ThresholdPolicy().evaluate(window(spark, [0.0] * 9), "nonsense").first().action == "promote"


def test_rollouts(spark):
    assert [s.name for s in ROLLOUTS.create("canary").stages()] == ["canary", "5%", "25%", "50%", "100%"]
    assert [s.exposure for s in ROLLOUTS.create("regional").stages()] == [0.25, 0.5, 0.75, 1.0]
    assert [s.name for s in ROLLOUTS.create("percentage", steps=(0.29, 1.0)).stages()] == ["28%", "100%"]
    assert [s.name for s in ROLLOUTS.create("blue_green").stages()] == ["shadow", "cutover"]
    with pytest.raises(ValueError):
        Stage("x", 1.5, 0)
    assert stage_table(spark, ROLLOUTS.create("canary").stages()).count() == 5


def test_registry_and_config(tmp_path):
    r = Registry("thing")
    r.register("One")(dict)
    with pytest.raises(RegistryError):
        r.register("one")(dict)
    with pytest.raises(RegistryError):
        r.get("two")
    assert "ONE" in r and r.names() == ["one"] and len(r) == 1 and list(r) == ["one"]
    assert ComponentSpec.parse({"name": "a", "x": 1, "params": {"x": 2}}).params == {"x": 2}
    for bad in ({}, [], {"detector": 3, "rollout": "a", "policy": "b"}):
        with pytest.raises(ConfigError):
            DeploymentConfig.from_dict(bad)
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("detector: ewma\nrollout: canary\npolicy: threshold\nthreshold: {name: adaptive, k: 3, alpha: 0.1}\nrisk_tier: high_impact\n")
    c = DeploymentConfig.from_yaml(str(tmp_path / "c.yaml"))
    assert c.risk_tier == "high_impact" and build(c).detector.threshold.alpha == 0.1


def test_observability(spark, tmp_path):
    snaps = observability.Snapshots()
    with pytest.raises(RollbackError):
        snaps.rollback_target()
    snaps.register("a", True)
    snaps.register("b")
    snaps.mark_safe("b")
    assert snaps.rollback_target().snapshot_id == "b" and snaps.get("a").version == 1
    with pytest.raises(RollbackError):
        snaps.register("a")
    m = observability.StateMachine()
    with pytest.raises(DeploymentError):
        m.transition("completed")
    path, out = tmp_path / "e.json", io.StringIO()
    bus = observability.EventBus([observability.JsonExporter(str(path)), observability.ConsoleExporter(out, True), observability.NullExporter()])
    bus.publish(observability.Event("promoted", "on", "canary", {"k": 1}))
    bus.flush()
    assert json.loads(path.read_text())[0]["kind"] == "promoted" and "[canary] on (k=1)" in out.getvalue()
    assert bus.table(spark).count() == 1 and len(bus.events_of("promoted")) == 1
    assert "promoted" in sinks.console_lines(bus.table(spark)).first().line


def test_cli(spark, capsys, tmp_path):
    assert cli.main(["list"]) == 0 and "diffusion" in capsys.readouterr().out
    assert cli.main(["run", "--detector", "ewma", "--scenario", "spike", "--json", str(tmp_path / "e.json")], spark) == 0
    assert "ROLLED BACK" in capsys.readouterr().out and "gate_evaluated" in (tmp_path / "e.json").read_text()


def test_clusters():
    units = ahsc.Units.draw(4, 40, 0.1, 0.05, 0)
    m = ahsc.Units(units.channel, units.first, 1.0).codes(np.eye(4))
    assert m.shape == (4, 160) and set(np.unique(m)) <= {0.0, 1.0} and (m.sum(0) >= 1).all()
    w = ahsc.Units(np.arange(10), np.arange(10), 0.2).codes(np.array([[1, 9, 2, 8, 3, 4, 5, 6, 7, 0.5]]))
    assert sorted(w[w > 0]) == [8, 9]
    assert ahsc.grown_radius(1, 1, 2, 9) == 1.5 and ahsc.grown_radius(1, 50, 2, 3) == 3
    s = ahsc.Space(2, 100, 10, 2)
    for c in ((0.0, 0.0), (1.5, 0.0), (20.0, 0.0)):
        s.add(np.array(c), 1.0, 1, 0)
    s.regroup()
    assert s.group.tolist() == [0, 0, 1] and s.nearest(np.array([19.0, 0.0]))[0] == 2
    rng = np.random.default_rng(1)
    blobs = np.vstack([rng.normal(c, 0.3, (250, 4)) for c in (0, 5, 10)])
    rng.shuffle(blobs)
    model = ahsc.StreamClusters(seed=0).fit(blobs)
    assert model.scores(rng.normal(20, 0.3, (60, 4))).mean() > 2 * model.scores(blobs[:180]).mean()


def test_signals(spark):
    with pytest.raises(SignalError):
        SignalSchema(["a"], {"b": "outputs"})
    schema = SignalSchema(["a", "b"], {"b": "outputs"})
    assert schema.columns_for("outputs") == ["b"] and schema.columns_for("features") == ["a", "b"] and schema.index_of("b") == 1
    df = spark.createDataFrame([("s", t, float(t)) for t in range(10)], "stream_id string, t long, a double")
    got = signals.sliding_windows(df, 4, 3).groupBy("window").agg(F.min("t").alias("lo"), F.count("*").alias("n")).collect()
    assert {(r.window, r.lo, r.n) for r in got} == {(0, 0, 4), (1, 3, 4), (2, 6, 4)}
    assert signals.sliding_windows(df, 11).count() == 0
    with pytest.raises(ValueError):
        signals.sliding_windows(df, 0)
    assert {r.window_start for r in signals.aligned_windows(df, 4, 4).collect()} == {0, 4, 6}
    assert {r.window_start for r in signals.aligned_windows(df, 40, 4).collect()} == {0}
    last = signals.trailing_buffer(df, ["a"], 3).orderBy(F.desc("t")).first()
    assert last.a == [7.0, 8.0, 9.0] and last.full
    zero = df.withColumn("z", F.lit(0.0))
    assert signals.drop_zero_channels(zero, ["a", "z"])[1] == ["a"]


def numeric_affiliation(pred, truth, span, steps=4000):
    """Precision and recall by affiliation, from sums over fine grids."""
    def distance(x, events):
        return min(max(a - x, x - b, 0.0) for a, b in events)

    p, r = [], []
    for (a, b), (lo, hi) in zip(truth, I.zones(truth, span), strict=True):
        inside = I.parts_in(pred, (lo, hi))
        zone = np.linspace(lo, hi, steps)
        far = np.array([max(a - x, x - b, 0.0) for x in zone])
        if inside:
            points = np.concatenate([np.linspace(s, e, 300, endpoint=False) + (e - s) / 600 for s, e in inside])
            weights = np.concatenate([np.full(300, (e - s) / 300) for s, e in inside])
            survive = np.array([(far >= max(a - x, x - b, 0.0)).mean() if max(a - x, x - b, 0.0) > 0 else 1.0 for x in points])
            p.append((survive * weights).sum() / weights.sum())
            ys = np.linspace(a, b, 400, endpoint=False) + (b - a) / 800
            r.append(np.mean([(np.abs(zone - y) >= distance(y, inside)).mean() if distance(y, inside) > 0 else 1.0 for y in ys]))
        else:
            r.append(0.0)
    return np.mean(p), np.mean(r)


def test_affiliation():
    assert I.zones([(1, 2), (3, 4), (5, 6)], (1, 10)) == [(1, 2.5), (2.5, 4.5), (4.5, 10)]
    truth, pred, span = [(10.0, 20.0), (40.0, 45.0), (70.0, 72.0)], [(12.0, 18.0), (25.0, 28.0), (44.0, 50.0)], (0.0, 100.0)
    got = I.affiliation(pred, truth, span)
    p, r = numeric_affiliation(pred, truth, span)
    assert math.isclose(got["precision"], p, abs_tol=0.01) and math.isclose(got["recall"], r, abs_tol=0.01)
    assert I.affiliation(truth, truth, span) == {"precision": 1.0, "recall": 1.0, "f1": 1.0}
    for bad in (([], [], span), ([(3.0, 2.0)], truth, span), ([(1.0, 5.0), (4.0, 6.0)], truth, span)):
        with pytest.raises(ValueError):
            I.affiliation(*bad)
    assert math.isnan(I.precision([], (1, 2))) and I.recall([], (1, 2)) == math.inf
    assert math.isclose(I.precision([(0.0, 1.0)], (2.0, 3.0)), 1.5)


def test_evaluation(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.9, 1), (0.95, 1), (0.15, 0)], "score double, label int")
    assert E.confusion(df, 0.5).first().f1 == 1.0 and E.best_threshold(df).first().f1 == 1.0 and E.best_f1(df).first().f1 == 1.0
    assert E.roc_auc(df).first().auc == 1.0
    assert E.best_threshold(df.withColumn("score", F.lit(1.0))).first().threshold == 1.0
    rng = np.random.default_rng(3)
    scores, labels = np.round(rng.random(200), 2), rng.integers(0, 2, 200)
    many = spark.createDataFrame([(float(s), int(v)) for s, v in zip(scores, labels, strict=True)], "score double, label int")
    best = max(((2 * (tp := ((scores > x) & (labels == 1)).sum()) / (tp + (scores > x).sum() - tp + labels.sum()) if (scores > x).any() else 0.0, -k) for k, x in enumerate(np.linspace(scores.min(), scores.max(), 100))))
    assert math.isclose(E.best_threshold(many).first().f1, best[0], rel_tol=1e-9)
    rows = [("s", t, int(g), bool(p)) for t, (g, p) in enumerate(zip([1, 1, 1, 0, 1, 1, 0], [0, 1, 0, 0, 0, 0, 1], strict=True))]
    pa = E.point_adjusted(spark.createDataFrame(rows, "stream_id string, t long, label int, flag boolean"), ["stream_id"]).orderBy("t").collect()
    assert [r.adjusted for r in pa] == [False, True, True, False, False, False, True]
    ev = E.events_of(spark.createDataFrame([("s", t, v) for t, v in enumerate([0, 1, 1, 0, 0, 1, 0])], "stream_id string, t long, on int"), "on", ["stream_id"])
    assert sorted((r.start, r.stop) for r in ev.collect()) == [(1, 3), (5, 6)]


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(name_list(F.array(*map(F.lit, n)).cast("array<string>"))) for n in ([], ["a"], ["a", "b"], ["a", "b", "c"])] == ["", "a", "a and b", "a, b and c"]
    assert one(tag_list(F.lit("a,, b," + "x" * 21 + "," + "y" * 20))) == ["a", " b", "y" * 20]
    assert one(percent(F.lit(0.125))) == "12%"
    names = spark.createDataFrame([("m-10",), ("m-9",), ("m-2-1",)], "n string").orderBy(natural_key(F.col("n")))
    assert [r.n for r in names.collect()] == ["m-2-1", "m-9", "m-10"]


def test_datasets(spark, tmp_path):
    (tmp_path / "m-1.csv").write_text("time,a,b\n0,1,2\n1,3,x\n")
    got = datasets.csv_series(spark, f"{tmp_path}/m-1.csv", ["a", "b"], header=True, drop_first=True).orderBy("t").collect()
    assert [(r.entity, r.t, r.a, r.b) for r in got] == [("m-1.csv", 0, 1.0, 2.0), ("m-1.csv", 1, 3.0, None)]
    np.save(tmp_path / "P-1.npy", np.arange(6).reshape(3, 2))
    npy = datasets.npy_series(spark, f"{tmp_path}/P-1.npy", 2).orderBy("t").collect()
    assert [(r.entity, r.t, list(r.x)) for r in npy] == [("P-1", 0, [0.0, 1.0]), ("P-1", 1, [2.0, 3.0]), ("P-1", 2, [4.0, 5.0])]
    iv = spark.createDataFrame([("P-1", "[[1, 3], [4, 5]]", 6)], "chan_id string, anomaly_sequences string, num_values int")
    assert [r.label for r in datasets.labelled_intervals(iv).orderBy("t").collect()] == [0, 1, 1, 0, 1, 0]
    with gzip.open(tmp_path / "v.gz", "wt") as f:
        f.write("0\n1\n1\n")
    assert [r.flag for r in datasets.binary_vector(spark, f"{tmp_path}/v.gz").orderBy("t").collect()] == [0, 1, 1]
    sql = "INSERT INTO `tag` VALUES (1,2,'a, \\'b\\''),(2,3,NULL);\nINSERT INTO `tag` VALUES (3,4,'it''s (x)');"
    rows = datasets.dump_table(spark, sql, "tag", "tagID long, pushPinID long, tag string").orderBy("tagID").collect()
    assert [tuple(r) for r in rows] == [(1, 2, "a, 'b'"), (2, 3, None), (3, 4, "it's (x)")]
    clock = datasets.minute_clock(spark.createDataFrame([("a", 0), ("a", 61)], "entity string, t long"), "2024-01-01 00:00:00").orderBy("t").collect()
    assert str(clock[1].ts) == "2024-01-01 01:01:00"
    swat = spark.createDataFrame([(" 28/12/2015 10:00:00 AM", "Normal"), ("2/1/2016 1:05:09 PM", "A ttack")], "Timestamp string, `Normal/Attack` string")
    got = swat.select(datasets.attack_clock().alias("ts"), F.when(F.trim(F.col("`Normal/Attack`")) != "Normal", 1).otherwise(0).alias("y")).collect()
    assert [(str(r.ts), r.y) for r in got] == [("2015-12-28 10:00:00", 0), ("2016-01-02 13:05:09", 1)]
    df = spark.createDataFrame([(1,)], "a int")
    sinks.replace_table(df, f"{tmp_path}/table")
    sinks.replace_table(spark.read.parquet(f"{tmp_path}/table").select((F.col("a") + 1).alias("a")), f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").first().a == 2
    sinks.append_results(spark, f"{tmp_path}/out", f1=0.5)
    sinks.append_results(spark, f"{tmp_path}/out", f1=0.6)
    assert spark.read.text(f"{tmp_path}/out").count() == 2


@pytest.fixture(scope="module")
def boards(spark):
    make = spark.createDataFrame
    return {
        "user": make([(1, "a", "-", "Ann"), (2, "b", "-", "Bo"), (3, "c", "-", "Cy")], "userID long, email string, pin string, name string"),
        "corkboard": make([(1, "a", "Food", "Pies", "2024-01-03 00:00:00"), (2, "a", "Art", "Secret", None), (3, "b", "Food", "Soups", "2024-01-02 00:00:00")], "corkBoardID long, email string, cat_name string, title string, last_update string").withColumn("last_update", F.col("last_update").cast("timestamp_ntz")),
        "privatecorkboard": make([(2, None, "pw")], "corkBoardID long, last_update string, password string"),
        "pushpin": make([(10, 1, "https://x.org/1", "apple pie"), (11, 2, "http://x.org/2", "hidden apple"), (12, 1, "y.org", None)], "pushPinID long, corkBoardID long, image_URL string, description string"),
        "tag": make([(1, 10, "Tasty"), (2, 10, " tasty"), (3, 11, "Tasty")], "tagID long, pushPinID long, tag string"),
        "follow": make([(1, "b", "a")], "followID long, email string, owner_email string"),
        "likes": make([(1, "b", 10), (2, "c", 10)], "LikesID long, email string, pushPinID long"),
        "watch": make([(1, "c", 2)], "WatchID long, email string, corkBoardID long"),
        "comment": make([(1, "b", None, "yum", 10)], "commentID long, email string, added_time string, content string, pushPinID long"),
    }


def test_social(spark, boards):
    got = lambda df: [tuple(r) for r in df.collect()]
    assert [r.title for r in social.recent_feed(boards, "b").collect()] == ["Pies", "Soups", "Secret"]
    watched = social.recent_feed(boards, "c").collect()
    assert [(r.title, r.password) for r in watched] == [("Secret", None)]
    assert got(social.my_boards(boards, "a")) == [(1, 2, "Pies", None), (2, 1, "Secret", "pw")]
    assert got(social.my_boards(boards, "c")) == []
    assert got(social.popular_tags(boards))[0] == ("Tasty", 2, 2)
    assert got(social.popular_sites(boards))[0] == ("x.org", 2)
    assert got(social.board_stats(boards)) == [("Ann", 1, 2, 1, 1), ("Bo", 1, 0, 0, 0), ("Cy", 0, 0, 0, 0)]
    assert {r.pushPinID for r in social.search(boards, "apple").collect()} == {10}
    assert {r.pushPinID for r in social.search(boards, "food").collect()} == {10, 12}
    none = boards | {"privatecorkboard": boards["privatecorkboard"].where("false")}
    assert social.search(none, "food").count() == 0 and {r.pushPinID for r in social.search(none, "apple").collect()} == {10, 11}
    assert social.search(boards, "it's").count() == 0
    assert social.pin_likers(boards, 10).first().names == "Bo and Cy"
    assert social.pin_comments(boards, 10).first().name == "Bo" and social.watchers(boards, 2).first().watchers == 1
    page = social.board_page(boards, 2, "c").first()
    assert page.private and page.watched and not page.followed and page.pins == 1
    new = spark.createDataFrame([("b", 10), ("a", 10), ("a", 10)], "email string, pushPinID long")
    assert sorted((r.email, r.LikesID) for r in social.toggle(boards["likes"], new, ["email", "pushPinID"], "LikesID").collect()) == [("a", 3), ("c", 2)]
    follow = spark.createDataFrame([("b", "a"), ("c", "a")], "email string, owner_email string")
    assert social.insert_absent(boards["follow"], follow, ["email", "owner_email"], "followID").count() == 2
    tags = social.add_tags(boards, spark.createDataFrame([(12, "new,,old")], "pushPinID long, tags string"))
    assert tags.count() == 5 and tags.agg(F.max("tagID")).first()[0] == 5
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    touched = social.touch_boards(boards["corkboard"], spark.createDataFrame([(2,)], "corkBoardID long"), at)
    assert str(touched.where("corkBoardID = 2").first().last_update) == "2024-02-01 00:00:00"
    check = social.register_check(boards, spark.createDataFrame([("a", "New"), ("z", "Bo")], "email string, name string"))
    assert {(r.email, r.email_taken, r.name_taken) for r in check.collect()} == {("a", True, False), ("z", False, True)}
    assert social.opens(boards, 2, "pw").first().opens and not social.opens(boards, 1, "pw").first().opens


def test_streaming(spark, tmp_path):
    from driftwell.streaming import buffers

    rows = spark.createDataFrame([("s", t, float(t)) for t in range(6)], "stream_id string, t long, value double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = buffers.trailing_stats(live, 3).writeStream.format("memory").queryName("stats").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.t, r.n, r.total) for r in spark.sql("select * from stats order by t").collect()] == [(0, 1, 0), (1, 2, 1), (2, 3, 3), (3, 3, 6), (4, 3, 9), (5, 3, 12)]
    ev = spark.createDataFrame([("2024-01-01 00:10:00", "click", 1), ("2024-01-01 00:20:00", "view", 1), ("2024-01-01 05:00:00", "click", 1)], "ts string, event_type string, user_id long")
    got = buffers.windowed_counts(ev, ["click", "view"]).orderBy("start").collect()
    assert [(r.click, r.view) for r in got] == [(1.0, 1.0), (1.0, 0.0)]
    assert sorted(r.events for r in buffers.session_counts(ev).collect()) == [1, 2]
    s = SyntheticStream(n_channels=2, seed=1)
    detector = DETECTORS.create("ewma").fit(frame(spark, {-1: s.baseline(200)}))
    seen = []
    windows = frame(spark, {0: s.baseline(40, 1), 1: s.baseline(40, 2)})
    windows.write.parquet(f"{tmp_path}/windows")
    q = spark.readStream.schema(windows.schema).parquet(f"{tmp_path}/windows").writeStream.foreachBatch(
        buffers.gate_batches(detector, policy.RiskAwarePolicy(), lambda df, epoch: seen.extend(r.action for r in df.collect()))
    ).start()
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 2
