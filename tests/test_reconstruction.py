"""Training by gradients of many tasks against a run in one process."""

from __future__ import annotations

import numpy as np
import pytest

from driftwell.operators import reconstruction as R
from driftwell.operators.detectors import DETECTORS
from driftwell.operators.signals import KEYS
from driftwell.plans import models


def waves(n=400, seed=0, shift=0.0):
    t = np.arange(n)
    noise = np.random.default_rng(seed).normal(0, 0.05, (n, 3))
    return np.stack([np.sin(t / 5), np.cos(t / 7), np.sin(t / 3) / 2], axis=1) + noise + shift


def frame(spark, stages):
    rows = [("s", g, t, *map(float, r)) for g, x in stages.items() for t, r in enumerate(x)]
    return spark.createDataFrame(rows, "stream_id string, stage int, t long, a double, b double, c double").repartition(5)


def test_gradient_is_that_of_differences():
    rng = np.random.default_rng(1)
    net, x = R.Network.draw([6, 4, 3, 6], 2), rng.normal(size=(5, 6))
    loss, slope = net.gradient(x)
    assert loss == pytest.approx(net.losses(x).sum())
    for i in rng.choice(len(net.flat), 25, replace=False):
        up, down = (R.Network(net.sizes, net.flat + d * np.eye(len(net.flat))[i]) for d in (1e-6, -1e-6))
        assert slope[i] == pytest.approx((up.losses(x).sum() - down.losses(x).sum()) / 2e-6, abs=1e-6)


def test_clip_and_stop():
    step = R.Adam(rate=0.1, clip=1.0)
    step.step(np.zeros(2), np.array([30.0, 40.0]))
    assert np.allclose(step.first, [0.06, 0.08])
    stop, seen = R.EarlyStop(2), []
    for i, loss in enumerate([3.0, 2.0, 2.5, 2.0, 2.1, 2.2, 1.0]):
        seen.append(stop.stops(loss, np.array([i])))
    assert seen == [False] * 5 + [True, False] and stop.best[0] == 6


def test_training_equals_one_process(spark):
    """Mean losses of a seeded run, with two steps an epoch, over seven tasks and over one matrix."""
    x = np.random.default_rng(4).normal(size=(90, 12))
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "i int, x array<double>").repartition(7)
    parts, sizes = [x[::2], x[1::2]], [12, 5, 12]
    network, told = R.train([df.where("i % 2 = 0"), df.where("i % 2 = 1")], df.where("i < 20"), sizes, epochs=4, rate=0.01, seed=3)
    net, adam, plain = R.Network.draw(sizes, 3), R.Adam(0.01), []
    for _ in range(4):
        total = 0.0
        for part in parts:
            loss, slope = net.gradient(part)
            net.flat = adam.step(net.flat, slope / len(part))
            total += loss
        plain.append((total / 90, float(net.losses(x[:20]).mean())))
    assert np.allclose(told, plain, rtol=1e-9) and np.allclose(network.flat, net.flat, rtol=1e-7) and told[-1][0] < told[0][0]
    n, loss, slope = R.summed_gradient(df.limit(0), network)
    assert n == 0 and loss == 0 and not slope.any()


def test_windows(spark):
    df = frame(spark, {0: waves(70), 1: waves(9)})
    got = {(r.stage, r.window_start): r for r in R.window_rows(df, ["a", "b"], 32, 16).collect()}
    assert sorted(got) == [(0, 0), (0, 16), (0, 32), (0, 38), (1, 0)]
    assert all(len(r.x) == 64 and [p.position for p in r.rows] == list(range(32)) for r in got.values())
    assert sum(p.padded for p in got[1, 0].rows) == 23 and got[0, 38].x[0] == waves(70)[38][0]


def test_detector(spark, tmp_path):
    """Faults score above clean rows, errors are those of plain windows, and a saved detector scores the same."""
    d = DETECTORS.create("reconstruction", window_size=16, step_size=8, hidden=(12, 6, 12), epochs=8, rate=0.02, batches=2, normalize=False).fit(frame(spark, {-1: waves()}))
    assert d.losses[-1][0] < d.losses[0][0]
    broken = waves(100, 2)
    broken[60:70, 1] += 3
    df = frame(spark, {0: waves(100, 1), 1: broken})
    got = {(r.stage, r.t): r for r in d.score(df).collect()}
    assert len(got) == 200 and np.mean([got[1, t].score for t in range(60, 70)]) > 2 * np.mean([got[0, t].score for t in range(100)])
    assert max("abc", key=lambda c: sum(got[1, t][f"by_{c}"] for t in range(60, 70))) == "b"
    rows = d._reconstructed(df.where("stage = 1")).where("window_start = 56").orderBy("t").collect()
    assert np.allclose([[r.r_a, r.r_b, r.r_c] for r in rows], d.network.run(broken[56:72].reshape(1, -1))[-1].reshape(16, 3))
    models.save(spark, d, str(tmp_path / "m"))
    again = {(r.stage, r.t): r.score for r in models.load(spark, str(tmp_path / "m")).score(df).collect()}
    assert all(again[k] == pytest.approx(r.score) for k, r in got.items())
    assert set(KEYS) <= set(d.score(df).columns)
