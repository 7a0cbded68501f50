"""Clusterings of many streams as keyed folds against the fold over a matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from driftwell.operators import ahsc
from driftwell.operators.detectors import DETECTORS, HabituationDetector
from driftwell.operators.signals import KEYS
from driftwell.plans import models


def streams(n=5, rows=180):
    rng = np.random.default_rng(1)
    return {f"s{i}": np.vstack([rng.normal(c, 0.3, (rows // 3 + i, 3)) for c in (0, 4, 9)])[rng.permutation(3 * (rows // 3 + i))] for i in range(n)}


def table(spark, data, stage=-1):
    rows = [(s, stage, t, *map(float, r)) for s, x in data.items() for t, r in enumerate(x)]
    return spark.createDataFrame(rows, "stream_id string, stage int, t long, a double, b double, c double").repartition(7)


def test_streams_equal_the_fold_of_each(spark):
    data = streams()
    fitted = {r.stream_id: ahsc.StreamClusters.from_json(r.model) for r in ahsc.fit_streams(table(spark, data), ["a", "b", "c"], {}).collect()}
    assert fitted.keys() == data.keys()
    rng = np.random.default_rng(2)
    new = rng.normal(4, 3, (40, 3))
    for s, x in data.items():
        plain = ahsc.StreamClusters().fit(x)
        assert len(plain.space) == len(fitted[s].space) and np.allclose(plain.space.center, fitted[s].space.center)
        assert np.allclose(plain.scores(new), fitted[s].scores(new)) and np.allclose(plain.background, fitted[s].background)


def test_blocks_of_a_stream():
    """Rows in batches of any size reach the fold in blocks, stream after stream, heads first."""
    import pyarrow as pa

    names = ["a"] * 3 + ["b"] * (2 * ahsc.BLOCK + 5) + [None] * 2
    head = [[1.0]] + [None] * 2 + [[2.0]] + [None] * (len(names) - 4)
    t = [-1 if h else 0 for h in head]
    whole = pa.RecordBatch.from_arrays([pa.array(names), pa.array(t, pa.int32()), pa.array(np.arange(len(names), dtype=float)), pa.array(head, pa.list_(pa.float64()))], ["stream", "t", "c0", "head"])
    batches = [whole.slice(lo, 700) for lo in range(0, len(names), 700)]
    seen = []
    run = ahsc._fold(lambda h: [h], lambda name, s, m: s.append(len(m)) or (), lambda name, s: seen.append((name, s)) or ())
    assert list(run(iter(batches))) == []
    assert seen == [("a", [[1.0], 2]), ("b", [[2.0], ahsc.BLOCK, ahsc.BLOCK, 4]), (None, [None, 2])]


def test_touching_spheres_by_pivot():
    """Groups after any moves are those of all distances."""
    rng = np.random.default_rng(5)
    space = ahsc.Space(4, 100.0, 3.0, 2)
    for _ in range(60):
        space.add(rng.normal(0, 3, 4), float(rng.random() * 1.5 + 0.1), 1, 0)
    for _ in range(80):
        i = int(rng.integers(len(space)))
        space.absorb(i, space.center[i] + rng.normal(0, 0.5, 4), space.radius[i] * 0.9, 0.5)
        if rng.random() < 0.2:
            space.weight[rng.integers(len(space))] = 0.0
            space.fade()
    space.regroup()
    gap = np.linalg.norm(space.center[:, None] - space.center[None], axis=2)
    touch = gap <= space.radius[:, None] + space.radius[None]
    assert (space.touch == touch).all()
    reach = np.linalg.matrix_power(touch.astype(float), len(space)) > 0
    assert all((space.group[i] == space.group[j]) == bool(reach[i, j]) for i in range(len(space)) for j in range(len(space)))


def test_detector_of_several_streams(spark, tmp_path, monkeypatch):
    """Each stream by its own model, however the models travel; unknown streams have no score; saved and read again."""
    data = streams(3)
    base = table(spark, data)
    rng = np.random.default_rng(3)
    new = {s: rng.normal(3, 4, (20, 3)) for s in [*data, "unknown"]}
    d = DETECTORS.create("habituation", normalize=False).fit(base)
    rows = table(spark, new, 0)
    got = {(r.stream_id, r.t): r.score for r in d.score(rows).collect()}
    for s, x in data.items():
        assert np.allclose([got[s, t] for t in range(20)], ahsc.StreamClusters().fit(x).scores(new[s]))
    assert all(got["unknown", t] is None for t in range(20))
    assert d.flagged(rows).where("stream_id = 'unknown' and flag").count() == 0
    models.save(spark, d, str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m")).score(rows)
    assert {(r.stream_id, r.t): r.score for r in again.where("stream_id <> 'unknown'").collect()} == {k: v for k, v in got.items() if k[0] != "unknown"}
    monkeypatch.setattr(HabituationDetector, "MODEL_BYTES", 0)
    other = DETECTORS.create("habituation", normalize=False).fit(base)
    assert other.models is None
    told = {(r.stream_id, r.t): r.score for r in other.score(rows).collect()}
    assert told.keys() == got.keys() and all(told[k] is None if k[0] == "unknown" else abs(told[k] - v) < 1e-9 for k, v in got.items())
    assert set(KEYS) <= set(other.score(rows).columns)


def test_streams_in_several_tasks(spark):
    tasks = ahsc.fit_streams(table(spark, streams(8, 60)), ["a", "b", "c"], {}).groupBy(F.spark_partition_id().alias("p")).agg(F.count("model").alias("n")).collect()
    assert len(tasks) > 1 and sum(r.n for r in tasks) == 8
