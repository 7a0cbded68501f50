"""Filter banks, transforms, the clamp in turn and readers of split files against plain versions."""

from __future__ import annotations

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.functions import wavelets as W
from driftwell.operators import signals
from driftwell.sources import datasets as D, matrices, tables

# --- wavelets ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 5, 8, 31, 64, 101, 720])
def test_perfect_reconstruction(n):
    x, taps = np.random.default_rng(n).normal(size=n), np.array(W.DB4)
    low, high = W.analysed(x, taps)
    assert len(low) == (n + 7) // 2 and np.allclose(W.synthesised(low, high, taps)[:n], x, atol=1e-10)


def test_filter_keeps_cubics_and_lengths():
    taps = np.array(W.DB4)
    assert np.isclose(taps.sum(), 2**0.5) and np.isclose(taps @ taps, 1)
    assert all(np.isclose(taps[k:] @ taps[:-k], 0, atol=1e-10) for k in (2, 4, 6))
    assert np.allclose(W.trend(np.full(333, 2.5)), 2.5)
    t = np.arange(4000.0)
    for x in (t, t**2 / 1e3, t**3 / 1e6):  # four vanishing moments
        assert np.allclose(W.trend(x)[500:-500], x[500:-500], atol=1e-6)
    wave = np.sin(t)
    assert np.abs(W.trend(wave)[500:-500]).max() < 0.05


def test_polynomial_smooth():
    t = np.arange(90.0)
    assert np.allclose(W.polynomial_smooth(t**3 - 5 * t, 51, 3), t**3 - 5 * t)
    x = np.random.default_rng(1).normal(size=90)
    plain = [np.polyval(np.polyfit(np.arange(51) - 25, x[i - 25 : i + 26], 3), 0) for i in range(25, 65)]
    assert np.allclose(W.polynomial_smooth(x, 51, 3)[25:65], plain)
    assert np.allclose(W.polynomial_smooth(x, 51, 3)[:25], np.polyval(np.polyfit(np.arange(51), x[:51], 3), np.arange(25)))
    with pytest.raises(ValueError):
        W.polynomial_smooth(x[:50], 51, 3)


@pytest.mark.parametrize(("level", "smooth", "window"), [(5, False, 51), (3, False, 51), (3, True, 21), (1, True, 9)])
def test_trend_of_tiles_is_that_of_the_series(spark, level, smooth, window):
    """Series that end anywhere in a tile, with gaps in their order, a null name and a series of one row."""
    rng = np.random.default_rng(3)
    lengths = {"a": 1000, "b": 515, None: 64 * 8} | ({} if smooth else {"c": 1, "d": 37})
    data = {s: np.cumsum(rng.normal(size=n)) for s, n in lengths.items()}
    rows = [(s, t * 3 + t % 2, float(x), float(2 * x), "z") for s, v in data.items() for t, x in enumerate(v)]
    df = spark.createDataFrame(rows, "s string, t long, x double, y double, __x string").repartition(5)
    out = W.wavelet_trend(df.where("s is not null"), ["x", "y"], ["s"], level=level, smooth=smooth, window=window, tile=64)
    assert out.columns == [*df.columns, "trend_x", "trend_y", "stable_x", "stable_y"]
    got = out.collect()
    for s, v in data.items():
        if s is None:
            continue
        mine = sorted((r for r in got if r.s == s), key=lambda r: r.t)
        plain = W.trend(v, level, smooth, window)
        assert np.allclose([r.trend_x for r in mine], plain) and np.allclose([r.trend_y for r in mine], 2 * plain)
        assert np.allclose([r.stable_x for r in mine], v - plain)


# --- transforms --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 12, 15, 17, 64])
def test_transforms(spark, size):
    """Sizes that are no powers of two, and rows that a window lacks."""
    rng = np.random.default_rng(size)
    x = rng.normal(size=(3, size, 2))
    x[1, size // 2 :] = 0
    rows = [(w, p, float(x[w, p, 0]), float(x[w, p, 1])) for w in range(3) for p in range(size) if w != 1 or p < max(1, size // 2)]
    x[1, max(1, size // 2) :] = 0
    if size == 1:
        x[1, 0] = [rows[1][2], rows[1][3]]
    df = spark.createDataFrame(rows, "w int, position long, a double, b double").repartition(3)
    one = np.fft.rfft(x[:, :, 0], axis=1)
    got = signals.spectrum(df, "a", size, ["w"]).collect()
    assert len(got) == one.size and all(np.isclose(complex(r.re, r.im), one[r.w, r.frequency]) and np.isclose(r.power, abs(one[r.w, r.frequency]) ** 2) for r in got)
    two = np.fft.fft2(x, axes=(1, 2))
    got = signals.spectrum_2d(df, ["a", "b"], size, ["w"]).collect()
    assert len(got) == two.size and all(np.isclose(complex(r.re, r.im), two[r.w, r.frequency, r.channel_frequency]) for r in got)


def test_spectrum_moves_rows_once(spark):
    df = spark.range(6400).select((F.col("id") / 64).cast("int").alias("w"), (F.col("id") % 64).alias("position"), F.rand(1).alias("a"))
    plan = signals.spectrum(df, "a", 64, ["w"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


# --- clamp -------------------------------------------------------------------------------------------------------


def plain_clamp(x, threshold, width):
    x = np.array(x, float)
    for i in range(len(x)):
        around = x[max(0, i - width // 2) : i + width // 2 + 1]
        if x[i] - around.mean() > threshold * around.std():
            x[i] = around.mean()
    return x


@pytest.mark.parametrize(("threshold", "width"), [(3.0, 1441), (1.0, 9), (2.0, 31), (1.5, 1)])
def test_clamp_in_turn(spark, threshold, width):
    rng = np.random.default_rng(7)
    data = {s: np.where(rng.random(n) < 0.05, 40, 1) * rng.random(n) + 1e6 * (s == "high") for s, n in (("a", 1), ("b", 700), ("high", 400), ("c", 1600))}
    data["flat"] = np.full(50, 3.0)
    rows = [(s, t, float(x)) for s, v in data.items() for t, x in enumerate(v)]
    df = spark.createDataFrame(rows, "s string, t long, x double").repartition(6)
    got = D.outliers_clamped_in_turn(df, "x", ["s"], threshold=threshold, width=width).collect()
    assert len(got) == len(rows)
    for s, v in data.items():
        mine = [r.x for r in sorted((r for r in got if r.s == s), key=lambda r: r.t)]
        assert np.allclose(mine, plain_clamp(v, threshold, width), rtol=1e-9)
    if width > 1:
        assert any(r.x != data[r.s][r.t] for r in got)


def test_clamp_keeps_nulls(spark):
    df = spark.createDataFrame([("a", t, None if t == 3 else float("nan") if t == 4 else 1.0) for t in range(9)], "s string, t long, x double")
    got = sorted(D.outliers_clamped_in_turn(df, "x", ["s"], width=5).collect(), key=lambda r: r.t)
    assert got[3].x is None and got[4].x != got[4].x and [r.x for r in got[5:]] == [1.0] * 4
    assert D.outliers_clamped_in_turn(df.limit(0), "x", ["s"]).count() == 0


# --- readers -----------------------------------------------------------------------------------------------------


def test_lines_of_split_files(spark, tmp_path):
    """Files of several splits and of one, read by several tasks, numbered as a single read does."""
    rng = random.Random(1)
    files = {f"f{i}.csv": [f"{rng.random()},{j}" for j in range(n)] for i, n in enumerate((4000, 1, 900))}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = D.text_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = {(r.entity, r.t): r.value for r in df.collect()}
        assert got == {(name, j): line for name, lines in files.items() for j, line in enumerate(lines)}
        rows = D.csv_series(spark, str(tmp_path), ["x", "j"], header=True)
        assert rows.where("t <> j - 1").count() == 0 and rows.count() == sum(map(len, files.values())) - 3
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_vectors_with_blank_lines(spark, tmp_path):
    with gzip.open(tmp_path / "v.gz", "wt") as f:
        f.write("0\n1\n\n 1 \n0\n")
    got = sorted((r.t, r.flag) for r in D.binary_vector(spark, str(tmp_path)).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (3, 0)]


def test_matrices_by_ranges(spark, tmp_path):
    """Row and column order, several types and header versions; ranges, one range and a whole read agree."""
    rng = np.random.default_rng(2)
    plain = {"a": rng.normal(size=(1000, 3)), "b": np.asfortranarray(rng.normal(size=(333, 3))), "c": rng.integers(0, 9, (7, 3)).astype(np.int16), "d": rng.normal(size=(50, 3)).astype(">f4"), "e": np.zeros((0, 3))}
    for name, m in plain.items():
        np.save(tmp_path / f"{name}.npy", m)
    with open(tmp_path / "v2.npy", "wb") as f:
        np.lib.format.write_array(f, plain["a"][:5], version=(2, 0))
    plain["v2"] = plain["a"][:5]
    expected = {(name, t): list(map(float, row)) for name, m in plain.items() for t, row in enumerate(m)}
    for rows in (64, 10_000):
        got = D.npy_series(spark, str(tmp_path), 3, rows=rows)
        assert {(r.entity, r.t): r.x for r in got.collect()} == expected
    whole = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content").mapInArrow(lambda b: matrices.read_whole(b, 3), "entity string, t long, x array<double>")
    assert {(r.entity, r.t): r.x for r in whole.collect()} == expected
    chosen = spark.createDataFrame([("b",), ("c",)], "n string")
    assert D.npy_series(spark, str(tmp_path), 3, chosen).select("entity").distinct().count() == 2
    with pytest.raises(Exception, match="channels"):
        D.npy_series(spark, str(tmp_path), 4).collect()


def test_a_matrix_is_read_by_several_tasks(spark, tmp_path):
    np.save(tmp_path / "long.npy", np.random.default_rng(0).normal(size=(5000, 2)))
    got = D.npy_series(spark, str(tmp_path), 2, rows=100)
    assert got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("t").alias("n")).count() > 1 and got.select("t").distinct().count() == 5000


def test_database_tables_by_ranges(spark, tmp_path):
    """A table of a database in memory, by one connection and by several; null keys and a table of one row."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url, properties = "jdbc:derby:memory:boards;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = [(i if i % 50 else None, f"n{i}") for i in range(1, 1001)]
    spark.createDataFrame(rows, "id long, name string").write.jdbc(url, "names", properties=properties)
    spark.createDataFrame([(7, "x")], "id long, name string").write.jdbc(url, "single", properties=properties)
    for per, parts in ((100, 10), (300, 4), (5000, 1)):
        got = tables.database_table(spark, url, "names", "id", properties, rows=per)
        assert sorted((r.id or 0, r.name) for r in got.collect()) == sorted((i or 0, n) for i, n in rows)
        assert got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("name").alias("n")).count() == parts
    assert tables.database_table(spark, url, "names", "id", properties, rows=1, most=3).count() == 1000
    assert tables.database_table(spark, url, "single", "id", properties, rows=1).count() == 1
    assert tables.database_table(spark, url, "names", None, properties).count() == 1000
