"""Change points, clustering and repeated passages against plain versions; clashing names in all stages."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from driftwell.llm import change_points as C, clustering as K, queries, recompression, substring_dedup as S  # noqa: E402
from driftwell.llm.stages import STAGES  # noqa: E402

# --- change points -----------------------------------------------------------------------------------------------


def plain_cost(values):
    n, s, q = len(values), sum(values), sum(v * v for v in values)
    spread = 1 + (n * q - s * s) // (n * n)
    return spread, n * math.floor(1000 * math.log(spread))


def plain_cuts(values, least=5, penalty=10_000):
    """All prefixes by (cost, segments, starts from the last backwards)."""
    n = len(values)
    if n < least:
        return [0], plain_cost(values)[1]
    best = {0: (-penalty, 0, ())}
    for end in range(least, n + 1):
        options = [
            (best[a][0] + penalty + plain_cost(values[a:end])[1], best[a][1] + 1, (a, *best[a][2])) for a in range(end - least + 1) if a in best
        ]
        if options:
            best[end] = min(options)
    return sorted(best[n][2]), best[n][0]


@pytest.mark.parametrize("scale", [1, 40_000_000_000])
def test_segments(scale):
    rng = random.Random(4)
    series = [[rng.choice((0, 1, 30, 31)) * scale if rng.random() < 0.5 else (i // 12 % 2) * 50 * scale for i in range(n)] for n in (1, 2, 4, 5, 6, 9, 10, 11, 23, 40, 40, 61)]
    series += [[7 * scale] * 20, [0] * 12, [scale, 0] * 15]
    width = max(map(len, series))
    values = np.zeros((len(series), width), object if scale > 1 else np.int64)
    for i, s in enumerate(series):
        values[i, : len(s)] = s
    out = C.best_segments(values, np.array([len(s) for s in series]))
    for i, s in enumerate(series):
        starts, cost = plain_cuts(s)
        mine = out["row"] == i
        assert out["start"][mine].tolist() == starts and set(out["best_cost"][mine]) == {cost}
        assert set(out["n_segments"][mine]) == {len(starts)} and out["segment_no"][mine].tolist() == list(range(1, len(starts) + 1))
        for a, b, spread, total in zip(starts, [*starts[1:], len(s)], out["spread"][mine], out["total"][mine], strict=True):
            assert spread == plain_cost(s[a:b])[0] and total == sum(s[a:b])


LINES = "vendor_id long, quantity int, flag string, shipped_at timestamp_ntz, days string, __day string"


def test_vendor_changes(spark):
    """Hot, short and null vendors, gaps, rows that come twice, rows without a day or quantity, clashing names."""
    rng, rows = random.Random(2), []
    for v in [*range(6), None]:
        for i in range({0: 2000, 1: 3, 2: 1}.get(v, 60)):
            day = datetime(2024, 1, 1, 13) + timedelta(days=rng.randrange({0: 40, 2: 1}.get(v, 25)) * (1 if v != 3 else 3))
            rows.append((v, None if i % 17 == 16 else rng.choice((1, 2, 60)) if day.day < 15 else 5, rng.choice(("kept", "swapped", "returned", None)), None if i % 19 == 18 else day, "x", "y"))
    rows += rows[-5:]
    got = defaultdict(list)
    for r in C.vendor_changes(spark.createDataFrame(rows, LINES).repartition(3)).collect():
        got[r.vendor_id].append(r)
    sums = defaultdict(Counter)
    for v, q, flag, at, *_ in rows:
        if flag in ("kept", "swapped") and q is not None and at is not None:
            sums[v][(at.date() - datetime(1970, 1, 1).date()).days] += q
    assert got.keys() == sums.keys()
    for v, days in sums.items():
        first = min(days)
        values = [days.get(first + i, 0) for i in range(max(days) - first + 1)]
        starts, cost = plain_cuts(values)
        mine = sorted(got[v], key=lambda r: r.segment_no)
        assert [r.first_day - first for r in mine] == starts and {r.best_cost for r in mine} == {cost}
        assert [r.total for r in mine] == [sum(values[a:b]) for a, b in zip(starts, [*starts[1:], len(values)], strict=True)]
    assert C.vendor_changes(spark.createDataFrame([], LINES)).count() == 0


def test_batches_of_any_cells(spark, monkeypatch):
    lines = spark.range(3000).select((F.col("id") % 60).alias("vendor_id"), (F.col("id") % 7).cast("int").alias("quantity"), F.lit("kept").alias("flag"), F.timestamp_seconds((F.col("id") * 7919 % 50 + 1) * 86400).alias("shipped_at"))
    whole = sorted(map(tuple, C.vendor_changes(lines).collect()))
    pieces = []
    frame = C.daily_sums(lines, ["vendor_id"], F.col("shipped_at"), F.col("quantity")).toArrow()
    monkeypatch.setattr(C, "CELLS", 100)
    for batch in frame.to_batches():
        for out in C._cut(batch, C.MIN_DAYS, C.PENALTY):
            pieces += zip(*(c.to_pylist() for c in out.columns), strict=True)
    assert sorted(pieces) == whole


# --- clustering --------------------------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(q) for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, q in kept:
            groups[near(q)[1]].append(q)
        for j, members in groups.items():
            centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    labelled = [(i, near(q)) for i, q in kept]
    inertia = Counter()
    for _, (d, j) in labelled:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, (d, j) in labelled)


VECTORS = "vec_id long, embedding array<float>, q string, cluster int"


@pytest.mark.parametrize("spread", [0.3, 0.002, 100_000.0])
def test_clusters(spark, spread):
    """Vectors that tie, repeat, are null, short, or hold null, NaN or infinity."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, spread / 4, 64)], "q", 1) for i in range(150)]
    rows += [(None, rows[3][1], "q", 1), (4, rows[4][1], "q", 1), (4, rows[5][1], "q", 1), *[(1000 + i, rows[0][1], "q", 1) for i in range(60)]]
    odd = [None, [], [0.5] * 63, [0.5] * 65, [None, *[0.5] * 63], [float("nan"), *[0.5] * 63], [*[0.5] * 63, float("-inf")]]
    rows += [(2000 + i, v, "q", 1) for i, v in enumerate(odd)]
    got = K.clustered(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert Counter(map(tuple, got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())) == plain_clusters(rows)


def test_few_vectors(spark):
    rows = [(i, [float(i)] * 64, "q", 1) for i in range(3)]
    got = K.clustered(spark.createDataFrame(rows, VECTORS))
    assert {r.distance for r in got.collect()} == {0} and got.select("cluster").distinct().count() == 3
    assert K.clustered(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(Exception, match="too large"):
        K.clustered(spark.createDataFrame([(1, [2.0**17] * 64, "q", 1)], VECTORS)).collect()


def test_near_ties_are_exact():
    """Distances that differ by one, or not at all, among numbers that float32 cannot hold."""
    rng = np.random.default_rng(1)
    q = rng.integers(-(1 << 26), 1 << 26, (200, 64))
    centroids = np.repeat(q[:4], 3, axis=0) + rng.integers(-1, 2, (12, 64))
    label, distance = K.nearest(q, centroids)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids] for x in q]
    assert label.tolist() == [x.index(min(x)) for x in exact] and distance.tolist() == [min(x) for x in exact]


# --- repeated passages -------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_passages(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    places = defaultdict(list)
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            places[tuple(w[i : i + window])].append((d, i))
    gone = [[False] * len(w) for w in words]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d][i : i + window] = [True] * window
    out = []
    for w, g in zip(words, gone, strict=True):
        kept = " ".join(x for x, y in zip(w, g, strict=True) if not y)
        out.append((len(w), sum(g), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def passage_texts():
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(300)] + ["été", "日本", "🙂", "a\x00b"]
    prose = lambda n, v=vocab: [rng.choice(v) for _ in range(n)]
    shared, line = prose(60), prose(34)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", " ".join(prose(34)), " ".join(shared[:35]), " ".join(shared[3:38])]
    for k in range(12):
        texts.append(" ".join(prose(k * 3)) + "\n" + "\t".join(shared[k % 3 : 60 - k % 4]) + "  " + " ".join(prose(50 - k)))
        texts.append(" ".join(prose(20) + line + prose(20)))  # one word too short
    texts += ["again " * 34, "again " * 35, "again " * 90, "a b " * 17, "a b " * 40, "x y z " * 30, "the end " * 17 + "the"]
    texts += [" ".join(prose(500, ["a", "b"])), " ".join(prose(3000, ["a", "b", "c"])), " ".join(prose(400))]
    near = prose(120)
    for k in range(8):
        other = list(near)
        other[10 * k + 7] = "changed"
        texts.append(" ".join(other))
    texts += [texts[-1], texts[-1], " ".join(prose(5000) + shared)]
    return texts


PASSAGES = "doc_id long, text string, key string, row string, lo string, name string"


@pytest.mark.parametrize("limit", [0, 100_000])
@pytest.mark.parametrize("ids", ["unique", "repeated", "texts"])
def test_passages(spark, monkeypatch, ids, limit):
    monkeypatch.setattr(S, "BROADCAST_ROWS", limit)
    texts = passage_texts()
    named = {"unique": lambda i: i, "repeated": lambda i: None if i % 5 == 0 else i // 2, "texts": lambda i: f"d{i}"}[ids]
    schema = PASSAGES.replace("doc_id long", "doc_id string") if ids == "texts" else PASSAGES
    rows = [(named(i), t, "k", "r", "l", "n") for i, t in enumerate(texts)]
    got = S.repeated_passages(spark.createDataFrame(rows, schema).repartition(5))
    plain = plain_passages(texts)
    assert sum(p[1] for p in plain) > 1000 and any(p[1] == 0 and p[0] > 35 for p in plain)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == Counter((named(i), *p[:3]) for i, p in enumerate(plain))
    assert all(sum(s.hi - s.lo for s in r.spans) == r.n_removed for r in got.collect())


def test_without_passages(spark):
    texts = passage_texts()
    df = spark.createDataFrame([(i, t, "k", "r", "l", "n") for i, t in enumerate(texts)], PASSAGES)
    out = S.without_passages(df)
    assert out.columns == df.columns
    plain = plain_passages(texts)
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(i, p[3] if p[1] else texts[i] or "") for i, p in enumerate(plain)]
    empty = spark.createDataFrame([], PASSAGES)
    assert S.without_passages(empty).count() == S.repeated_passages(empty).count() == 0


@pytest.mark.parametrize("window", [2, 5, 12])
def test_windows_of_other_sizes(spark, window):
    texts = passage_texts()
    got = S.repeated_passages(spark.createDataFrame([(i, t, "k", "r", "l", "n") for i, t in enumerate(texts)], PASSAGES), window=window)
    assert sorted((r.doc_id, *r[1:4]) for r in got.collect()) == [(i, *p[:3]) for i, p in enumerate(plain_passages(texts, window))]


def test_symbols_are_decided_by_their_stretch():
    """Wherever the words that decide a symbol come again, so does the symbol, at the same distance."""
    rng = np.random.default_rng(8)
    for kinds in (2, 5, 50):
        words = rng.integers(1, 1 << 63, kinds, dtype=np.uint64)[rng.integers(0, kinds, 4000)]
        words[2000:2600] = words[100:700]
        text = np.repeat([0, 1], [1900, 2100])
        s = recompressed = recompression.recompressed(words, text)
        assert s.start[0] == 0 and s.end[-1] == 4000 and (s.start[1:] == s.end[:-1]).all()
        have = set(zip(s.name.tolist(), s.start.tolist(), s.end.tolist(), strict=True))
        inside = (s.low >= 100) & (s.high <= 700)
        assert inside.sum() > 20
        for i in np.flatnonzero(inside):
            assert (int(recompressed.name[i]), int(s.start[i]) + 1900, int(s.end[i]) + 1900) in have


def test_hot_passages_send_few_rows(spark):
    """A passage in every text: rows by windows grow with slices, not with texts."""
    passage = " ".join(f"p{i}" for i in range(80))
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage + " "), F.col("id").cast("string")).alias("text")).coalesce(4)
    symbols = df.select(F.col("doc_id").alias("key"), "text").mapInArrow(S._symbols(35), S._SYMBOLS)
    assert symbols.agg(F.sum(F.size("names"))).first()[0] < 4 * 120
    got = S.repeated_passages(df)
    assert got.where("n_words = 81 and n_removed = 80").count() == 2000


def test_stages_keep_columns_of_any_name(spark):
    """Every name that a stage uses itself, a text ``n_chars`` and a null one, and a line that goes."""
    names = ["__text", "row", "chars", "key", "id", "sha", "norm_sha", "thin", "place", "__id", "__row", "__source", "copies", "n", "size", "class", "bucket", "rank", "hash", "component_id", "kept", "words_lost", "name", "low", "n_words"]
    prose = lambda i: " ".join(f"word{(i * 37 + j * j) % 91}" for j in range(30)) + f" number {i}.\nmenu entry"
    for chars in ("string", "long"):
        schema = f"doc_id long, text string, lang string, source string, n_chars {chars}, " + ", ".join(f"`{c}` string" for c in names)
        rows = [(i, prose(i), "en", "s", None if i == 1 else "7" if chars == "string" else 7, *[f"{c}{i}" for c in names]) for i in range(6)]
        docs = spark.createDataFrame(rows, schema)
        for name, stage in STAGES:
            out = stage(spark, docs, "")
            if name != STAGES[-1][0]:
                assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
                assert all(r[c] == f"{c}{r.doc_id}" for r in out.select("doc_id", *names).collect() for c in names)
            docs = out
        assert set(names) <= set(docs.columns) and docs.count() > 0 and "text" not in docs.columns


def test_new_queries_are_registered():
    assert {"op11_change_points", "op12_clustering", "op13_substring_dedup"} <= queries.QUERIES.keys() & queries.ORACLE_SQL.keys()
