"""Evaluation of scores against labels: confusion, best thresholds, delays, point adjustment, ranking, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions.order import RANGE_ROWS, running
from ..functions.quantiles import quantile_values, quantiles
from ..functions.series import exceeds
from ..functions.tiles import islands, last_known, tiled
from ..session import kept


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, threshold: Column | float, by: list[str] | None = None) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1`` of ``score > threshold`` against ``label``; 0 where nothing is divided."""
    hit = exceeds(F.col("score"), threshold if isinstance(threshold, Column) else F.lit(threshold))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    out = df.groupBy(*(by or [])).agg(count(hit & (F.col("label") == 1)).alias("tp"), count(hit & (F.col("label") != 1)).alias("fp"), count(~hit & (F.col("label") == 1)).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_threshold(df: DataFrame, steps: int = 100) -> DataFrame:
    """The first of ``steps`` thresholds between the least and greatest score with the highest F1: one row.

    Each score is put into the cell of the grid that it reaches, so the table is read once and only ``steps`` rows are
    summed up from the top; the thresholds are not joined to the rows.
    """
    span = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    lo, hi = span["lo"], span["hi"]
    if lo is None or lo == hi:
        return confusion(df, hi if hi is not None else 0.0).withColumn("threshold", F.lit(hi).cast("double"))
    width = (hi - lo) / (steps - 1)
    at = lambda k: F.lit(lo) + k * F.lit(width)
    guess = F.floor((F.col("score") - lo) / width)
    # the number of thresholds below the score, exact at the edges of cells
    below = F.when(at(guess + 1) < F.col("score"), guess + 2).when(at(guess) < F.col("score"), guess + 1).otherwise(guess)
    cells = df.groupBy(F.least(F.greatest(below, F.lit(0)), F.lit(steps)).alias("below")).agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    grid = df.sparkSession.range(steps).select(F.col("id").alias("k"))
    # rows above threshold k are those with more than k thresholds below
    both = grid.select("k", F.lit(0).alias("pos"), F.lit(0).alias("n")).unionByName(cells.select((F.col("below") - 1).alias("k"), "pos", "n"))
    up = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = both.groupBy("k").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = summed.select("k", F.sum("pos").over(up).alias("tp"), F.sum("n").over(up).alias("hits"), F.sum("pos").over(everything).alias("all")).where("k >= 0 and k < " + str(steps))
    p, r = ratio(F.col("tp"), F.col("hits")), ratio(F.col("tp"), F.col("all"))
    out = out.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.orderBy(F.col("f1").desc(), "k").limit(1).select(
        F.col("tp").cast("long").alias("tp"), (F.col("hits") - F.col("tp")).cast("long").alias("fp"), (F.col("all") - F.col("tp")).cast("long").alias("fn"),
        "precision", "recall", "f1", (F.lit(lo) + F.col("k") * F.lit(width)).alias("threshold"),
    )


def detection_delay(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows between the first label and the first flag at or after it; null where either is missing."""
    first = df.groupBy(*by).agg(F.min(F.when(F.col("label") == 1, F.col("t"))).alias("first"))
    hit = df.join(first, by).where("flag and t >= first").groupBy(*by).agg(F.min("t").alias("hit"))
    return first.join(hit, by, "left").select(*by, (F.col("hit") - F.col("first")).alias("delay"))


def _segments(df: DataFrame, by: list[str], rows: int, **tops: Column) -> DataFrame:
    """Rows with aggregates of their labelled segment, null without a label: one row for each segment is joined, so a
    segment may go on over any number of tiles."""
    out = islands(df, F.col("label"), "__island", by, rows=rows)
    found = out.where("label = 1").groupBy(*by, "__island").agg(*[c.alias(n) for n, c in tops.items()])
    return out.join(found, [*by, "__island"], "left").drop("__island")


def point_adjusted(df: DataFrame, by: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """``adjusted``: every row of a labelled segment with a flag counts as flagged.

    Row 0 of a series is never filled in from behind: it keeps its own flag.
    """
    out = _segments(df, by, rows, __hit=F.max(F.col("flag").cast("int")) == 1)
    return out.withColumn("adjusted", F.when((F.col("label") == 1) & (F.col("t") > 0), F.col("__hit")).otherwise(F.col("flag"))).drop("__hit")


def events_of(df: DataFrame, flag: str, by: list[str], gaps: bool = False, rows: int = RANGE_ROWS) -> DataFrame:
    """Runs of flagged rows as half-open intervals ``start, stop``; with ``gaps`` rows that are not flagged are absent,
    so a gap in ``t`` ends a run."""
    out = df.select(*by, "t", (F.coalesce(F.col(flag).cast("int"), F.lit(0)) == 1).alias("__on"))
    out = islands(out.where("__on") if gaps else out, F.col("__on"), "__island", by, gaps=gaps, rows=rows)
    return out.where("__on").groupBy(*by, "__island").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("stop")).drop("__island")


def _f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def best_f1(df: DataFrame) -> DataFrame:
    """The best F1 over all thresholds ``score >= s``, ties of scores taken together: one row.

    Labels are summed by distinct score first, then from the top down by ranges of scores.
    """
    by_score = df.groupBy("score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    s = running(by_score, {"tp": "pos", "hits": "n"}, -F.col("score")).join(F.broadcast(df.agg(F.sum("label").alias("all"))))
    s = s.withColumns({"precision": ratio(F.col("tp"), F.col("hits")), "recall": ratio(F.col("tp"), F.col("all"))})
    s = s.withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    return s.orderBy(F.col("f1").desc(), "score").limit(1).select(F.col("score").alias("threshold"), "precision", "recall", "f1", F.col("tp").cast("long").alias("pred_anomaly"), F.col("all").cast("long").alias("true_anomaly"))


def best_f1_adjusted(df: DataFrame, by: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """``best_f1`` after point adjustment: a labelled row counts with the highest score of its segment."""
    return best_f1(_segments(df, by, rows, __top=F.max("score")).withColumn("score", F.coalesce("__top", "score")))


def roc_auc(df: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, equal scores half: one row, from counts per score."""
    by_score = df.groupBy("score").agg(F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg"))
    s = running(by_score, {"upto": "neg"}, F.col("score"))
    return s.agg(F.try_divide(F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def accuracy(df: DataFrame, threshold: Column | float, by: list[str] | None = None) -> DataFrame:
    """``confusion`` with ``tn`` and ``accuracy``, the share of rows told right (null without rows)."""
    n = df.groupBy(*(by or [])).agg(F.count("*").alias("__n"))
    out = confusion(df, threshold, by)
    out = out.join(n, by) if by else out.join(F.broadcast(n))
    out = out.withColumn("tn", F.col("__n") - F.col("tp") - F.col("fp") - F.col("fn"))
    return out.withColumn("accuracy", F.try_divide(F.col("tp") + F.col("tn"), F.col("__n"))).drop("__n")


def macro_average(df: DataFrame, measures: list[str], by: list[str] | None = None) -> DataFrame:
    """Means of measures over entities or runs, a row each, and how many there were."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("runs"), *[F.avg(m).alias(m) for m in measures])


def percentile_threshold(initial: DataFrame, test: DataFrame, anomaly_ratio: float = 1.0, rows: int = RANGE_ROWS) -> float | None:
    """The score that ``anomaly_ratio`` percent of the scores of both tables exceed, interpolated linearly."""
    both = initial.select("score").unionByName(test.select("score"))
    return quantile_values(both, ["score"], [1 - anomaly_ratio / 100], rows=rows).get("score", [None])[0]


def affiliation(events: DataFrame, spans: DataFrame | None = None, by: tuple[str, ...] = ("series_id",), rows: int = RANGE_ROWS) -> DataFrame:
    """``series_id, precision, recall, f1`` by affiliation.

    ``events``: ``series_id, kind ('pred' | 'truth'), start, stop``; ``spans``: ``series_id, lo, hi`` (without them, from
    the first start to the last stop of a series' events).  Predictions are cut to the zones of the ground-truth events;
    the measures of each part are closed forms over its bounds and those of the event and the zone, and are summed by
    zone, then averaged by series.  Zones without a prediction have recall 0 and no precision.  Events that overlap, are a
    point (no length) or leave the span are errors, found before anything is measured; a series without a ground-truth
    event has no row.
    """
    by = list(by)
    events = kept(events.select(*by, "kind", F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop")))
    if spans is None:
        spans = value_ranges(events, by=tuple(by))
    tiles = tiled(events, [*by, "kind"], "start", before=1, rows=rows)
    ordered = tiles.own(tiles.rows.withColumn("before", F.lag("stop").over(tiles.window)))
    wrong = (F.col("stop") <= F.col("start")) | F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | (F.col("start") < F.col("lo")) | (F.col("stop") > F.col("hi"))
    if ordered.join(spans, by).where(wrong).head(1):
        raise ValueError("events overlap, have no length or leave the span of their series")
    pred, truth = (events.where(F.col("kind") == k).drop("kind") for k in ("pred", "truth"))
    zone = kept(zones(truth, spans, by, rows))
    one = [*by, "start", "stop"]
    parts = tiled(kept(in_zones(pred, zone, by, rows)), one, "part_lo", 1, 1, rows)
    w = parts.window
    lo, hi = (F.lag("part_hi").over(w) + F.col("part_lo")) / 2, (F.col("part_hi") + F.lead("part_lo").over(w)) / 2
    parts = parts.own(parts.rows.withColumns({"cell_lo": lo, "cell_hi": hi})).join(zone, one)
    parts = parts.withColumns({"cell_lo": F.coalesce("cell_lo", "zone_lo"), "cell_hi": F.coalesce("cell_hi", "zone_hi")})
    part, event, whole = ((F.col(a), F.col(b)) for a, b in (("part_lo", "part_hi"), ("start", "stop"), ("zone_lo", "zone_hi")))
    own = (F.greatest("start", "cell_lo"), F.least("stop", "cell_hi"))
    masses = parts.groupBy(*one).agg(
        (F.sum(I.precision_mass(part, event, whole)) / F.sum(part[1] - part[0])).alias("p"),
        (F.sum(F.when(own[0] < own[1], I.recall_mass(part, own, whole)).otherwise(0.0)) / F.first(event[1] - event[0])).alias("r"),
    )
    measured = truth.select(*one).join(masses, one, "left").groupBy(*by).agg(F.avg("p").alias("precision"), F.avg(F.coalesce("r", F.lit(0.0))).alias("recall"))
    f1 = F.coalesce(_f1(F.col("precision"), F.col("recall")), F.lit(0.0))
    return measured.withColumn("f1", f1).withColumn("precision", F.coalesce("precision", F.lit(float("nan"))))


def threshold_events(df: DataFrame, cuts: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """``series_id, place, start, stop``: the runs of rows above each of a series' ascending ``cuts``.

    A row needs one number, how many cuts are below its score.  Events of the places between that number and the one of
    the row before open or close at the row, so the rows made grow with these changes, not with rows times cuts.
    """
    last = df.groupBy("series_id").agg((F.max("t") + 1).alias("t"), F.lit(0).alias("level"))
    levels = df.join(cuts, "series_id").select("series_id", F.col("t").cast("long").alias("t"), F.when(F.isnan("score"), 0).otherwise(cut_count(F.col("cuts"), F.col("score"))).alias("level"))
    tiles = tiled(levels.unionByName(last.select("series_id", F.col("t").cast("long").alias("t"), "level")), ["series_id"], "t", before=1, rows=rows)
    before = F.coalesce(F.lag("level").over(tiles.window), F.lit(0))
    turns = tiles.own(tiles.rows.withColumn("before", before)).where("level <> before")
    low, high = F.least("level", "before"), F.greatest("level", "before") - 1
    turns = kept(turns.select("series_id", F.explode(F.sequence(low, high)).alias("place"), "t", (F.col("level") > F.col("before")).alias("opens")))
    pairs = tiled(turns, ["series_id", "place"], "t", before=1, rows=rows)
    ends = pairs.own(pairs.rows.withColumn("start", F.lag("t").over(pairs.window))).where("not opens")
    return ends.select("series_id", "place", "start", F.col("t").alias("stop"))


def cut_count(cuts: Column, score: Column) -> Column:
    """How many of the ascending cuts are below a score."""
    return F.size(F.filter(cuts, lambda c: c < score))


def best_affiliation_f1(df: DataFrame, steps: int = 200, lo: float = 0.001, hi: float = 0.999, rows: int = RANGE_ROWS) -> DataFrame:
    """The first threshold of a grid of quantiles of the scores with the best affiliation F1: one row for each series,
    ``series_id, threshold, precision, recall, f1``.

    ``df``: ``series_id, t, label, score``, rows without gaps in ``t``.  All thresholds go through one plan, in which
    predictions are told apart by series and place in the grid.  A threshold that no score exceeds is left out; NaN
    exceeds none.
    """
    grid = [lo + i * (hi - lo) / (steps - 1) for i in range(steps)]
    cuts = kept(quantiles(df, ["score"], grid, ["series_id"], rows).select("series_id", F.col("quantiles").alias("cuts")))
    pred = kept(threshold_events(df, cuts, rows))
    truth = events_of(df, "label", ["series_id"], rows=rows)
    used = pred.select("series_id", "place").distinct()
    events = pred.withColumn("kind", F.lit("pred")).unionByName(truth.join(used, "series_id").withColumn("kind", F.lit("truth")))
    spans = df.groupBy("series_id").agg(F.lit(0.0).alias("lo"), F.count("*").cast("double").alias("hi")).join(used, "series_id")
    got = affiliation(events, spans, ("series_id", "place"), rows)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8)
    best = got.groupBy("series_id").agg(F.min_by(F.struct("place", "precision", "recall", f1.alias("f1")), F.struct((-F.nanvl(f1, F.lit(-1.0))).alias("less"), "place")).alias("b"))
    return best.join(cuts, "series_id").select("series_id", F.get("cuts", F.col("b.place")).alias("threshold"), "b.precision", "b.recall", "b.f1")


def evaluate(initial: DataFrame, test: DataFrame, anomaly_ratio: float = 1.0, affiliated: bool = False, best: bool = True, adjusted: bool = True, rows: int = RANGE_ROWS) -> DataFrame:
    """``auc, threshold, precision, recall, f1`` of the test scores (``series_id, t, label, score``): one row.

    With ``best`` the threshold with the best F1 (point-adjusted or not, or by affiliation over a grid); else the
    percentile of all scores that ``anomaly_ratio`` percent exceed.  By affiliation a score at the threshold is a hit,
    else only one above it; measures by affiliation (and their thresholds) are means over the series.
    """
    auc = roc_auc(test)
    measures = ["threshold", "precision", "recall", "f1"]
    if best:
        if affiliated:
            got = best_affiliation_f1(test, rows=rows).agg(*[F.avg(m).alias(m) for m in measures])
        else:
            got = best_f1_adjusted(test, ["series_id"], rows) if adjusted else best_f1(test)
        return auc.join(F.broadcast(got.select(*measures)))
    cut = percentile_threshold(initial, test, anomaly_ratio, rows)
    if affiliated:
        hit = test.withColumn("hit", (F.col("score") >= cut).cast("int"))
        of = lambda flag, kind: events_of(hit, flag, ["series_id"], rows=rows).withColumn("kind", F.lit(kind))
        spans = test.groupBy("series_id").agg(F.lit(0.0).alias("lo"), F.count("*").cast("double").alias("hi"))
        got = affiliation(of("hit", "pred").unionByName(of("label", "truth")), spans, rows=rows).agg(*[F.avg(m).alias(m) for m in measures[1:]])
    else:
        flagged = test.withColumn("flag", exceeds(F.col("score"), cut))
        if adjusted:
            flagged = point_adjusted(flagged, ["series_id"], rows).withColumn("flag", F.col("adjusted"))
        got = confusion(flagged.withColumn("score", F.col("flag").cast("double")), 0.5)
    return auc.join(F.broadcast(got.select(F.lit(cut).alias("threshold"), *measures[1:])))


def zones(truth: DataFrame, spans: DataFrame, by: list[str] | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """The affiliation zone of each ground-truth event: half-way to its neighbours, outer ones to the span's ends."""
    by = by or ["series_id"]
    tiles = tiled(truth.select(*by, "start", "stop"), by, "start", 1, 1, rows)
    w = tiles.window
    near = tiles.own(tiles.rows.withColumns({"__left": (F.lag("stop").over(w) + F.col("start")) / 2, "__right": (F.col("stop") + F.lead("start").over(w)) / 2}))
    bounds = [F.coalesce(a, b).cast("double").alias(n) for n, a, b in (("zone_lo", "__left", "lo"), ("zone_hi", "__right", "hi"))]
    return near.join(spans, by).select(*by, "start", "stop", *bounds)


def in_zones(pred: DataFrame, zone: DataFrame, by: list[str] | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """Predicted events, of which no two of a series overlap, cut to the zones that they overlap.

    Zones and events of a series are sorted together by their starts.  An event meets the last zone that starts before it,
    and a zone the last event that starts before it, if that is still open; these are all pairs there are, so each zone and
    each event makes at most one row, however uneven their lengths.  What is open is carried from tile to tile.
    """
    by = by or ["series_id"]
    p = pred.select(*by, F.col("start").cast("double").alias("at"), F.lit(1).alias("kind"), F.struct(F.col("start").cast("double").alias("p0"), F.col("stop").cast("double").alias("p1")).alias("pred"))
    z = zone.select(*by, F.col("zone_lo").alias("at"), F.lit(0).alias("kind"), F.struct("start", "stop", "zone_lo", "zone_hi").alias("zone"))
    both = last_known(p.unionByName(z, allowMissingColumns=True), {"last_pred": F.col("pred"), "last_zone": F.col("zone")}, by, [F.col("at"), F.col("kind")], rows)
    pairs = both.select(*by, F.coalesce("pred", "last_pred").alias("p"), F.coalesce("zone", "last_zone").alias("z"))
    out = pairs.where("p.p1 > z.zone_lo and p.p0 < z.zone_hi")
    return out.select(*by, "z.start", "z.stop", F.greatest("p.p0", "z.zone_lo").alias("part_lo"), F.least("p.p1", "z.zone_hi").alias("part_hi"))


def value_ranges(*tables: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """``series_id, lo, hi``: the least start and greatest stop of each series' events in any of the tables.

    Where no span is given, that of all event sets of a series stands for it, so sets that are compared share one.
    """
    both = tables[0].select(*by, "start", "stop")
    for t in tables[1:]:
        both = both.unionByName(t.select(*by, "start", "stop"))
    return both.groupBy(*by).agg(F.min("start").cast("double").alias("lo"), F.max("stop").cast("double").alias("hi"))
