"""The registered queries over the operators, each on whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import series as S
from .functions.order import numbered
from .functions.tiles import ewma_forecasts, tiled, with_totals
from .functions.wavelets import wavelet_trend as trend_of
from .functions.text import name_list, natural_key, percent, site, tag_list, time_features
from .operators import attribution, events_eval as E, policy, reconstruction, signals, social  # noqa: F401
from .operators.detectors import DETECTORS, longest_runs, summarise
from .operators.signals import KEYS, Normaliser
from .operators.thresholds import THRESHOLDS, fuse, robust_scaled
from .plans.deployment import told
from .plans.observability import TRANSITIONS, metric_rollup, state_audit
from .plans.rollout import ROLLOUTS
from .session import workers_find_package
from .sources.datasets import outliers_clamped_in_turn
from .sources.synthetic import inject_drift, inject_regression, inject_spike

CHANNELS = ["click", "error", "purchase", "signup", "view"]
BASELINE, WINDOW = 480, 48
#: Rows of a tile in these queries: their series are short, and are dealt to many tiles all the same.
TILE = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded (and no negative zero), so that engines that add in another order agree."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return signals.hourly_counts(table(spark, sf, "events"), CHANNELS)


def staged(spark: SparkSession, sf: str, faults: bool = False) -> DataFrame:
    """The hours in a baseline (stage -1) and windows; with faults, a drift in stage 3 and a shift from stage 4 on."""
    df = signals.staged(hourly(spark, sf), BASELINE, WINDOW)
    if not faults:
        return df
    parts = [df.where("stage < 3"), inject_drift(df.where("stage = 3"), 10, 2.0, ["error"]).drop("label"), inject_regression(df.where("stage >= 4"), 8, 40.0, ["click", "error"]).drop("label")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("stage = -1"), df.where("stage >= 0")


def base_scores(df: DataFrame, norm: Normaliser) -> DataFrame:
    """Mean distance from the baseline in deviations, with each channel's."""
    z = norm.transform(df)
    return z.select(*KEYS, "t", S.mean_of([F.abs(F.col(c)) for c in CHANNELS]).alias("score"), *[F.abs(F.col(c)).alias(f"by_{c}") for c in CHANNELS])


def scored(spark: SparkSession, sf: str, faults: bool = False) -> tuple[DataFrame, DataFrame]:
    baseline, windows = split(staged(spark, sf, faults))
    norm = Normaliser.z(baseline, CHANNELS)
    return base_scores(baseline, norm), base_scores(windows, norm)


def flagged(spark: SparkSession, sf: str, threshold: str = "sigma", faults: bool = False, **params) -> DataFrame:
    baseline, windows = scored(spark, sf, faults)
    t = THRESHOLDS.create(threshold, **params).fit(baseline)
    out = windows.withColumn("threshold", t.column(KEYS))
    return out.withColumn("flag", S.exceeds(F.col("score"), F.col("threshold")))


# --- signals -----------------------------------------------------------------------------------------------------


@query
def hourly_signal(spark, sf):
    return hourly(spark, sf)


@query
def signal_long(spark, sf):
    return signals.to_long(hourly(spark, sf), CHANNELS, ("stream_id", "t")).drop("channel_ix")


@query
def znorm(spark, sf):
    baseline, windows = split(staged(spark, sf))
    return rounded(Normaliser.z(baseline, CHANNELS).transform(windows))


@query
def robust_norm(spark, sf):
    baseline, windows = split(staged(spark, sf))
    return rounded(Normaliser.robust(baseline, CHANNELS, TILE).transform(windows))


@query
def standard_scale(spark, sf):
    baseline, windows = split(staged(spark, sf))
    return rounded(signals.standard_scaled(windows, CHANNELS, baseline))


@query
def sliding_windows(spark, sf):
    rows = signals.sliding_windows(hourly(spark, sf), 24, 12)
    return rows.groupBy("stream_id", "window").agg(F.min("t").alias("first_t"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in CHANNELS])


@query
def aligned_windows(spark, sf):
    return signals.aligned_windows(hourly(spark, sf), 64, 50).groupBy("stream_id", "window_start").agg(F.count("*").alias("n"), F.sum("view").alias("view"))


def _windowed(spark, sf) -> DataFrame:
    """Windows of 64 rows, every 50, over the stages, whose 48 rows are padded; errors of a smoothed form."""
    df = staged(spark, sf)
    tiles = tiled(df, KEYS, "t", 3, 3, TILE)
    smooth = tiles.own(tiles.rows.withColumns({f"r_{c}": S.smooth(F.col(c), 1.0, tiles.window) for c in ("click", "view")}))
    return signals.padded_windows(smooth, 64, 50, tuple(KEYS)).select(*KEYS, "t", "window_start", "position", "padded", "click", "view", "r_click", "r_view")


@query
def padded_windows(spark, sf):
    return rounded(_windowed(spark, sf).groupBy(*KEYS, "window_start", "padded").agg(F.count("*").alias("n"), F.sum("position").alias("positions"), F.sum("view").alias("view")))


@query
def last_rows(spark, sf):
    return signals.last_rows(_windowed(spark, sf), 64, 16).select(*KEYS, "window_start", "position", "t", "click")


@query
def kl_contributions(spark, sf):
    out = signals.kl_contributions(_windowed(spark, sf), {"click": ("r_click", "click"), "view": ("r_view", "view")}, [*KEYS, "window_start"])
    return rounded(out.select(*KEYS, "window_start", "position", "click", "view"))


@query
def overlap_average(spark, sf):
    rows = _windowed(spark, sf).where("not padded")
    error = {f"e_{c}": (F.col(c) - F.col(f"r_{c}")) * (F.col(c) - F.col(f"r_{c}")) * (F.col("position") + 1) for c in ("click", "view")}
    return rounded(signals.overlap_average(staged(spark, sf), rows.withColumns(error), ["e_click", "e_view"], tuple(KEYS)))


@query
def spectrum(spark, sf):
    return rounded(signals.spectrum(_windowed(spark, sf), "click", 64, [*KEYS, "window_start"]), 4)


@query
def spectrum_2d(spark, sf):
    """Windows of rows and channels, transformed along both."""
    df = signals.padded_windows(staged(spark, sf), 64, 50, tuple(KEYS))
    return rounded(signals.spectrum_2d(df, CHANNELS, 64, [*KEYS, "window_start"]), 4)


@query
def wavelet_trend(spark, sf):
    return rounded(trend_of(hourly(spark, sf), ["click", "view"], ["stream_id"], tile=TILE).drop("error", "purchase", "signup"))


@query
def wavelet_trend_smoothed(spark, sf):
    """The kinds of events by minutes of the week that have any, smoothed."""
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60) % (7 * 24 * 60)
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("kind"), minute.alias("t")).agg(F.count("*").cast("double").alias("n"))
    return rounded(trend_of(rows, ["n"], ["kind"], level=3, smooth=True, window=11, tile=TILE))


@query
def outlier_clamp(spark, sf):
    return rounded(outliers_clamped_in_turn(hourly(spark, sf), "click", ["stream_id"], threshold=1.5, width=49))


@query
def affiliation_inferred(spark, sf):
    """Affiliation where no span is given: that of the events."""
    pred, truth, _ = _event_sets(spark, sf)
    return rounded(E.affiliation(pred.unionByName(truth), rows=TILE))


@query
def stream_buffer(spark, sf):
    b = signals.trailing_buffer(hourly(spark, sf), CHANNELS, 24, rows=TILE)
    return b.select("stream_id", "t", "buffer_rows", "full", *[F.aggregate(c, F.lit(0.0), lambda a, x: a + x).alias(c) for c in CHANNELS])


@query
def gaussian_smooth(spark, sf):
    tiles = tiled(staged(spark, sf).where("stage >= 0"), KEYS, "t", 3, 3, TILE)
    return rounded(tiles.own(tiles.rows.select(*KEYS, "t", *[S.smooth(F.col(c), 1.0, tiles.window).alias(c) for c in CHANNELS], "__own", "__range")))


@query
def detrended(spark, sf):
    df = with_totals(staged(spark, sf).where("stage >= 0"), KEYS, mean=F.avg("click"))
    tiles = tiled(df, KEYS, "t", 2, 2, TILE)
    return rounded(tiles.own(tiles.rows.select(*KEYS, "t", *[S.detrend(F.col("click"), n, tiles.window, F.col("mean")).alias(c) for n, c in ((5, "by_five"), (4, "by_four"), (1, "by_mean"))], "__own", "__range")))


@query
def differenced(spark, sf):
    tiles = tiled(staged(spark, sf).where("stage >= 0"), KEYS, "t", before=1, rows=TILE)
    return tiles.own(tiles.rows.select(*KEYS, "t", *[S.difference(F.col(c), tiles.window).alias(c) for c in CHANNELS], "__own", "__range"))


@query
def fault_injection(spark, sf):
    df = staged(spark, sf).where("stage >= 0")
    out = inject_regression(inject_drift(inject_spike(df, 5, 4, 4.0, ["click"]), 10, 0.5, ["error"]), 20, 0.8, ["view"])
    return rounded(out)


@query
def time_features_hourly(spark, sf):
    ev = table(spark, sf, "events")
    return rounded(ev.select("event_id", *[c.alias(n) for n, c in time_features(F.col("ts")).items()]))


@query
def train_valid(spark, sf):
    df = hourly(spark, sf).withColumn("entity", F.col("stream_id"))
    return signals.train_valid_split(df, long_series=500).select("entity", "t", "split")


@query
def gram_matrix(spark, sf):
    df = hourly(spark, sf)
    pairs = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i:]]
    sums = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("v")) for a, b in pairs])).alias("x")).select("x.*")


# --- scores, thresholds, gates -----------------------------------------------------------------------------------


@query
def ewma_scores(spark, sf):
    f = ewma_forecasts(staged(spark, sf).where("stage >= 0"), {f"f_{c}": F.col(c) for c in CHANNELS}, 0.3, KEYS, rows=TILE)
    return rounded(f.select(*KEYS, "t", S.mean_of([F.abs(F.col(c) - F.col(f"f_{c}")) for c in CHANNELS]).alias("score")))


def _detector(name: str, faults: bool = False):
    def run(spark, sf):
        baseline, windows = split(staged(spark, sf, faults))
        d = DETECTORS.create(name).fit(baseline)
        return rounded(d.score(windows).select(*KEYS, "t", "score"))

    return run


QUERIES["detector_ewma"] = _detector("ewma")
QUERIES["spatiotemporal_scores"] = _detector("spatiotemporal")
QUERIES["causal_scores"] = _detector("causal")
QUERIES["diffusion_scores"] = _detector("diffusion")
QUERIES["habituation_scores"] = _detector("habituation", True)
QUERIES["reconstruction_scores"] = _detector("reconstruction", True)


@query
def ensemble_results(spark, sf):
    baseline, windows = split(staged(spark, sf, True))
    d = DETECTORS.create("ensemble", members=["ewma", "causal"]).fit(baseline)
    out = policy.RiskAwarePolicy().evaluate(d.results(windows))
    return rounded(out.select(*KEYS, "score", "threshold", "anomaly_rate", "run", "action", *[F.element_at("attribution", F.lit(c)).alias(c) for c in CHANNELS]))


def _threshold(name: str, **params):
    def run(spark, sf):
        f = flagged(spark, sf, name, True, **params)
        return rounded(f.groupBy(*KEYS).agg(F.max("threshold").alias("threshold"), F.sum(F.col("flag").cast("int")).alias("flags")))

    return run


QUERIES["threshold_static"] = _threshold("static", value=1.5)
QUERIES["threshold_sigma"] = _threshold("sigma")
QUERIES["threshold_quantile"] = _threshold("quantile", rows=64)
QUERIES["threshold_adaptive"] = _threshold("adaptive")


@query
def window_summary(spark, sf):
    r = summarise(flagged(spark, sf, faults=True), CHANNELS)
    return rounded(r.select(*KEYS, "score", "threshold", "anomaly_rate", "is_anomaly", "run", "n_points"))


@query
def longest_run(spark, sf):
    return longest_runs(flagged(spark, sf, faults=True), rows=TILE)


@query
def gate_decisions(spark, sf):
    r = summarise(flagged(spark, sf, faults=True), CHANNELS)
    return rounded(policy.RiskAwarePolicy().evaluate(r).select(*KEYS, "score", "anomaly_rate", "run", "action"))


@query
def gate_tiers(spark, sf):
    r = summarise(flagged(spark, sf, faults=True), CHANNELS)
    out = None
    for tier in policy.TIERS:
        one = policy.RiskAwarePolicy(tier).evaluate(r).select(F.lit(tier).alias("tier"), *KEYS, "action")
        out = one if out is None else out.unionByName(one)
    return out


@query
def rollout_walk(spark, sf):
    r = summarise(flagged(spark, sf, faults=True), CHANNELS)
    return policy.first_stop(policy.RiskAwarePolicy().evaluate(r)).select(*KEYS, "action")


@query
def window_attribution(spark, sf):
    r = summarise(flagged(spark, sf, faults=True), CHANNELS)
    return rounded(attribution.ranked(r, CHANNELS, 3))


@query
def aggregate_attribution(spark, sf):
    r = summarise(flagged(spark, sf, faults=True), CHANNELS)
    return rounded(attribution.aggregate(r, CHANNELS, ["stream_id"]))


@query
def robust_zscale(spark, sf):
    _, windows = scored(spark, sf)
    return rounded(robust_scaled(windows.select(*KEYS, "t", "score"), ["score"], KEYS))


def _fused(method: str, weights=None):
    def run(spark, sf):
        _, windows = scored(spark, sf)
        two = robust_scaled(windows.select(*KEYS, "t", F.col("by_click").alias("a"), F.col("by_view").alias("b")), ["a", "b"], KEYS)
        return rounded(two.select(*KEYS, "t", fuse([F.col("a"), F.col("b")], method, weights).alias("score")))

    return run


QUERIES["fuse_mean"] = _fused("mean")
QUERIES["fuse_max"] = _fused("max")
QUERIES["fuse_weighted"] = _fused("weighted", [3.0, 1.0])


# --- evaluation --------------------------------------------------------------------------------------------------


def labelled(spark, sf) -> DataFrame:
    """Toxic labels against a score from the length of the text."""
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / F.lit(1000.0)).alias("score"))
    return table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", F.col("toxic").cast("int").alias("label"), "score")


@query
def prf_eval(spark, sf):
    return rounded(E.confusion(labelled(spark, sf), 2.0))


@query
def best_threshold(spark, sf):
    return rounded(E.best_threshold(labelled(spark, sf)))


@query
def best_f1(spark, sf):
    return rounded(E.best_f1(labelled(spark, sf)))


@query
def roc_auc(spark, sf):
    return rounded(E.roc_auc(labelled(spark, sf)))


def hourly_truth(spark, sf) -> DataFrame:
    """Hours with labels by the clock, and flags and scores from the clicks."""
    df = hourly(spark, sf)
    label = ((F.col("t") % 24 >= 20) | (F.col("t") % 24 < 2)).cast("int")
    return df.select("stream_id", "t", label.alias("label"), F.col("click").alias("score"), ((F.col("click") * 7 + F.col("t")) % 5 == 0).alias("flag"))


@query
def point_adjust(spark, sf):
    return E.point_adjusted(hourly_truth(spark, sf), ["stream_id"], TILE).select("stream_id", "t", "adjusted")


@query
def best_f1_adjusted(spark, sf):
    return rounded(E.best_f1_adjusted(hourly_truth(spark, sf), ["stream_id"], TILE))


@query
def events_from_vector(spark, sf):
    return E.events_of(hourly_truth(spark, sf), "label", ["stream_id"], rows=TILE)


@query
def detection_delay(spark, sf):
    return E.detection_delay(hourly_truth(spark, sf).withColumn("day", F.floor(F.col("t") / 24)), ["stream_id", "day"])


def _event_sets(spark, sf):
    df = hourly_truth(spark, sf)
    named = lambda flag, kind: E.events_of(df, flag, ["stream_id"]).select(F.col("stream_id").alias("series_id"), F.lit(kind).alias("kind"), F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"))
    spans = df.groupBy(F.col("stream_id").alias("series_id")).agg(F.lit(0.0).alias("lo"), (F.max("t") + 1).cast("double").alias("hi"))
    return named("flag", "pred"), named("label", "truth"), spans


@query
def affiliation_zones(spark, sf):
    _, truth, spans = _event_sets(spark, sf)
    return E.zones(truth, spans)


@query
def affiliation_parts(spark, sf):
    pred, truth, spans = _event_sets(spark, sf)
    return E.in_zones(pred, E.zones(truth, spans))


@query
def eval_accuracy(spark, sf):
    return rounded(E.accuracy(labelled(spark, sf), 2.0))


@query
def macro_average(spark, sf):
    """Means over days of the hourly flags' measures."""
    days = hourly_truth(spark, sf).withColumns({"day": F.floor(F.col("t") / 24), "score": F.col("flag").cast("double")})
    return rounded(E.macro_average(E.confusion(days, 0.5, ["day"]), ["precision", "recall", "f1"]))


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The hours with labels, the first 480 as initial scores, the others as test."""
    df = hourly_truth(spark, sf).select(F.col("stream_id").alias("series_id"), "t", "label", F.col("score").cast("double").alias("score"))
    return df.where(F.col("t") < BASELINE), df.where(F.col("t") >= BASELINE).withColumn("t", F.col("t") - BASELINE)


@query
def evaluate_percentile(spark, sf):
    return rounded(E.evaluate(*_halves(spark, sf), anomaly_ratio=20.0, best=False, rows=TILE))


@query
def evaluate_best(spark, sf):
    return rounded(E.evaluate(*_halves(spark, sf)))


@query
def evaluate_affiliated(spark, sf):
    return rounded(E.evaluate(*_halves(spark, sf), anomaly_ratio=20.0, best=False, affiliated=True))


@query
def best_affiliation(spark, sf):
    return rounded(E.best_affiliation_f1(_halves(spark, sf)[1], steps=200, rows=TILE))


@query
def affiliation_pr(spark, sf):
    pred, truth, spans = _event_sets(spark, sf)
    return rounded(E.affiliation(pred.unionByName(truth), spans))


# --- observability -----------------------------------------------------------------------------------------------


@query
def metrics_rollup(spark, sf):
    ev = table(spark, sf, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "counter").when(F.col("event_type") == "error", "gauge").otherwise("series")
    return rounded(metric_rollup(ev.select(F.col("event_type").alias("name"), kind.alias("kind"), F.col("event_id").alias("seq"), "value")))


@query
def state_audit_roles(spark, sf):
    """Turns after an answer, where a conversation should end with its first."""
    allowed = {"system": {"user"}, "user": {"assistant"}}
    log = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return state_audit(log, ["conv_id"], "turn", "role", allowed)


@query
def deployment_events(spark, sf):
    """Kinds of the events of a canary rollout over the windows, with the states, in their order."""
    decided = policy.RiskAwarePolicy().evaluate(summarise(flagged(spark, sf, faults=True), CHANNELS))
    rows = told(decided, ROLLOUTS.create("canary").stages(), "baseline-safe")
    events = rows.select("stage", "stage_name", F.posexplode("events").alias("place", "e"))
    return events.select("stage", "stage_name", "place", "e.kind", F.get_json_object("e.payload", "$.state").alias("state"))


@query
def state_transitions(spark, sf):
    """The states that the rollout goes through, with the state before, and whether it may follow."""
    rows = deployment_events(spark, sf).where("state is not null")
    log = rows.select(F.lit("events").alias("stream_id"), (F.col("stage") * 100 + F.col("place")).cast("long").alias("seq"), "state")
    wrong = state_audit(log, ["stream_id"], "seq", "state", TRANSITIONS).select("seq", F.lit(False).alias("may"))
    before = F.lag("state").over(Window.partitionBy("stream_id").orderBy("seq"))
    return log.withColumn("before", before).join(wrong, "seq", "left").select("seq", "before", "state", F.coalesce("may", F.lit(True)).alias("may"))


# --- social ------------------------------------------------------------------------------------------------------


ME = "u1@example.org"
#: One board in so many has pins that are liked or commented on, one in so many is watched.
PIN_SHARE, BOARD_SHARE = 37, 4


def board_tables(spark: SparkSession, sf: str) -> social.Tables:
    """The ten tables of the pin-board application, made from the driver's tables."""
    customer, orders, lineitem, part, nation, events = (table(spark, sf, n) for n in ("customer", "orders", "lineitem", "part", "nation", "events"))
    mail = lambda key: F.concat(F.lit("u"), key.cast("string"), F.lit("@example.org"))
    users = customer.select(F.col("c_custkey").alias("userID"), mail(F.col("c_custkey")).alias("email"), F.lit("-").alias("pin"), F.col("c_name").alias("name"))
    updated = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    board = orders.select(F.col("o_orderkey").alias("corkBoardID"), mail(F.col("o_custkey")).alias("email"), F.col("o_orderpriority").alias("cat_name"), F.concat(F.lit("Board "), F.col("o_orderkey").cast("string")).alias("title"), updated.alias("last_update"))
    private = orders.where("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("corkBoardID"), updated.alias("last_update"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("password"))
    pin_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    url = F.concat(F.when(F.col("l_partkey") % 3 == 0, "http://").otherwise("https://"), F.lit("site"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".example/img/"), F.col("l_partkey").cast("string"))
    pins = lineitem.select(pin_id.alias("pushPinID"), F.col("l_orderkey").alias("corkBoardID"), url.alias("image_URL"), F.concat(F.lit("Pin by "), F.col("l_returnflag"), F.col("l_linestatus")).alias("description"), F.col("l_shipdate").alias("pinned_time"))
    tags = lineitem.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(pin_id.alias("tagID"), pin_id.alias("pushPinID"), F.col("p_brand").alias("tag"))
    a, b = F.col("event_id"), F.col("user_id")
    n, many = F.lit(customer.count()), orders.count()  # all users take part, and boards and pins that grow with the table
    liked = (a % max(1, many // PIN_SHARE) + 1) * 10 + 1
    user = mail(b % n).alias("email")
    follow = events.where("event_type = 'signup'").select(a.alias("followID"), user, mail((b * 7 + a) % n).alias("owner_email")).groupBy("email", "owner_email").agg(F.min("followID").alias("followID"))
    likes = events.where("event_type = 'click'").select(a.alias("LikesID"), user, liked.alias("pushPinID"))
    watch = events.where("event_type = 'purchase'").select(a.alias("WatchID"), user, (a % max(1, many // BOARD_SHARE) + 1).alias("corkBoardID"))
    comment = events.where("event_type = 'error'").select(a.alias("commentID"), user, F.col("ts").alias("added_time"), F.col("props").alias("content"), liked.alias("pushPinID"))
    category = orders.select(F.col("o_orderpriority").alias("cat_name")).distinct()
    return {"user": users, "corkboard": board, "privatecorkboard": private, "pushpin": pins, "tag": tags, "follow": follow, "likes": likes, "watch": watch, "comment": comment, "category": category, "nation": nation}




@query
def popular_tags(spark, sf):
    return social.popular_tags(board_tables(spark, sf))


@query
def popular_sites(spark, sf):
    return social.popular_sites(board_tables(spark, sf))


@query
def page_sites(spark, sf):
    return table(spark, sf, "pages").groupBy(site(F.col("url")).alias("site")).agg(F.count("page_id").alias("pages")).orderBy(F.desc("pages"), "site").limit(4)


@query
def board_stats(spark, sf):
    return social.board_stats(board_tables(spark, sf))


@query
def my_boards(spark, sf):
    return social.my_boards(board_tables(spark, sf), ME)


@query
def recent_feed(spark, sf):
    return social.recent_feed(board_tables(spark, sf), ME)


@query
def search(spark, sf):
    return social.search(board_tables(spark, sf), "brand#1")


@query
def search_category(spark, sf):
    return social.search(board_tables(spark, sf), "urgent").groupBy("description").agg(F.count("*").alias("n"))


@query
def pin_likers(spark, sf):
    return social.pin_likers(board_tables(spark, sf), 11)


@query
def pin_comments(spark, sf):
    return social.pin_comments(board_tables(spark, sf), 21)


@query
def board_page(spark, sf):
    return social.board_page(board_tables(spark, sf), 5, ME)


@query
def pin_page(spark, sf):
    return social.pin_page(board_tables(spark, sf), 71, ME)


@query
def comment_insert(spark, sf):
    """Comments on pins that are liked, numbered on from the last."""
    t = board_tables(spark, sf)
    new = t["likes"].where("LikesID % 50 = 0").select("email", "pushPinID", F.lit(None).cast(dict(t["comment"].dtypes)["added_time"]).alias("added_time"), F.concat(F.lit("like "), F.col("LikesID").cast("string")).alias("content"))
    return social.insert(t["comment"], new, "commentID", ["content"]).where("content like 'like %'").select("commentID", "email", "content", "pushPinID")


@query
def private_anti_join(spark, sf):
    return social.public_boards(board_tables(spark, sf)).select("corkBoardID", "title")


@query
def likes_toggle(spark, sf):
    t = board_tables(spark, sf)
    changes = t["watch"].select("email", ((F.col("WatchID") % 40 + 1) * 10 + 1).alias("pushPinID")).unionByName(t["likes"].where("LikesID % 3 = 0").select("email", "pushPinID"))
    return social.toggle(t["likes"], changes, ["email", "pushPinID"], "LikesID").select("LikesID", "email", "pushPinID")


@query
def follow_if_absent(spark, sf):
    t = board_tables(spark, sf)
    new = t["watch"].select("email", F.concat(F.lit("u"), (F.col("corkBoardID") % 150).cast("string"), F.lit("@example.org")).alias("owner_email"))
    return social.insert_absent(t["follow"], new, ["email", "owner_email"], "followID").select("followID", "email", "owner_email")


@query
def touch_boards(spark, sf):
    t = board_tables(spark, sf)
    at = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    out = social.touch_boards(t["corkboard"], t["watch"].select("corkBoardID"), at)
    return out.select("corkBoardID", F.coalesce(F.col("last_update") == at, F.lit(False)).alias("touched"))


@query
def register_check(spark, sf):
    t = board_tables(spark, sf)
    new = table(spark, sf, "supplier").select(F.concat(F.lit("u"), (F.col("s_suppkey") * 20).cast("string"), F.lit("@example.org")).alias("email"), F.col("s_name").alias("name"))
    return social.register_check(t, new)


@query
def tag_explode(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.explode(tag_list(F.col("text"))).alias("tag"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("tags"), F.min("tag").alias("first"))


@query
def names_by_region(spark, sf):
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return n.select("region", name_list(F.col("names")).alias("names"))


@query
def natural_order(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("machine-"), (F.col("s_suppkey") % 13).cast("string"), F.lit("-"), F.col("s_suppkey").cast("string")).alias("file"))
    return numbered(s, "place", natural_key(F.col("file")))


@query
def percent_format(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(percent(F.avg((F.col("l_linestatus") == "F").cast("double"))).alias("share"))


@query
def union_entities(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    b = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b).groupBy("nation").agg(F.count("*").alias("n"))
