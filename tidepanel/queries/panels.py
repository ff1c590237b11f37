"""Queries on expressions, feature sets, datasets and processors (D to O)."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from tidepanel.functions import expressions as E
from tidepanel.functions import registry as K
from tidepanel.operators import datasets as O
from tidepanel.operators import pit as P
from tidepanel.operators import processors as N
from tidepanel.plans import features as L
from tidepanel.queries.base import BARS, TICKS, bars, panel, rounded, scores, sql, stored, ticks
from tidepanel.sources.scratch import scratch_dir
from tidepanel.sources.tables import calendar_of
from tidepanel.streaming.ticks import read_stream, resample_stream, run_to_end

QUERIES, ORACLES = {}, {}
KEYS = "instrument datetime"


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def expressions(name: str, exprs: dict, sql_columns: dict[str, str], windows: str = "", extra: str = "", doubles: list[str] | None = None) -> None:
    """A query of expressions on the whole panel; ``sql_columns`` are their SQL over ``panel``."""
    doubles = list(exprs) if doubles is None else doubles
    others = [c for c in exprs if c not in doubles]
    body = "SELECT instrument, datetime, " + ", ".join(f'{v} AS "{k}"' for k, v in sql_columns.items()) + f" FROM {extra or 'panel'} {windows}"
    add(name, lambda spark, d: rounded(E.evaluate(stored(spark, d).rows(), exprs)), sql(body, ["instrument", "datetime", *others], doubles))


o, h, lo, c, v = (E.feature(f) for f in ("open", "high", "low", "close", "volume"))
expressions(
    "d_elementwise",
    {
        "abs_": E.abs_(c - o), "sign_": E.sign(c - o), "log_": E.log(v), "power_": E.power(c, 0.5), "add_": c + o, "sub_": c - o, "mul_": c * v, "div_": c / o, "div0": c / (c - c),
        "greater_": E.greater(c, o), "less_": E.less(c, o), "gt_": c > o, "ge_": c >= o, "lt_": c < o, "le_": c <= o, "eq_": E.eq(c, o), "ne_": E.ne(c, o),
        "and_": (c > o) & (v > 10), "or_": (c > o) | (v > 10), "not_": ~(c > o), "if_": E.if_(c > o, c, o), "isnull_": E.is_null(c), "isinf_": E.is_inf(c / (c - c)),
    },
    {
        "abs_": "abs(close - open)", "sign_": "sign(close - open)::DOUBLE", "log_": "ln(volume)", "power_": "sqrt(close)", "add_": "close + open", "sub_": "close - open", "mul_": "close * volume",
        "div_": "close / open", "div0": "CASE WHEN close > 0 THEN 'inf'::DOUBLE END", "greater_": "CASE WHEN close > open THEN close ELSE open END", "less_": "CASE WHEN close < open THEN close ELSE open END",
        "gt_": "coalesce(close > open, false)", "ge_": "coalesce(close >= open, false)", "lt_": "coalesce(close < open, false)", "le_": "coalesce(close <= open, false)", "eq_": "coalesce(close = open, false)",
        "ne_": "coalesce(close <> open, true)", "and_": "coalesce(close > open, false) AND coalesce(volume > 10, false)", "or_": "coalesce(close > open, false) OR coalesce(volume > 10, false)",
        "not_": "NOT coalesce(close > open, false)", "if_": "CASE WHEN coalesce(close > open, false) THEN close ELSE open END", "isnull_": "close IS NULL", "isinf_": "close IS NOT NULL",
    },
    doubles=["abs_", "sign_", "log_", "power_", "add_", "sub_", "mul_", "div_", "div0", "greater_", "less_", "if_"],
)

W5 = "WINDOW w AS (PARTITION BY instrument ORDER BY datetime), f AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), x AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_corr = lambda a, b, f: f"covar_samp({a}, {b}) OVER {f} / nullif(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) OVER {f} * stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END) OVER {f}, 0)"
expressions(
    "e_rolling",
    {
        "ref_": E.ref(c, 3), "ref_future": E.ref(c, -2), "ref0": E.ref(c, 0), "mean_": E.mean(c, 10), "sum_": E.sum_(v, 10), "std_": E.std(E.log(c), 10), "var_": E.var(E.log(c), 10), "skew_": E.skew(c, 10), "kurt_": E.kurt(c, 10),
        "max_": E.max_(h, 10), "min_": E.min_(lo, 10), "quantile_": E.quantile(c, 10, 0.8), "med_": E.med(c, 10), "count_": E.count(c, 10), "delta_": E.delta(c, 1), "expanding": E.mean(c, 0),
        "nested": E.mean(E.std(c, 5), 10), "share": E.mean(c > E.ref(c, 1), 10),
    },
    {
        "ref_": "lag(close, 3) OVER w", "ref_future": "lead(close, 2) OVER w", "ref0": "first_value(close) OVER x", "mean_": "avg(close) OVER f", "sum_": "sum(volume) OVER f", "std_": "stddev_samp(ln(close)) OVER f",
        "var_": "var_samp(ln(close)) OVER f", "skew_": "skewness(close) OVER f", "kurt_": "kurtosis(close) OVER f", "max_": "max(high) OVER f", "min_": "min(low) OVER f", "quantile_": "quantile_cont(close, 0.8) OVER f",
        "med_": "quantile_cont(close, 0.5) OVER f", "count_": "(count(close) OVER f)::DOUBLE", "delta_": "close - lag(close) OVER w", "expanding": "avg(close) OVER x", "nested": "avg(s5) OVER f", "share": "avg(up) OVER f",
    },
    W5,
    "(SELECT *, stddev_samp(close) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s5, coalesce(close > lag(close) OVER (PARTITION BY instrument ORDER BY datetime), false)::INT::DOUBLE AS up FROM panel)",
)
_r2 = _corr("close", "t", "f")
expressions(
    "e_positions",
    {
        "slope_": E.slope(c, 10), "rsquare_": E.rsquare(c, 10), "resi_": E.resi(c, 10) / c, "wma_": E.wma(c, 10), "mad_": E.mad(c, 10), "rank_": E.rank(c, 10), "imax": E.idx_max(E.ffill(h), 10), "imin": E.idx_min(E.ffill(lo), 10),
    },
    {
        "slope_": "regr_slope(close, t) OVER f", "rsquare_": f"CASE WHEN stddev_samp(close) OVER f > 2e-5 THEN pow({_r2}, 2) END", "resi_": "(close - (regr_slope(close, t) OVER f * t + regr_intercept(close, t) OVER f)) / close",
        "wma_": "(sum(close * slot) OVER f - (min(slot) OVER f - 1) * sum(close) OVER f) / ((count(*) OVER f) * (count(*) OVER f + 1) / 2) / nullif(count(close) OVER f, 0)",
        "mad_": "list_sum(list_transform(list_filter(list(close) OVER f, lambda z: z IS NOT NULL), lambda z: abs(z - m))) / nullif(count(close) OVER f, 0)",
        "rank_": "CASE WHEN close IS NOT NULL THEN (list_sum(list_transform(list_filter(list(close) OVER f, lambda z: z IS NOT NULL), lambda z: CASE WHEN z < close THEN 1.0 WHEN z = close THEN 0.5 ELSE 0 END)) + 0.5) / count(close) OVER f END",
        "imax": "(list_position(list(fh) OVER f, max(fh) OVER f))::DOUBLE", "imin": "(list_position(list(fl) OVER f, min(fl) OVER f))::DOUBLE",
    },
    W5,
    "(SELECT *, slot::DOUBLE AS t, avg(close) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m, last_value(high IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fh, last_value(low IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fl FROM panel)",
)
_ewm = lambda k: f"sum(close * pow({k}::DOUBLE, -slot)) OVER x / nullif(sum(CASE WHEN close IS NOT NULL THEN pow({k}::DOUBLE, -slot) END) OVER x, 0)"
expressions("e_ema", {"ema10": E.ema(c, 10), "ema_half": E.ema(c, 0.2), "cross": E.ema(c, 10) - E.ema(c, 20)}, {
    "ema10": _ewm("(9.0::DOUBLE / 11.0::DOUBLE)"), "ema_half": _ewm("0.8"), "cross": f"{_ewm('(9.0::DOUBLE / 11.0::DOUBLE)')} - {_ewm('(19.0::DOUBLE / 21.0::DOUBLE)')}"}, W5)
# E12 to E15 and E22 over all rows so far
_exp = lambda f: f"{f} OVER x"
expressions("e_expanding", {"med_": E.med(c, 0), "quantile_": E.quantile(c, 0, 0.8), "rank_": E.rank(c, 0), "mad_": E.mad(c, 0), "ema_": E.ema(v, 0)}, {
    "med_": _exp("quantile_cont(close, 0.5)"), "quantile_": _exp("quantile_cont(close, 0.8)"),
    "rank_": f"CASE WHEN close IS NOT NULL THEN (list_sum(list_transform(list_filter({_exp('list(close)')}, lambda z: z IS NOT NULL), lambda z: CASE WHEN z < close THEN 1.0 WHEN z = close THEN 0.5 ELSE 0 END)) + 0.5) / {_exp('count(close)')} END",
    "mad_": f"list_avg(list_transform(list_filter({_exp('list(close)')}, lambda z: z IS NOT NULL), lambda z: abs(z - {_exp('avg(close)')})))",
    "ema_": f"list_sum(list_transform({_exp('list(struct_pack(v := coalesce(volume, 0), s := slot))')}, lambda z: z.v * pow(1 - 2 / (1.0::DOUBLE + slot), slot - z.s))) / list_sum(list_transform({_exp('list(slot)')}, lambda z: pow(1 - 2 / (1.0::DOUBLE + slot), slot - z)))",
}, W5)

# K1: operators by name, of which some are the user's
_own = {
    "Diff": lambda x: E.sub(x, E.ref(x, 1)), "Distance": K.elementwise("Distance", lambda a, b: F.abs(a.cast("double") - b.cast("double"))),
    "Range": K.over_frame("Range", lambda x: x.max() - x.min()), "Apart": K.over_frame("Apart", lambda x, y: (x - y).abs().mean()),
}


def k1_registered(spark, d):
    K.register_all(_own)
    e = {"diff_": K.operator("Diff")(c), "distance_": K.operator("Distance")(c, K.operator("Ref")(c, 1)), "range_": K.operator("Range")(c, 5), "apart_": K.operator("Apart")(c, o, 5)}
    return rounded(E.evaluate(stored(spark, d).rows(), e))


add("k1_registered", k1_registered, sql("SELECT instrument, datetime, close - lag(close) OVER w AS diff_, abs(close - lag(close) OVER w) AS distance_, max(close) OVER f - min(close) OVER f AS range_, avg(abs(close - open)) OVER f AS apart_ FROM panel "
                                        + W5.replace("9 PRECEDING", "4 PRECEDING"), KEYS, "diff_ distance_ range_ apart_"))
expressions("f_pairs", {"corr_": E.corr(c, v, 20), "cov_": E.cov(c, v, 20)}, {
    "corr_": f"CASE WHEN stddev_samp(close) OVER f > 2e-5 AND stddev_samp(volume) OVER f > 2e-5 THEN {_corr('close', 'volume', 'f')} END", "cov_": "covar_samp(close, volume) OVER f"}, W5.replace("9 PRECEDING", "19 PRECEDING"))
expressions("g_fill", {"ffill_": E.ffill(c), "bfill_": E.bfill(c)}, {
    "ffill_": "last_value(close IGNORE NULLS) OVER x", "bfill_": "first_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"}, W5)
_KBAR = {
    "KMID": "(close - open) / open", "KLEN": "(high - low) / open", "KMID2": "(close - open) / (high - low + 1e-12)", "KUP": "(high - greatest(open, close)) / open", "KUP2": "(high - greatest(open, close)) / (high - low + 1e-12)",
    "KLOW": "(least(open, close) - low) / open", "KLOW2": "(least(open, close) - low) / (high - low + 1e-12)", "KSFT": "(2 * close - high - low) / open", "KSFT2": "(2 * close - high - low) / (high - low + 1e-12)"}
expressions("l1_kbar", L.kbar(), _KBAR)
expressions("l7_labels", L.labels(), {"LABEL0": "lead(close, 2) OVER w / lead(close, 1) OVER w - 1"}, W5)
expressions("l12_volatility", {"vol": L.realised_volatility(10)}, {"vol": "CASE WHEN y >= 0 THEN sqrt(y) END"}, "", f"(SELECT instrument, datetime, sum(r * r) OVER f / 9 - pow(sum(r) OVER f, 2) / 90 AS y FROM (SELECT instrument, datetime, ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime)) AS r FROM panel) {W5})")
_a360 = {}
for _d in range(59, -1, -1):
    for _f in ("CLOSE", "OPEN", "HIGH", "LOW", "VWAP"):
        _a360[f"{_f}{_d}"] = f"lag({_f.lower()}, {_d}) OVER w / close" if _d else f"{_f.lower()} / close"
    _a360[f"VOLUME{_d}"] = (f"lag(volume, {_d}) OVER w" if _d else "volume") + " / (volume + 1e-12)"
add("l6_alpha360", lambda spark, d: rounded(L.alpha360_frame(stored(spark, d).rows())), sql("SELECT instrument, datetime, " + ", ".join(f'{_a360[k]} AS "{k}"' for k in L.alpha360()) + f" FROM panel {W5}", ["instrument", "datetime"], list(L.alpha360())))

# The 158 columns, as one select over shared windows
_PRE = "(SELECT *, close - pc AS dc, volume - pv AS dv, abs(close / pc - 1) * volume AS wv, coalesce(close > pc, false)::INT::DOUBLE AS up, coalesce(close < pc, false)::INT::DOUBLE AS dn, ln(volume + 1) AS lv, close / pc AS rc, ln(volume / pv + 1) AS rv FROM (SELECT *, slot::DOUBLE AS t, lag(close) OVER z AS pc, lag(volume) OVER z AS pv FROM panel WINDOW z AS (PARTITION BY instrument ORDER BY datetime)))"


def _l4(d: int) -> dict[str, str]:
    f = f"f{d}"
    flat = f"stddev_samp(close) OVER {f} > 2e-5"
    pos = lambda x, best: f"CASE WHEN count({x}) OVER {f} = 0 THEN NULL WHEN count({x}) OVER {f} < count(*) OVER {f} THEN list_position(list_transform(list({x}) OVER {f}, lambda q: q IS NULL), true) ELSE list_position(list({x}) OVER {f}, {best}({x}) OVER {f}) END"
    pair = lambda a, b: f"CASE WHEN stddev_samp({a}) OVER {f} > 2e-5 AND stddev_samp({b}) OVER {f} > 2e-5 THEN {_corr(a, b, f)} END"
    part = lambda x, s: f"sum(CASE WHEN {x} IS NOT NULL THEN greatest({s}{x}, 0) END) OVER {f}"
    out = {
        "ROC": f"lag(close, {d}) OVER w / close", "MA": f"avg(close) OVER {f} / close", "STD": f"stddev_samp(close) OVER {f} / close", "BETA": f"regr_slope(close, t) OVER {f} / close",
        "RSQR": f"CASE WHEN {flat} THEN pow({_corr('close', 't', f)}, 2) END", "RESI": f"(close - (regr_slope(close, t) OVER {f} * t + regr_intercept(close, t) OVER {f})) / close", "MAX": f"max(high) OVER {f} / close", "MIN": f"min(low) OVER {f} / close",
        "QTLU": f"quantile_cont(close, 0.8) OVER {f} / close", "QTLD": f"quantile_cont(close, 0.2) OVER {f} / close",
        "RANK": f"CASE WHEN close IS NOT NULL THEN (list_sum(list_transform(list_filter(list(close) OVER {f}, lambda z: z IS NOT NULL), lambda z: CASE WHEN z < close THEN 1.0 WHEN z = close THEN 0.5 ELSE 0 END)) + 0.5) / count(close) OVER {f} END",
        "RSV": f"(close - min(low) OVER {f}) / (max(high) OVER {f} - min(low) OVER {f} + 1e-12)", "IMAX": f"({pos('high', 'max')}) / {d}.0", "IMIN": f"({pos('low', 'min')}) / {d}.0", "IMXD": f"(({pos('high', 'max')}) - ({pos('low', 'min')})) / {d}.0",
        "CORR": pair("close", "lv"), "CORD": pair("rc", "rv"), "CNTP": f"avg(up) OVER {f}", "CNTN": f"avg(dn) OVER {f}", "CNTD": f"avg(up) OVER {f} - avg(dn) OVER {f}",
        "SUMP": f"{part('dc', '')} / (sum(abs(dc)) OVER {f} + 1e-12)", "SUMN": f"{part('dc', '-')} / (sum(abs(dc)) OVER {f} + 1e-12)", "SUMD": f"({part('dc', '')} - {part('dc', '-')}) / (sum(abs(dc)) OVER {f} + 1e-12)",
        "VMA": f"avg(volume) OVER {f} / (volume + 1e-12)", "VSTD": f"stddev_samp(volume) OVER {f} / (volume + 1e-12)", "WVMA": f"stddev_samp(wv) OVER {f} / (avg(wv) OVER {f} + 1e-12)",
        "VSUMP": f"{part('dv', '')} / (sum(abs(dv)) OVER {f} + 1e-12)", "VSUMN": f"{part('dv', '-')} / (sum(abs(dv)) OVER {f} + 1e-12)", "VSUMD": f"({part('dv', '')} - {part('dv', '-')}) / (sum(abs(dv)) OVER {f} + 1e-12)",
    }
    return {f"{k}{d}": x for k, x in out.items()}


_ALL = {}
for _d in L.WINDOWS:
    _ALL |= _l4(_d)
_WS = "WINDOW w AS (PARTITION BY instrument ORDER BY datetime), " + ", ".join(f"f{d} AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)" for d in L.WINDOWS)
expressions("l4_rolling", L.rolling(), {k: _ALL[k] for k in L.rolling()}, _WS, _PRE)
_PRICE0 = {f"{f.upper()}0": f"{f} / close" for f in ("open", "high", "low", "vwap")}
expressions("l5_alpha158", L.alpha158(), {k: (_KBAR | _PRICE0 | _ALL)[k] for k in L.alpha158()}, _WS, _PRE)



def l11_trend(spark, d):
    """The sign where the means are apart by more than their last digits."""
    found = E.evaluate(stored(spark, d).rows(), {"gap": E.ema(c, 10) - E.ema(c, 20), "trend": L.trend()})
    return rounded(found.withColumn("trend", F.when(F.abs("gap") > 1e-4, F.col("trend"))), 4)


_gap = f"{_ewm('(9.0::DOUBLE / 11.0::DOUBLE)')} - {_ewm('(19.0::DOUBLE / 21.0::DOUBLE)')}"
add("l11_trend", l11_trend, sql(f"SELECT instrument, datetime, gap, CASE WHEN abs(gap) > 1e-4 THEN sign(gap)::DOUBLE END AS trend FROM (SELECT instrument, datetime, {_gap} AS gap FROM panel {W5})", KEYS, "gap trend", digits=4))

# M, O
_exprs = {"MA5": E.mean(c, 5) / c, "FWD": E.ref(c, -1) / c - 1}


def m1_features(spark, d):
    kept = stored(spark, d)
    return rounded(O.features(kept.rows(), kept.calendar(), _exprs, "1997-01-01", "1997-12-31"))


add("m1_features", m1_features, sql("SELECT * FROM (SELECT instrument, datetime, avg(close) OVER f / close AS \"MA5\", lead(close) OVER w / close - 1 AS \"FWD\" FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY datetime), f AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE datetime BETWEEN '1997-01-01' AND '1997-12-31'", KEYS, "MA5 FWD"))


def m3_nested(spark, d):
    s = scores(spark, d)
    later = s.where("score > 0").select("instrument", "datetime", F.col("volume").alias("score"), "label")
    return rounded(O.nested_load([s.select("instrument", "datetime", "score", "close"), later]))


add("m3_nested_load", m3_nested, sql("SELECT a.instrument, a.datetime, a.close, b.volume AS score, b.label FROM scores a LEFT JOIN (SELECT * FROM scores WHERE score > 0) b ON a.instrument = b.instrument AND a.datetime = b.datetime", KEYS, "close score label"))
add("m4_align", lambda s, d: rounded(O.align_to(scores(s, d).select("instrument", "datetime", "score"), bars(s, d).where("volume > 20").select("instrument", "datetime", "high"))), sql("SELECT s.instrument, s.datetime, s.score, b.high FROM scores s LEFT JOIN bars b ON s.instrument = b.instrument AND s.datetime = b.datetime AND b.volume > 20", KEYS, "score high"))
add("m6_fetch", lambda s, d: rounded(O.fetch(bars(s, d), "1998-01-01", "1998-06-30", ["Brand#11", "Brand#12", "Brand#13"])), sql("SELECT * FROM bars WHERE datetime BETWEEN '1998-01-01' AND '1998-06-30' AND instrument IN ('Brand#11', 'Brand#12', 'Brand#13')", KEYS, "open high low close vwap volume"))
add("m7_trailing", lambda s, d: rounded(O.trailing_ranges(scores(s, d).select("instrument", "datetime", "score"), 5).groupBy("as_of").agg(F.count("*").alias("n"), F.avg("score").alias("score"))), sql("SELECT d.datetime AS as_of, count(*) AS n, avg(score) AS score FROM (SELECT datetime, row_number() OVER (ORDER BY datetime) AS i FROM (SELECT DISTINCT datetime FROM scores)) d JOIN (SELECT s.*, i FROM scores s JOIN (SELECT datetime, row_number() OVER (ORDER BY datetime) AS i FROM (SELECT DISTINCT datetime FROM scores)) USING (datetime)) x ON x.i BETWEEN d.i - 4 AND d.i GROUP BY 1", "as_of n", "score"))
add("m9_split", lambda s, d: O.split_scores(scores(s, d).select("instrument", "datetime", "idx"), number=1000).select("instrument", "datetime", "part"), sql("SELECT instrument, datetime, CASE WHEN dense_rank() OVER (ORDER BY datetime) <= 1000 THEN 'left' ELSE 'right' END AS part FROM scores", KEYS + " part"))
_RANGES = {"train": ("1995-01-01", "1998-12-31"), "valid": ("1999-01-01", "1999-12-31"), "test": ("1999-07-01", "2001-12-31")}
add("o1_segments", lambda s, d: O.segments(scores(s, d).select("instrument", "datetime"), _RANGES), sql(" UNION ALL ".join(f"SELECT instrument, datetime, '{k}' AS segment FROM scores WHERE datetime BETWEEN '{a}' AND '{b}'" for k, (a, b) in _RANGES.items()), KEYS + " segment"))


def o2_samples(spark, d):
    s = O.sequence_samples(panel(spark, d), ["close", "volume"], 4)
    return rounded(s.select("instrument", "datetime", *[F.col("sample")[i]["close"].alias(f"c{i}") for i in range(4)], F.col("sample")[3]["volume"].alias("v3")))


add("o2_sequences", o2_samples, sql("SELECT instrument, datetime, lag(close, 3) OVER w AS c0, lag(close, 2) OVER w AS c1, lag(close, 1) OVER w AS c2, close AS c3, volume AS v3 FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY datetime)", KEYS, "c0 c1 c2 c3 v3"))


def o5_rows(spark, d):
    s = O.row_sequences(bars(spark, d), ["close"], 3)
    return rounded(s.select("instrument", "datetime", *[F.col("sample")[i]["close"].alias(f"c{i}") for i in range(3)]))


add("o5_row_sequences", o5_rows, sql("SELECT instrument, datetime, coalesce(lag(close, 2) OVER w, 0) AS c0, coalesce(lag(close, 1) OVER w, 0) AS c1, close AS c2 FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY datetime)", KEYS, "c0 c1 c2"))
add("o6_daily_batches", lambda s, d: O.daily_batches(scores(s, d).select("instrument", "datetime"), 5), sql("SELECT instrument, datetime FROM (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY md5(instrument || ':' || epoch_us(datetime) || ':0'), instrument) AS r FROM scores) WHERE r <= 5", KEYS))
add("o7_rolling_splits", lambda s, d: O.rolling_splits(calendar_of(bars(s, d)), (0, 499), (500, 599), (600, 699), 100, gap=2), sql("SELECT fold, segment, a + 100 * fold AS start_idx, least(CASE WHEN segment = 'test' THEN b ELSE least(b, 597) END + 100 * fold, top) AS end_idx FROM (SELECT max(idx) AS top FROM cal), (VALUES ('train', 0, 499), ('valid', 500, 599), ('test', 600, 699)) s(segment, a, b), range(0, 1000) r(fold) WHERE fold <= (top - 600) // 100", "fold segment start_idx end_idx"))

# N
_R = ("1995-01-01", "1998-12-31")
_in = f"datetime BETWEEN '{_R[0]}' AND '{_R[1]}'"
_base = lambda s, d: scores(s, d).select("instrument", "datetime", "score", "volume", "label")
add("n6_process_inf", lambda s, d: rounded(N.process_inf(scores(s, d).select("instrument", "datetime", E.ieee_div(F.col("score"), F.col("close") - F.round("close", 0)).alias("x")), ["x"]), 3), sql("SELECT instrument, datetime, CASE WHEN isinf(x) THEN avg(CASE WHEN NOT isinf(x) THEN x END) OVER (PARTITION BY datetime) ELSE x END AS x FROM (SELECT instrument, datetime, CASE WHEN close - round(close, 0) <> 0 THEN score / (close - round(close, 0)) WHEN score > 0 THEN 'inf'::DOUBLE WHEN score < 0 THEN '-inf'::DOUBLE END AS x FROM scores)", KEYS, "x", digits=3))
add("n8_min_max", lambda s, d: rounded(N.min_max_norm(_base(s, d), ["volume"], *_R)), sql(f"SELECT instrument, datetime, score, (volume - lo) / (hi - lo) AS volume, label FROM scores, (SELECT min(volume) AS lo, max(volume) AS hi FROM scores WHERE {_in})", KEYS, "score volume label"))
add("n9_zscore", lambda s, d: rounded(N.zscore_norm(_base(s, d), ["score", "volume"], *_R)), sql(f"SELECT instrument, datetime, (score - m) / sd AS score, (volume - mv) / sv AS volume, label FROM scores, (SELECT avg(score) AS m, stddev_pop(score) AS sd, avg(volume) AS mv, stddev_pop(volume) AS sv FROM scores WHERE {_in})", KEYS, "score volume label"))
add("n10_robust", lambda s, d: rounded(N.robust_norm(_base(s, d), ["volume"], *_R)), sql(f"SELECT instrument, datetime, score, greatest(-3, least(3, (volume - m) / ((mad + 1e-12) * 1.4826))) AS volume, label FROM scores, (SELECT m, median(abs(volume - m)) AS mad FROM scores, (SELECT median(volume) AS m FROM scores WHERE {_in}) WHERE {_in} GROUP BY m)", KEYS, "score volume label"))
add("n11_cs_zscore", lambda s, d: rounded(N.cs_zscore(_base(s, d), ["volume"])), sql("SELECT instrument, datetime, score, (volume - avg(volume) OVER d) / nullif(stddev_samp(volume) OVER d, 0) AS volume, label FROM scores WINDOW d AS (PARTITION BY datetime)", KEYS, "score volume label"))
add("n12_cs_robust", lambda s, d: rounded(N.cs_robust(_base(s, d), ["volume"])), sql("SELECT instrument, datetime, score, CASE WHEN x IS NOT NULL THEN greatest(-3, least(3, x)) END AS volume, label FROM (SELECT *, (volume - m) / nullif(1.4826 * median(abs(volume - m)) OVER (PARTITION BY datetime), 0) AS x FROM (SELECT *, median(volume) OVER (PARTITION BY datetime) AS m FROM scores))", KEYS, "score volume label"))
add("n13_cs_rank", lambda s, d: rounded(N.cs_rank(_base(s, d), ["volume", "label"])), sql("SELECT instrument, datetime, score, ((rank() OVER (PARTITION BY datetime ORDER BY volume) + (count(*) OVER (PARTITION BY datetime, volume) - 1) / 2.0) / count(volume) OVER (PARTITION BY datetime) - 0.5) * 3.46 AS volume, CASE WHEN label IS NOT NULL THEN ((rank() OVER (PARTITION BY datetime ORDER BY label NULLS LAST) + (count(*) OVER (PARTITION BY datetime, label) - 1) / 2.0) / count(label) OVER (PARTITION BY datetime) - 0.5) * 3.46 END AS label FROM scores", KEYS, "score volume label"))
add("n14_cs_fill", lambda s, d: rounded(N.cs_fill(_base(s, d), ["label"])), sql("SELECT instrument, datetime, score, volume, coalesce(label, avg(label) OVER (PARTITION BY datetime)) AS label FROM scores", KEYS, "score volume label"))
add("n16_high_freq_norm", lambda s, d: rounded(N.high_freq_norm(_base(s, d).drop("label"), {"volume": ["volume"], "price": ["score"]}, *_R)), sql(f"SELECT instrument, datetime, (ln(1 + volume) - mv) / sv AS volume, (score - mp) / sp AS score FROM scores, (SELECT mv, mp, stddev_pop(abs(ln(1 + volume) - mv)) AS sv, stddev_pop(abs(score - mp)) AS sp FROM scores, (SELECT avg(ln(1 + volume)) AS mv, avg(score) AS mp FROM scores WHERE {_in}) WHERE {_in} GROUP BY mv, mp)", KEYS, "score volume"))


def n18_pipeline(spark, d):
    infer, learn = N.pipeline(_base(spark, d), [lambda x: N.cs_fill(x, ["volume"])], [lambda x: N.tanh(x, ["score"]), lambda x: N.fillna(x, ["label"])], [lambda x: N.dropna(x, ["label"]), lambda x: N.cs_zscore(x, ["label"])], "independent")
    return rounded(infer.withColumn("kind", F.lit("infer")).unionByName(learn.withColumn("kind", F.lit("learn"))))


add("n18_pipeline", n18_pipeline, sql("SELECT instrument, datetime, 'infer' AS kind, tanh(score - 1) AS score, volume, coalesce(label, 0) AS label FROM scores UNION ALL SELECT instrument, datetime, 'learn', score, volume, (label - avg(label) OVER (PARTITION BY datetime)) / nullif(stddev_samp(label) OVER (PARTITION BY datetime), 0) FROM scores WHERE label IS NOT NULL", KEYS + " kind", "score volume label"))

# G, H, J, L10 on ticks and the panel
add("h1_resample", lambda s, d: rounded(P.resample(ticks(s, d), "6 HOURS", {"total": F.sum("value"), "last": F.max_by("value", F.struct("datetime", "event_id")), "mean": F.avg("value")}, ("last",))), sql(
    "SELECT g.instrument, g.datetime, total, last_value(lst IGNORE NULLS) OVER (PARTITION BY g.instrument ORDER BY g.datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last, mean FROM (SELECT instrument, unnest(generate_series(min(b), max(b), INTERVAL 6 HOURS)) AS datetime FROM t GROUP BY 1) g LEFT JOIN (SELECT instrument, b AS datetime, sum(value) AS total, last(value ORDER BY datetime, event_id) AS lst, avg(value) AS mean FROM t GROUP BY ALL) x ON x.instrument = g.instrument AND x.datetime = g.datetime",
    KEYS, "total last mean", TICKS + ", t AS (SELECT *, time_bucket(INTERVAL 6 HOURS, datetime, TIMESTAMP '1970-01-01') AS b FROM ticks)"))


def h1_stream(spark, d):
    """Buckets of the stream of ticks that are final: those that ended a day before the last tick."""
    raw = read_stream(spark, f"{d}/events.parquet").select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("datetime"), "value")
    made = resample_stream(raw, "6 HOURS", "1 DAY", {"total": F.sum("value"), "n": F.count("value")})
    return rounded(run_to_end(made, f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}").select("instrument", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "total", "n"))


add("h1_resample_stream", h1_stream, sql(
    "SELECT instrument, time_bucket(INTERVAL 6 HOURS, datetime, TIMESTAMP '1970-01-01') AS datetime, sum(value) AS total, count(value) AS n FROM ticks GROUP BY 1, 2"
    " HAVING time_bucket(INTERVAL 6 HOURS, any_value(datetime), TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS <= (SELECT max(datetime) - INTERVAL 1 DAY FROM ticks)", KEYS + " n", "total", TICKS))
add("h2_resample_ts", lambda s, d: rounded(P.resample_ts(panel(s, d), "1996-01-01", "1999-12-31", "ts_data_last", "close")), sql("SELECT instrument, last(close ORDER BY datetime) AS close FROM panel WHERE datetime BETWEEN '1996-01-01' AND '1999-12-31' AND close IS NOT NULL GROUP BY 1", "instrument", "close"))
add("e23_time_window", lambda s, d: rounded(P.time_window(ticks(s, d), 600, {"m": "mean"}).drop("value")), sql("SELECT instrument, datetime, event_id, avg(value) OVER (PARTITION BY instrument ORDER BY datetime RANGE BETWEEN INTERVAL '599.999999' SECOND PRECEDING AND CURRENT ROW) AS m FROM ticks", KEYS + " event_id", "m", TICKS))


def _spread(x):
    there = x.to_numpy()
    there = there[~np.isnan(there)]
    return there.max() - there.min() if len(there) else float("nan")


add("e23_time_function", lambda s, d: rounded(P.time_function(ticks(s, d), 600, {"m": _spread}).drop("value")), sql("SELECT instrument, datetime, event_id, max(value) OVER g - min(value) OVER g AS m FROM ticks WINDOW g AS (PARTITION BY instrument ORDER BY datetime RANGE BETWEEN INTERVAL '599.999999' SECOND PRECEDING AND CURRENT ROW)", KEYS + " event_id", "m", TICKS))
add("l10_change_rate", lambda s, d: rounded(P.change_rate(ticks(s, d).where("value > 0"), 3600, order=("event_id",)).select("instrument", "datetime", "depth", "intensity")), sql("SELECT instrument, datetime, avg(value) OVER w AS depth, count(value) OVER w AS intensity FROM ticks WHERE value > 0 WINDOW w AS (PARTITION BY instrument ORDER BY datetime RANGE BETWEEN INTERVAL '3599.999999' SECOND PRECEDING AND CURRENT ROW)", KEYS + " intensity", "depth", TICKS))
add("g2_day_last", lambda s, d: rounded(E.evaluate(ticks(s, d).groupBy("instrument", "datetime").agg(F.max("value").alias("value")), {"last": E.day_last(E.feature("value")), "cum": E.day_cumsum(E.feature("value"), "09:30", "11:29")})), sql("SELECT instrument, datetime, last_value(value) OVER (PARTITION BY instrument, datetime::DATE ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, CASE WHEN k THEN sum(CASE WHEN k THEN value END) OVER (PARTITION BY instrument, datetime::DATE ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS cum FROM (SELECT instrument, datetime, max(value) AS value, strftime(datetime, '%H:%M') BETWEEN '09:30' AND '11:29' AS k FROM ticks GROUP BY 1, 2)", KEYS, "last cum", TICKS))
add("g7_cut", lambda s, d: rounded(P.cut_ends(bars(s, d).select("instrument", "datetime", "close"), 5, 3)), sql("SELECT instrument, datetime, close FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY datetime) AS i, row_number() OVER (PARTITION BY instrument ORDER BY datetime DESC) AS j FROM bars) WHERE i > 5 AND j > 3", KEYS, "close"))
add("j1_other_instrument", lambda s, d: rounded(P.from_instrument(bars(s, d), "Brand#11", {"close": "bench"}).select("instrument", "datetime", (F.col("close") - F.col("bench")).alias("spread"))), sql("SELECT a.instrument, a.datetime, a.close - b.close AS spread FROM bars a LEFT JOIN bars b ON a.datetime = b.datetime AND b.instrument = 'Brand#11'", KEYS, "spread"))


def j2_beta(spark, d):
    p = panel(spark, d).withColumn("ret", F.col("close") / F.col("open") - 1)
    return rounded(P.rolling_beta(P.from_instrument(p, "Brand#11", {"ret": "bench"}), 60).select("instrument", "datetime", "beta", "excess"))


add("j2_beta", j2_beta, sql("SELECT instrument, datetime, covar_samp(ret, bench) OVER f / nullif(var_samp(CASE WHEN ret IS NOT NULL THEN bench END) OVER f, 0) AS beta, ret - bench AS excess FROM (SELECT a.instrument, a.datetime, a.close / a.open - 1 AS ret, b.close / b.open - 1 AS bench FROM panel a LEFT JOIN panel b ON a.datetime = b.datetime AND b.instrument = 'Brand#11') WINDOW f AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)", KEYS, "beta excess"))
