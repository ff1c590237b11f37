"""Queries on preparation, quality, refreshing and point-in-time values (I, T, U, V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import expressions as E
from tidepanel.operators import pit as P
from tidepanel.operators import prepare as T
from tidepanel.queries.base import BARS, bars, panel, rounded, scores, sql
from tidepanel.queries.tables import PIT, pit
from tidepanel.sources.tables import calendar_of

QUERIES, ORACLES = {}, {}
KEYS = "instrument datetime"
P_CTES = BARS + "," + PIT


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def days(s, d):
    return bars(s, d).select("instrument", F.col("datetime").cast("timestamp").alias("datetime"))


_known = "SELECT b.instrument, b.datetime, max(row(p.period, p.publish_date, p.load_seq, p.value)) AS m FROM bars b JOIN pit p ON p.instrument = b.instrument AND p.publish_date <= b.datetime GROUP BY 1, 2"
add("i1_known_value", lambda s, d: rounded(P.known_values(pit(s, d), days(s, d)).select("instrument", F.date_format("datetime", "yyyy-MM-dd").alias("day"), "period", "value")), sql("SELECT b.instrument, strftime(b.datetime, '%Y-%m-%d') AS day, arg_max(p.period, p.period * 1e7 + (p.publish_date - DATE '1990-01-01') * 10 + load_seq) AS period, arg_max(p.value, p.period * 1e7 + (p.publish_date - DATE '1990-01-01') * 10 + load_seq) AS value FROM bars b LEFT JOIN pit p ON p.instrument = b.instrument AND p.publish_date <= b.datetime GROUP BY 1, 2", "instrument day period", "value", P_CTES))
add("i2_named_period", lambda s, d: rounded(P.period_value(pit(s, d), days(s, d), 199703).select("instrument", F.date_format("datetime", "yyyy-MM-dd").alias("day"), "value")), sql("SELECT b.instrument, strftime(b.datetime, '%Y-%m-%d') AS day, arg_max(p.value, (p.publish_date - DATE '1990-01-01') * 10 + load_seq) AS value FROM bars b LEFT JOIN pit p ON p.instrument = b.instrument AND p.publish_date <= b.datetime AND p.period = 199703 GROUP BY 1, 2", "instrument day", "value", P_CTES))
add("i3_period_mean", lambda s, d: rounded(P.period_window(pit(s, d), days(s, d), 4, lambda v, back: F.avg(v)).select("instrument", F.date_format("datetime", "yyyy-MM-dd").alias("day"), "value")), sql(
    "SELECT instrument, day, CASE WHEN count(top) > 0 THEN avg(value) END AS value FROM (SELECT k.instrument, k.day, k.top, p.period, arg_max(p.value, (p.publish_date - DATE '1990-01-01') * 10 + load_seq) AS value FROM (SELECT b.instrument, b.datetime, strftime(b.datetime, '%Y-%m-%d') AS day, max(p.period) AS top FROM bars b LEFT JOIN pit p ON p.instrument = b.instrument AND p.publish_date <= b.datetime GROUP BY 1, 2, 3) k LEFT JOIN pit p ON p.instrument = k.instrument AND p.publish_date <= k.datetime AND (p.period // 100) * 4 + p.period % 100 > (k.top // 100) * 4 + k.top % 100 - 4 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2", "instrument day", "value", P_CTES))


# T
def raw(s, d):
    """Bars with repeated keys, zero volumes and an adjusted close (X11)."""
    b = bars(s, d).withColumn("volume", F.when(F.col("volume") > 45, 0.0).otherwise(F.col("volume")))
    return b.drop("vwap").withColumn("adjclose", F.col("close") * (1 + F.year("datetime") % 3))


RAW = BARS + ", raw AS (SELECT instrument, datetime, open, high, low, close, CASE WHEN volume > 45 THEN 0 ELSE volume END AS volume, close * (1 + year(datetime) % 3) AS adjclose FROM bars)"
_np = "np AS (SELECT p.instrument, p.datetime, CASE WHEN r.volume > 0 THEN r.open END AS open, CASE WHEN r.volume > 0 THEN r.high END AS high, CASE WHEN r.volume > 0 THEN r.low END AS low, CASE WHEN r.volume > 0 THEN r.close END AS close, CASE WHEN r.volume > 0 THEN r.volume END AS volume, r.adjclose FROM panel p LEFT JOIN raw r ON r.instrument = p.instrument AND r.datetime = p.datetime)"
norm = lambda s, d: T.normalize_daily(raw(s, d).union(raw(s, d)), calendar_of(bars(s, d))).drop("idx")
_B = "PARTITION BY instrument ORDER BY datetime"
_UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
add("t1_normalize_daily", lambda s, d: rounded(norm(s, d)), sql("SELECT * FROM np", KEYS, "open high low close volume adjclose", RAW + "," + _np))
add("t2_change", lambda s, d: rounded(T.calc_change(norm(s, d)).select("instrument", "datetime", "change")), sql(f"SELECT instrument, datetime, f / lag(f) OVER ({_B}) - 1 AS change FROM (SELECT *, last_value(close IGNORE NULLS) OVER ({_B} {_UP}) AS f FROM np)", KEYS, "change", RAW + "," + _np))
# T3 on runs of days whose prices are 100 times too high, each of which takes a round
_P5 = ("open", "high", "low", "close", "adjclose")


def t3_repair(spark, d):
    off = F.dayofyear("datetime").between(100, 106)
    rows = norm(spark, d).select("instrument", "datetime", "volume", *[F.when(off, F.col(c) * 100).otherwise(F.col(c)).alias(c) for c in _P5])
    return rounded(T.repair_units(rows, 10), 4)


_mended = ", ".join(f"CASE WHEN change BETWEEN 89 AND 111 THEN {c} / 100 ELSE {c} END AS {c}" for c in _P5)
add("t3_repair_units", t3_repair, sql(
    f"SELECT instrument, datetime, volume, {', '.join(_P5)} FROM st WHERE r = 10", KEYS, ["volume", *_P5],
    "RECURSIVE " + RAW.lstrip() + "," + _np + ", off AS MATERIALIZED (SELECT instrument, datetime, volume, " + ", ".join(f"CASE WHEN dayofyear(datetime) BETWEEN 100 AND 106 THEN {c} * 100 ELSE {c} END AS {c}" for c in _P5)
    + f" FROM np), st AS (SELECT 0 AS r, * FROM off UNION ALL SELECT r + 1, instrument, datetime, volume, {_mended} FROM (SELECT *, f / lag(f) OVER ({_B}) - 1 AS change FROM (SELECT *, last_value(close IGNORE NULLS) OVER ({_B} {_UP}) AS f FROM st)) WHERE r < 10)", 4))
add("t4_adjust", lambda s, d: rounded(T.adjust(norm(s, d)).select("instrument", "datetime", "close", "volume", "factor")), sql(f"SELECT instrument, datetime, close * f AS close, volume / f AS volume, f AS factor FROM (SELECT *, last_value(adjclose / close IGNORE NULLS) OVER ({_B} {_UP}) AS f FROM np)", KEYS, "close volume factor", RAW + "," + _np))
add("t5_rebase", lambda s, d: rounded(T.rebase(norm(s, d)).select("instrument", "datetime", "close", "volume")), sql(f"SELECT instrument, datetime, close / f AS close, volume * f AS volume FROM (SELECT *, first_value(close IGNORE NULLS) OVER ({_B} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM np)", KEYS, "close volume", RAW + "," + _np))
add("t6_splice", lambda s, d: rounded(T.splice(bars(s, d).where("datetime < '1999-01-01'").withColumn("close", F.col("close") * 2), bars(s, d).where("datetime >= '1998-06-01'")).select("instrument", "datetime", "close", "volume")), sql("SELECT b.instrument, b.datetime, b.close * k AS close, b.volume / k AS volume FROM bars b JOIN (SELECT instrument, 2.0::DOUBLE AS k, max(datetime) AS m FROM bars WHERE datetime < '1999-01-01' GROUP BY 1) USING (instrument) WHERE b.datetime > m", KEYS, "close volume"))
add("t8_paused", lambda s, d: T.paused_counter(norm(s, d)).select("instrument", "datetime", "paused_num"), sql(f"SELECT instrument, datetime, (sum(live) OVER (PARTITION BY instrument, g ORDER BY datetime {_UP}))::BIGINT AS paused_num FROM (SELECT *, sum(1 - live) OVER ({_B} {_UP}) AS g, min(CASE WHEN live = 1 THEN datetime END) OVER (PARTITION BY instrument) AS a, max(CASE WHEN live = 1 THEN datetime END) OVER (PARTITION BY instrument) AS b FROM (SELECT *, coalesce(volume > 0, false)::INT AS live FROM np)) QUALIFY datetime BETWEEN a AND b", KEYS + " paused_num", ctes=RAW + "," + _np))
add("t9_missing_symbols", lambda s, d: T.missing_symbols(bars(s, d), bars(s, d).where("instrument <> 'Brand#11'"), calendar_of(bars(s, d))).select("instrument", "datetime", "paused_num"), sql("SELECT 'Brand#11' AS instrument, datetime, 0 AS paused_num FROM cal", KEYS + " paused_num"))
add("t11_pit_dates", lambda s, d: T.normalize_pit(bars(s, d).select("instrument", F.to_date("datetime").alias("period_end"), F.when(F.col("volume") > 30, F.to_date("datetime")).alias("publish_date"))).select("instrument", "period_end", "publish_date", "period"), sql("SELECT instrument, datetime::DATE AS period_end, CASE WHEN volume > 30 THEN datetime::DATE ELSE (datetime::DATE + 45)::DATE END AS publish_date, (year(datetime) * 100 + quarter(datetime))::INT AS period FROM bars", "instrument period_end publish_date period"))

# U
add("u1_missing", lambda s, d: T.missing_report(panel(s, d), ("open", "close", "volume"), 900), sql("SELECT * FROM (SELECT instrument, count(*) - count(open) AS open, count(*) - count(close) AS close, count(*) - count(volume) AS volume FROM panel GROUP BY 1) WHERE open > 900 OR close > 900 OR volume > 900", "instrument open close volume"))
add("u2_steps", lambda s, d: rounded(T.step_report(bars(s, d), {"close": 0.5, "volume": 3.0})), sql(f"SELECT instrument, field, min(datetime) AS first_date, max(step) AS largest FROM (SELECT instrument, datetime, 'close' AS field, abs(close / lag(close) OVER ({_B}) - 1) AS step, 0.5 AS l FROM bars UNION ALL SELECT instrument, datetime, 'volume', abs(volume / lag(volume) OVER ({_B}) - 1), 3.0 FROM bars) WHERE step > l GROUP BY 1, 2", "instrument field first_date", "largest"))
add("u4_missing_factor", lambda s, d: T.missing_factor(bars(s, d).withColumn("factor", F.when(~F.col("instrument").like("Brand#2%"), F.lit(1.0))), ("Brand#21",)), sql("SELECT DISTINCT instrument FROM bars WHERE instrument LIKE 'Brand#2%' AND instrument <> 'Brand#21'", "instrument"))
add("u5_distinct", lambda s, d: rounded(T.distinct_per_day(panel(s, d), "volume")), sql("SELECT datetime, count(DISTINCT volume) + max((volume IS NULL)::INT) AS n, (count(DISTINCT volume) + max((volume IS NULL)::INT)) / count(*) AS ratio FROM panel GROUP BY 1", "datetime n", "ratio"))
add("u6_histogram", lambda s, d: T.histogram(bars(s, d), "volume", 20), sql("SELECT least(floor((volume - lo) / (hi - lo) * 20) + 1, 20)::BIGINT AS bin, count(*) AS n FROM bars, (SELECT min(volume) AS lo, max(volume) AS hi FROM bars) GROUP BY 1", "bin n"))
_dev = "stddev_pop(close)"
add("u7_day_counts", lambda s, d: rounded(T.day_counts(panel(s, d).withColumn("close", F.ln("close")), "close")), sql(f"SELECT datetime, 0::BIGINT AS inf, count(*) - count(close) AS missing, 1 - count(close) / count(*) AS missing_ratio, avg(close) AS mean, stddev_samp(close) AS std, CASE WHEN count(close) >= 3 THEN CASE WHEN {_dev} = 0 THEN 0 ELSE skewness(close) END END AS skew, CASE WHEN count(close) >= 4 THEN CASE WHEN {_dev} = 0 THEN 0 ELSE kurtosis(close) END END AS kurt FROM (SELECT datetime, ln(close) AS close FROM panel) GROUP BY 1", "datetime inf missing", "missing_ratio mean std skew kurt"))
_ac = lambda c: f"SELECT '{c}' AS feature, a.datetime, covar_samp(a.{c}, b.{c}) / nullif(stddev_samp(CASE WHEN b.{c} IS NOT NULL THEN a.{c} END) * stddev_samp(CASE WHEN a.{c} IS NOT NULL THEN b.{c} END), 0) AS autocorr FROM x a LEFT JOIN x b ON a.instrument = b.instrument AND b.i = a.i - 1 GROUP BY 2"
_X = BARS + ", x AS (SELECT scores.*, i FROM scores JOIN (SELECT datetime, row_number() OVER (ORDER BY datetime) AS i FROM (SELECT DISTINCT datetime FROM scores)) USING (datetime))"
add("u9_autocorr", lambda s, d: rounded(T.feature_autocorr(scores(s, d), ["score", "volume"])), sql(_ac("score") + " UNION ALL " + _ac("volume"), "feature datetime", "autocorr", _X))


# V
def parts(s, d):
    x = scores(s, d).select("instrument", "datetime", "score")
    return [x.where("datetime < '1998-06-01'"), x.where("datetime >= '1998-01-01'").withColumn("score", F.col("score") + 1)]


add("v1_rolling_ensemble", lambda s, d: rounded(T.rolling_ensemble(parts(s, d))), sql("SELECT instrument, datetime, CASE WHEN datetime >= '1998-01-01' THEN score + 1 ELSE score END AS score FROM scores", KEYS, "score"))


def sources(s, d):
    x = scores(s, d).select("instrument", "datetime", "score", "volume")
    return x.select(F.lit("a").alias("source"), "instrument", "datetime", "score").union(x.where("volume > 20").select(F.lit("b"), "instrument", "datetime", "volume"))


_SRC = BARS + ", src AS (SELECT 'a' AS source, instrument, datetime, score FROM scores UNION ALL SELECT 'b', instrument, datetime, volume FROM scores WHERE volume > 20)"
add("v2_average_ensemble", lambda s, d: rounded(T.average_ensemble(sources(s, d))), sql("SELECT instrument, datetime, avg(z) AS score FROM (SELECT *, (score - avg(score) OVER w) / nullif(stddev_samp(score) OVER w, 0) AS z FROM src WINDOW w AS (PARTITION BY source, datetime)) GROUP BY 1, 2", KEYS, "score", _SRC))
add("v3_grouped_ensemble", lambda s, d: rounded(T.grouped_ensemble(sources(s, d).withColumn("model", F.when(F.col("instrument") < "Brand#2", "x").otherwise("y")))), sql("SELECT model, instrument, datetime, arg_max(score, k) AS score FROM (SELECT *, epoch(min(datetime) OVER (PARTITION BY model, source)) * 10 + CASE source WHEN 'b' THEN 1 ELSE 0 END AS k FROM (SELECT *, CASE WHEN instrument < 'Brand#2' THEN 'x' ELSE 'y' END AS model FROM src)) GROUP BY 1, 2, 3", "model instrument datetime", "score", _SRC))
add("v4_replace_range", lambda s, d: rounded(T.replace_range(*parts(s, d))), sql("SELECT instrument, datetime, CASE WHEN datetime >= '1998-01-01' THEN score + 1 ELSE score END AS score FROM scores", KEYS, "score"))


def v5(s, d):
    p, c = panel(s, d), calendar_of(bars(s, d))
    exprs = {"x": E.mean(E.feature("close"), 3), "y": E.ref(E.feature("close"), -1)}
    stored = E.evaluate(p.where("datetime <= '1999-06-30'"), exprs)
    return rounded(T.refresh(stored, p, c, exprs, "1999-06-30", "2001-12-31"))


add("v5_refresh", v5, sql(f"SELECT instrument, datetime, avg(close) OVER ({_B} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x, lead(close) OVER ({_B}) AS y FROM panel", KEYS, "x y"))
add("v6_window_start", lambda s, d: T.window_start(calendar_of(bars(s, d)), "1999-06-30", 60), sql("SELECT datetime FROM cal WHERE idx = (SELECT max(idx) - 59 FROM cal WHERE datetime <= '1999-06-30')", "datetime"))
