"""Queries on intraday sets, order books, folds, and functions of one step (A1, A10, A11, B6, B9, G5-G7, L8-L10, M10, N, O, T7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidepanel.functions import expressions as E
from tidepanel.operators import calendar as B
from tidepanel.operators import datasets as O
from tidepanel.operators import pit as P
from tidepanel.operators import prepare as T
from tidepanel.operators import processors as N
from tidepanel.plans import features as L
from tidepanel.queries.base import BARS, MARKET, TICKS, bars, market, panel, rounded, scores, sql, ticks
from tidepanel.sources.scratch import scratch_dir
from tidepanel.sources import tables as A
from tidepanel.sources.tables import calendar_of

QUERIES, ORACLES = {}, {}
KEYS = "instrument datetime"


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


# Slots of six hours, four a day, as an intraday panel; slots without ticks are paused.
def positive(spark, d):
    return ticks(spark, d).where("value > 0")


def slots(spark, d):
    order = F.struct("datetime", "event_id")
    made = P.resample(positive(spark, d), "6 HOURS", {
        "open": F.min_by("value", order), "high": F.max("value"), "low": F.min("value"), "close": F.max_by("value", order), "vwap": F.avg("value"), "volume": F.count("*").cast("double"),
    })
    return made.withColumns({"paused_num": F.when(F.col("volume").isNull(), 0.0).otherwise(2.0), "factor": F.when(F.col("volume") > 1, 1.5)})


POSITIVE = TICKS + ", pos AS MATERIALIZED (SELECT * FROM ticks WHERE value > 0)"
SLOTS = POSITIVE + """, t AS (SELECT *, time_bucket(INTERVAL 6 HOURS, datetime, TIMESTAMP '1970-01-01') AS b FROM pos),
g AS (SELECT instrument, unnest(generate_series(min(b), max(b), INTERVAL 6 HOURS)) AS datetime FROM t GROUP BY 1),
f AS (SELECT instrument, b, first(value ORDER BY t.datetime, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY t.datetime, event_id) AS close,
  avg(value) AS vwap, count(*)::DOUBLE AS volume FROM t GROUP BY 1, 2),
s AS MATERIALIZED (SELECT g.instrument, g.datetime, open, high, low, close, vwap, volume, CASE WHEN volume > 1 THEN 1.5::DOUBLE END AS factor,
  last_value(close IGNORE NULLS) OVER (PARTITION BY g.instrument ORDER BY g.datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cf
  FROM g LEFT JOIN f ON f.instrument = g.instrument AND f.b = g.datetime)"""
_W = "(PARTITION BY instrument ORDER BY datetime)"
_UP = "(PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DAY = "(PARTITION BY instrument, datetime::DATE ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_PRICES = ("open", "high", "low", "close", "vwap")
_now = ", ".join(f"coalesce({p}, cf) / base AS {p}_now, lag(coalesce({p}, cf), 4) OVER {_W} / base AS {p}_before" for p in _PRICES)
_last = lambda c: f"last_value({c} IGNORE NULLS) OVER {_UP}"
_sets = ", ".join(f'{_last(p + "_now")} AS "{p}", {_last(p + "_before")} AS "{p}_1"' for p in _PRICES)
add("l8_intraday_normalised", lambda s, d: rounded(E.select(slots(s, d), L.live(), L.intraday_normalised(4, 1, 3))), sql(
    f"""SELECT instrument, datetime, {", ".join(f'"{p}", "{p}_1"' for p in _PRICES)}, volume, volume_1 FROM (
    SELECT instrument, datetime, live, {_sets}, greatest(coalesce(v / bv, 0), 0) AS volume, greatest(coalesce(lag(v, 4) OVER {_W} / bv, 0), 0) AS volume_1 FROM (
    SELECT instrument, datetime, volume AS v, volume IS NOT NULL AS live, lag(dm, 4) OVER {_W} AS bv, {_now} FROM (
    SELECT *, last_value(r IGNORE NULLS) OVER {_DAY} AS base, last_value(mv IGNORE NULLS) OVER {_DAY} AS dm FROM (
    SELECT *, lag(cf, 5) OVER {_W} AS r, avg(volume) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS mv FROM s)))) WHERE live""",
    KEYS, [x for p in (*_PRICES, "volume") for x in (p, f"{p}_1")], SLOTS))
add("l9_intraday_execution", lambda s, d: rounded(E.select(slots(s, d), L.live(), L.intraday_execution())), sql(
    "SELECT instrument, datetime, cf AS close0, coalesce(vwap, cf) AS vwap0, coalesce(volume, 0) AS volume0, coalesce(factor, 0) AS factor0 FROM s WHERE volume IS NOT NULL", KEYS, "close0 vwap0 volume0 factor0", SLOTS))


# A book of two levels around each tick's value.
def book(spark, d):
    v, i = F.col("value"), F.col("event_id")
    size = lambda n: (1 + i % n).cast("double")
    return positive(spark, d).select(
        "instrument", "datetime", (v * 1.01).alias("ask1"), (v * 0.99).alias("bid1"), size(7).alias("asize1"), size(3).alias("bsize1"),
        (v * 1.02).alias("ask2"), (v * 0.98).alias("bid2"), size(5).alias("asize2"), size(11).alias("bsize2"),
    )


_BOOK = POSITIVE + """, bk AS MATERIALIZED (SELECT instrument, datetime, value * 1.01::DOUBLE AS ask1, value * 0.99::DOUBLE AS bid1, (1 + event_id % 7)::DOUBLE AS asize1, (1 + event_id % 3)::DOUBLE AS bsize1,
  value * 1.02::DOUBLE AS ask2, value * 0.98::DOUBLE AS bid2, (1 + event_id % 5)::DOUBLE AS asize2, (1 + event_id % 11)::DOUBLE AS bsize2,
  time_bucket(INTERVAL 6 HOURS, datetime, TIMESTAMP '1970-01-01') AS b, time_bucket(INTERVAL 1 HOURS, datetime, TIMESTAMP '1970-01-01') AS h FROM pos)"""
_BY = "ORDER BY datetime, ask1, bid1, asize1, bsize1, ask2, bid2, asize2, bsize2"
_P2, _S2 = ("ask1", "bid1", "ask2", "bid2"), ("asize1", "bsize1", "asize2", "bsize2")
_book_last = ", ".join(f"last({c} {_BY}) AS {c}" for c in _P2)
_book_mean = ", ".join(f"avg({c}) AS m{c}" for c in _S2)
_steps = ", ".join([f"last({c} {_BY}) AS {c}" for c in _P2] + [f"avg({c}) AS {c}" for c in _S2])
_moves = ", ".join(f"2 * ({c} - lag({c}) OVER (PARTITION BY instrument ORDER BY h)) / 3600 AS {c}" for c in (*_P2, *_S2))
_book_out = {f"v_{c[:5]}_{c[5]}": f"m{c} / sz" for c in _S2}
for _i in (1, 2):
    _book_out |= {f"p_spread_{_i}": f"2 * (ask{_i} - bid{_i}) / best", f"p_mid_{_i}": f"(ask{_i} + bid{_i}) / best"}
    _book_out |= {f"p_diff_{n}_{_i}_step": f"d{n}{_i} / best" for n in ("ask", "bid")} | {f"v_diff_{n}_{_i}_step": f"d{n}{_i} / sz" for n in ("asize", "bsize")}
for _n in ("ask", "bid"):
    _book_out |= {f"p_diff_{_n}_1_2": f"2 * abs({_n}2 - {_n}1) / best", f"p_diff_{_n}_2_1": f"2 * abs({_n}2 - {_n}1) / best"}
_book_out |= {f"v_avg_{n}": f"(m{n}1 + m{n}2) / 2 / sz" for n in ("asize", "bsize")}
_book_out |= {"p_accspread": "2 * (ask1 + ask2 - bid1 - bid2) / best", "v_accspread": "(masize1 + masize2 - mbsize1 - mbsize2) / sz"}
add("l10_order_book", lambda s, d: rounded(P.order_book(book(s, d), 2, "6 HOURS", "1 HOURS", 3600.0)), sql(
    f"""SELECT instrument, datetime, {", ".join(f'{v} AS "{k}"' for k, v in _book_out.items())} FROM (
    SELECT *, ask1 + bid1 AS best FROM (SELECT instrument, b AS datetime, sum(asize1 + bsize1 + asize2 + bsize2) AS sz, {_book_last}, {_book_mean} FROM bk GROUP BY 1, 2)
    LEFT JOIN (SELECT instrument, time_bucket(INTERVAL 6 HOURS, h, TIMESTAMP '1970-01-01') AS datetime, {", ".join(f"avg({c}) AS d{c}" for c in (*_P2, *_S2))}
      FROM (SELECT instrument, h, {_moves} FROM (SELECT instrument, h, {_steps} FROM bk GROUP BY 1, 2)) GROUP BY 1, 2) USING (instrument, datetime))""", KEYS, list(_book_out), _BOOK))
_flags = lambda: {"even": F.expr("event_id % 2 = 0"), "third": F.expr("event_id % 3 = 0")}
_share = lambda k, s: f"avg(CASE WHEN event_id % {k} = 0 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY instrument ORDER BY datetime RANGE BETWEEN INTERVAL {s * 1_000_000 - 1} MICROSECONDS PRECEDING AND CURRENT ROW)"
add("l10_intensity", lambda s, d: rounded(P.intensity(positive(s, d), _flags(), "1 DAY", 3600, 36000)), sql(
    f"""SELECT instrument, time_bucket(INTERVAL 1 DAY, datetime, TIMESTAMP '1970-01-01') AS datetime, avg(a) AS even_intensity, avg((a > b)::INT::DOUBLE) AS even_relative, avg(c) AS third_intensity, avg((c > e)::INT::DOUBLE) AS third_relative
    FROM (SELECT instrument, datetime, {_share(2, 3600)} AS a, {_share(2, 36000)} AS b, {_share(3, 3600)} AS c, {_share(3, 36000)} AS e FROM pos) GROUP BY 1, 2""",
    KEYS, "even_intensity even_relative third_intensity third_relative", POSITIVE))
add("l10_lagged_change", lambda s, d: rounded(P.lagged_change(positive(s, d), (1, 5), "1 DAY", 3600), 4), sql(
    f"""SELECT instrument, time_bucket(INTERVAL 1 DAY, datetime, TIMESTAMP '1970-01-01') AS datetime, avg(x) AS lag_1_change_rate, avg(y) AS lag_5_change_rate FROM (
    SELECT instrument, datetime, lead(p, 1) OVER {_W} / p - 1 AS x, lead(p, 5) OVER {_W} / p - 1 AS y FROM (
    SELECT g.instrument, g.datetime, last_value(p IGNORE NULLS) OVER (PARTITION BY g.instrument ORDER BY g.datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM
    (SELECT instrument, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS datetime FROM q GROUP BY 1) g LEFT JOIN (SELECT instrument, h, last(value ORDER BY datetime, value) AS p FROM q GROUP BY 1, 2) f
    ON f.instrument = g.instrument AND f.h = g.datetime)) GROUP BY 1, 2""",
    KEYS, "lag_1_change_rate lag_5_change_rate", POSITIVE + ", q AS MATERIALIZED (SELECT *, time_bucket(INTERVAL 1 HOURS, datetime, TIMESTAMP '1970-01-01') AS h FROM pos)", 4))

# G, O, M on the daily panel
c, o, h, lo = (E.feature(f) for f in ("close", "open", "high", "low"))
add("g5_date", lambda s, d: E.evaluate(panel(s, d), {"day": E.date()}), sql("SELECT instrument, datetime, datetime::DATE AS day FROM panel", KEYS + " day"))
add("g6_select", lambda s, d: rounded(E.select(panel(s, d), c > o, {"mid": (h + lo) / 2.0, "mean": E.mean(c, 5)})), sql(
    "SELECT instrument, datetime, mid, mean FROM (SELECT *, (high + low) / 2 AS mid, avg(close) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean FROM panel) WHERE close > open", KEYS, "mid mean"))


def m10_refit(spark, d):
    folds = O.rolling_splits(calendar_of(bars(spark, d)), (0, 499), (500, 599), (600, 699), 100)
    raw = scores(spark, d).select("instrument", "datetime", "idx", "score")
    fits = {"_m": ("mean", "score"), "_s": ("std_pop", "score")}
    found = O.refit_per_fold(raw, folds, fits, {"score": (F.col("score") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))}, segments=("test",))
    return rounded(found.select("fold", "instrument", "datetime", "score"))


add("m10_refit_per_fold", m10_refit, sql(
    "SELECT fold, instrument, datetime, (score - m) / nullif(sd, 0) AS score FROM (SELECT fold, avg(score) AS m, stddev_pop(score) AS sd FROM fo JOIN scores ON idx BETWEEN 100 * fold AND 100 * fold + 499 GROUP BY 1) JOIN (SELECT fold, scores.* FROM fo JOIN scores ON idx BETWEEN 600 + 100 * fold AND 699 + 100 * fold) USING (fold)",
    "fold instrument datetime", "score", BARS + ", fo AS (SELECT unnest(generate_series(0, (SELECT (max(idx) - 600) // 100 FROM cal)))::BIGINT AS fold)"))
add("o9_weights", lambda s, d: rounded(O.reweight(bars(s, d).select("instrument", "datetime", "volume"), F.ln("volume") - 3)), sql("SELECT instrument, datetime, volume, greatest(coalesce(ln(volume) - 3, 0), 0) AS weight FROM bars", KEYS, "volume weight"))


def o2_filled(spark, d):
    s = O.sequence_samples(panel(spark, d), ["close", "volume"], 4, "ffill+bfill")
    return rounded(s.select("instrument", "datetime", *[F.col("sample")[i]["close"].alias(f"c{i}") for i in range(4)], F.col("sample")[3]["volume"].alias("v3")))


_lag = lambda x, i: f"lag({x}, {i}) OVER w" if i else x
_at = lambda x, k: "coalesce(" + ", ".join(_lag(x, i) for i in [*range(3 - k, 4), *range(2 - k, -1, -1)]) + ")"
add("o2_filled_sequences", o2_filled, sql(
    f"SELECT instrument, datetime, {', '.join(f'{_at('close', k)} AS c{k}' for k in range(4))}, {_at('volume', 3)} AS v3 FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY datetime)", KEYS, "c0 c1 c2 c3 v3"))
add("o3_flagged_sequences", lambda s, d: rounded(O.sequence_samples(panel(s, d).withColumn("pick", F.coalesce(F.col("volume") > 20, F.lit(False))), ["close"], 2, flag="pick").select("instrument", "datetime", F.col("sample")[0]["close"].alias("c0"), F.col("sample")[1]["close"].alias("c1"))), sql(
    "SELECT instrument, datetime, c0, c1 FROM (SELECT instrument, datetime, lag(close) OVER w AS c0, close AS c1, volume FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY datetime)) WHERE volume > 20", KEYS, "c0 c1"))

# N
add("n3_drop_cols", lambda s, d: rounded(N.drop_cols(bars(s, d), ["open", "vwap"])), sql("SELECT instrument, datetime, high, low, close, volume FROM bars", KEYS, "high low close volume"))
add("n4_filter_cols", lambda s, d: rounded(N.filter_cols(bars(s, d), ["open", "high", "low", "close"], ["close"])), sql("SELECT instrument, datetime, close, vwap, volume FROM bars", KEYS, "close vwap volume"))
add("n12_cs_robust_again", lambda s, d: rounded(N.cs_robust(scores(s, d).where("volume > 40").select("instrument", "datetime", F.col("volume").alias("x")), ["x"], again=True), 4), sql(
    "SELECT instrument, datetime, (z - avg(z) OVER d) / nullif(stddev_samp(z) OVER d, 0) AS x FROM (SELECT *, CASE WHEN q IS NOT NULL THEN greatest(-3, least(3, q)) END AS z FROM (SELECT *, (volume - m) / nullif(1.4826 * median(abs(volume - m)) OVER (PARTITION BY datetime), 0) AS q FROM (SELECT *, median(volume) OVER (PARTITION BY datetime) AS m FROM scores WHERE volume > 40))) WINDOW d AS (PARTITION BY datetime)",
    KEYS, "x", digits=4))
add("n17_cast", lambda s, d: N.cast(bars(s, d).select("instrument", "datetime", "volume"), ["volume"], "bigint"), sql("SELECT instrument, datetime, volume::BIGINT AS volume FROM bars", KEYS + " volume"))


def _demeaned(frame):
    return frame.assign(close=frame["close"] - frame["close"].mean())


_schema = "instrument string, datetime timestamp_ntz, close double"
_closes = lambda s, d: bars(s, d).select("instrument", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "close")
add("n19_per_instrument", lambda s, d: rounded(N.per_instrument(_closes(s, d), _demeaned, _schema), 4), sql("SELECT instrument, datetime, close - avg(close) OVER (PARTITION BY instrument) AS close FROM bars", KEYS, "close", digits=4))
add("n20_per_day", lambda s, d: rounded(N.per_day(_closes(s, d), _demeaned, _schema), 4), sql("SELECT instrument, datetime, close - avg(close) OVER (PARTITION BY datetime) AS close FROM bars", KEYS, "close", digits=4))

_SECTION = {"STD5": "ln(volume)", "KMID": "score", "HIGH1": "close", "HIGH0": "sqrt(volume / 100)", "CNTP5": None}


def n15_section(spark, d):
    x = scores(spark, d).select("instrument", "datetime", F.col("volume").alias("STD5"), F.col("score").alias("KMID"), F.col("close").alias("HIGH1"), (1 + F.col("volume") / 100).alias("HIGH0"), (F.col("volume") / 7).alias("CNTP5"), "label")
    return rounded(N.section_norm(x, list(_SECTION), ["label"]), 4)


_sec = [k for k, v in _SECTION.items() if v]
_step = lambda make, inner: f"(SELECT *, {', '.join(make(k) for k in _sec)} FROM {inner})"
_x = _step(lambda k: f"{_SECTION[k]} AS x_{k}", "scores")
_m = _step(lambda k: f"x_{k} - median(x_{k}) OVER (PARTITION BY datetime) AS m_{k}", _x)
_z = _step(lambda k: f"m_{k} / nullif(median(abs(m_{k})) OVER (PARTITION BY datetime) * 1.4826, 0) AS z_{k}", _m)
_t = _step(lambda k: f"max(z_{k}) OVER (PARTITION BY datetime) AS t_{k}, min(z_{k}) OVER (PARTITION BY datetime) AS l_{k}", _z)
_r = lambda k: f'coalesce(CASE WHEN z_{k} > 3 THEN 3 + (z_{k} - 3) / nullif(t_{k} - 3, 0) * 0.5 WHEN z_{k} < -3 THEN -3 - (z_{k} + 3) / nullif(l_{k} + 3, 0) * 0.5 ELSE z_{k} END, 0) AS "{k}"'
add("n15_section_norm", n15_section, sql(
    f'SELECT instrument, datetime, {", ".join(map(_r, _sec))}, volume / 7 AS "CNTP5", coalesce((label - avg(label) OVER (PARTITION BY datetime)) / nullif(stddev_samp(label) OVER (PARTITION BY datetime), 0), 0) AS label FROM {_t}',
    KEYS, [*_SECTION, "label"], digits=4))

# B, T on ticks
_minute = "(hour(ts) * 60 + minute(ts))"
_session = f"CASE WHEN {_minute} BETWEEN 570 AND 689 THEN {_minute} - 570 WHEN {_minute} BETWEEN 780 AND 899 THEN {_minute} - 660 END"
add("b6_session_index", lambda s, d: A.read(s, d, "events").select("event_id", B.minute_of_session(F.col("ts")).cast("long").alias("minute"), B.day_index_range(F.col("ts"), F.col("ts"), 5)[1].cast("long").alias("slot")),
    f"SELECT event_id, ({_session})::BIGINT AS minute, ({_session} // 5)::BIGINT AS slot FROM events")
add("b9_times", lambda s, d: A.read(s, d, "events").select("event_id", B.concat_date_time(F.to_date("ts"), F.lit("09:30:00")).alias("open"), B.epsilon_change(F.col("ts")).alias("before"), B.epsilon_change(F.col("ts"), "forward").alias("after")),
    "SELECT event_id, ts::DATE + INTERVAL 570 MINUTES AS open, ts - INTERVAL 1 SECOND AS before, ts + INTERVAL 1 SECOND AS after FROM events")


def t7_factor(spark, d):
    minutes = positive(spark, d).groupBy("instrument", "datetime").agg(F.max("value").alias("close"), (F.sum("event_id") % 3).cast("double").alias("volume"))
    daily = minutes.groupBy("instrument", F.to_date("datetime").alias("datetime")).agg(F.avg("close").alias("close"))
    return rounded(T.intraday_factor(minutes, daily).select("instrument", "datetime", "close", "volume", "factor", "paused"))


add("t7_intraday_factor", t7_factor, sql(
    "SELECT instrument, datetime, close * factor AS close, volume / factor AS volume, factor, volume <= 0 AS paused FROM (SELECT *, avg(close) OVER d / last_value(close) OVER (PARTITION BY instrument, datetime::DATE ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS factor FROM mi WINDOW d AS (PARTITION BY instrument, datetime::DATE))",
    KEYS + " paused", "close volume factor", POSITIVE + ", mi AS MATERIALIZED (SELECT instrument, datetime, max(value) AS close, (sum(event_id) % 3)::DOUBLE AS volume FROM pos GROUP BY 1, 2)"))


# A: tables written and read back
def _folder(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def a1_read_bars(spark, d):
    path = _folder(spark, "bars") + ".csv"
    bars(spark, d).write.option("header", True).csv(path)
    return rounded(A.read_bars(spark, path, bars(spark, d).schema.simpleString()[7:-1].replace(":", " ")))


def a10_metrics(spark, d):
    path = _folder(spark, "report")
    report = market(spark, d).select("datetime", *[(F.col(m) if m in ("return", "turnover", "cost", "bench") else F.lit(None).cast("double")).alias(m) for m in A.METRICS])
    A.save_metrics(report, path)
    return rounded(A.load_metrics(spark, path).select("datetime", "return", "turnover", "bench"))


def a11_export(spark, d):
    path = _folder(spark, "samples")
    first = bars(spark, d).where("instrument < 'Brand#3'").select("instrument", "datetime", "close")
    A.export_samples(first, path, "instrument")
    A.export_samples(bars(spark, d).select("instrument", "datetime", (F.col("close") * 2).alias("close")), path, "instrument")
    return rounded(spark.read.parquet(path).select("instrument", "datetime", "close"))


add("a1_read_bars", a1_read_bars, sql("SELECT * FROM bars", KEYS, "open high low close vwap volume"))
add("a10_metrics", a10_metrics, sql('SELECT datetime, ret AS "return", turnover, bench FROM market', "datetime", "return turnover bench", BARS + ", " + MARKET))
add("a11_export", a11_export, sql("SELECT instrument, datetime, CASE WHEN instrument < 'Brand#3' THEN close ELSE 2 * close END AS close FROM bars", KEYS, "close"))
