"""Queries on sources, calendars and universes (A to C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import calendar as B
from tidepanel.operators import universe as U
from tidepanel.queries.base import BARS, bars, panel, rounded, scores, sql, ticks
from tidepanel.sources import tables as A

QUERIES, ORACLES = {}, {}
KEYS = "instrument datetime"


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def cal(spark, d):
    return A.calendar_of(bars(spark, d))


add("a2_calendar", cal, sql("SELECT * FROM cal", "datetime idx"))
add("a2_spans", lambda s, d: A.spans_of(bars(s, d)), sql('SELECT instrument, a AS start, b AS "end" FROM sp', "instrument start end"))
add("a2_panel", lambda s, d: rounded(A.build_panel(bars(s, d))[2]), sql("SELECT * FROM panel", KEYS + " idx", "open high low close vwap volume"))
_old = "instrument < 'Brand#2'"
add("a3_add_instruments", lambda s, d: A.add_instruments(A.spans_of(bars(s, d).where(_old)), bars(s, d)), sql('SELECT instrument, a AS start, b AS "end" FROM sp', "instrument start end"))
add("a4_append", lambda s, d: A.append_panel(bars(s, d).where("datetime < '1999-01-01' AND " + _old), bars(s, d).where("datetime >= '1998-12-01'"))[0].select("instrument", "datetime"), sql(f"SELECT instrument, datetime FROM bars LEFT JOIN (SELECT instrument, max(datetime) AS m FROM bars WHERE datetime < '1999-01-01' AND {_old} GROUP BY 1) USING (instrument) WHERE datetime >= '1998-12-01' AND (m IS NULL OR datetime > m)", KEYS))
add("a4_append_spans", lambda s, d: A.append_panel(bars(s, d).where("datetime < '1999-01-01' AND " + _old), bars(s, d).where("datetime >= '1998-12-01'"))[1], sql(f"SELECT instrument, min(datetime) AS start, max(datetime) AS \"end\" FROM bars WHERE datetime >= '1998-12-01' OR {_old} GROUP BY 1", "instrument start end"))
add("a6_select_fields", lambda s, d: rounded(A.select_fields(bars(s, d), exclude=("open", "vwap"))), sql("SELECT * FROM bars", KEYS, "high low close volume"))
add("a8_load_groups", lambda s, d: rounded(A.load_groups({"feature": bars(s, d).where("volume > 30").select("instrument", "datetime", "close"), "label": scores(s, d).select("instrument", "datetime", "label")})), sql("SELECT coalesce(a.instrument, b.instrument) AS instrument, coalesce(a.datetime, b.datetime) AS datetime, a.close AS feature__close, b.label AS label__label FROM (SELECT * FROM bars WHERE volume > 30) a FULL JOIN scores b ON a.instrument = b.instrument AND a.datetime = b.datetime", KEYS, "feature__close label__label"))
add("a9_compare", lambda s, d: A.compare_tables(bars(s, d).select("instrument", "datetime", "close"), bars(s, d).where("instrument <> 'Brand#11'").select("instrument", "datetime", F.when(F.col("instrument") == "Brand#12", F.col("close") * 1.01).otherwise(F.col("close")).alias("close"))), sql("SELECT DISTINCT instrument, CASE WHEN instrument = 'Brand#11' THEN NULL ELSE instrument <> 'Brand#12' END AS same FROM bars", "instrument same"))


def pit(spark, d):
    """Quarterly sums of brands with publish dates; a second revision of some."""
    b = bars(spark, d)
    q = b.groupBy("instrument", (F.year("datetime") * 100 + F.quarter("datetime")).cast("int").alias("period"), F.last_day(F.add_months(F.trunc("datetime", "quarter"), 2)).alias("period_end")).agg(F.sum("volume").alias("value"))
    number = F.regexp_extract("instrument", r"(\d+)", 1).cast("int")
    first = q.select("instrument", "period", F.date_add("period_end", number).alias("publish_date"), "value", F.lit(0).alias("load_seq"))
    again = q.where(number % 3 == 0).select("instrument", "period", F.date_add("period_end", number + 100).alias("publish_date"), (F.col("value") + 1).alias("value"), F.lit(1).alias("load_seq"))
    return first.union(again)


PIT = """
q0 AS (SELECT instrument, (year(datetime) * 100 + quarter(datetime))::INT AS period, last_day((date_trunc('quarter', datetime) + INTERVAL 2 MONTH)::DATE) AS period_end, sum(volume) AS value, regexp_extract(instrument, '(\\d+)', 1)::INT AS num FROM bars GROUP BY ALL),
pit AS (SELECT instrument, period, (period_end + num)::DATE AS publish_date, value, 0 AS load_seq FROM q0 UNION ALL SELECT instrument, period, (period_end + num + 100)::DATE, value + 1, 1 FROM q0 WHERE num % 3 = 0)"""
add("a7_append_pit", lambda s, d: rounded(A.append_pit(pit(s, d).where("publish_date < '1998-01-01'").withColumn("field", F.lit("v")), pit(s, d).withColumn("field", F.lit("v"))).select("instrument", "period", "publish_date", "value")), sql("SELECT instrument, period, publish_date, value FROM pit LEFT JOIN (SELECT instrument, max(publish_date) AS m FROM pit WHERE publish_date < '1998-01-01' GROUP BY 1) USING (instrument) WHERE m IS NULL OR publish_date > m", "instrument period publish_date", "value", BARS + "," + PIT))

# B
add("b1_calendar", lambda s, d: B.calendar(cal(s, d), "1997-03-01", "1997-09-30"), sql("SELECT * FROM cal WHERE datetime BETWEEN '1997-03-01' AND '1997-09-30'", "datetime idx"))
add("b2_locate", lambda s, d: B.locate_index(cal(s, d), "1997-03-01", "1997-09-30"), sql("SELECT min(CASE WHEN datetime >= '1997-03-01' THEN idx END) AS start_idx, max(CASE WHEN datetime <= '1997-09-30' THEN idx END) AS end_idx FROM cal", "start_idx end_idx"))
add("b3_resample", lambda s, d: B.resample_calendar(cal(s, d), "month", 2), sql("SELECT m AS datetime FROM (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM (SELECT min(datetime) AS m FROM cal GROUP BY date_trunc('month', datetime))) WHERE r % 2 = 0", "datetime"))
_days = lambda s, d: ticks(s, d).select(F.to_date("datetime").alias("date")).distinct()
_TICKS = "ticks AS (SELECT event_type AS instrument, ts AS datetime, event_id, value FROM events)"
add("b4_minutes", lambda s, d: B.minute_calendar(_days(s, d), 30).select(F.date_format("datetime", "yyyy-MM-dd HH:mm").alias("t")), sql("SELECT strftime(x.d + g.m * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M') AS t FROM (SELECT DISTINCT datetime::DATE AS d FROM ticks) x, (SELECT unnest([570, 600, 630, 660, 780, 810, 840, 870]) AS m) g", "t", ctes=_TICKS))
add("b5_floor_minute", lambda s, d: ticks(s, d).select("event_id", B.minute_of_session(F.col("datetime")).cast("long").alias("minute"), F.date_format(B.floor_minute(F.col("datetime"), 15), "HH:mm").alias("slot")), sql("SELECT event_id, k AS minute, CASE WHEN k IS NOT NULL THEN strftime(DATE '2000-01-01' + (CASE WHEN k // 15 * 15 < 120 THEN k // 15 * 15 + 570 ELSE k // 15 * 15 - 120 + 780 END) * INTERVAL 1 MINUTE, '%H:%M') END AS slot FROM (SELECT event_id, CASE WHEN m BETWEEN 570 AND 689 THEN m - 570 WHEN m BETWEEN 780 AND 899 THEN m - 660 END AS k FROM (SELECT event_id, hour(datetime) * 60 + minute(datetime) AS m FROM ticks))", "event_id minute slot", ctes=_TICKS))
add("b7_shift", lambda s, d: B.shift_trading_date(cal(s, d).select(F.date_add("datetime", 2).cast(cal(s, d).schema["datetime"].dataType).alias("datetime")).distinct(), cal(s, d), 3), sql("SELECT x.datetime, c2.datetime AS shifted FROM (SELECT c.datetime + INTERVAL 2 DAY AS datetime FROM cal c) x LEFT JOIN (SELECT x.d, min(idx) AS i FROM (SELECT datetime + INTERVAL 2 DAY AS d FROM cal) x JOIN cal ON cal.datetime >= x.d GROUP BY 1) y ON y.d = x.datetime LEFT JOIN cal c2 ON c2.idx = least(y.i + 3, (SELECT max(idx) FROM cal))", "datetime shifted"))
add("b8_by_ratio", lambda s, d: B.calendar_by_ratio(bars(s, d), 0.6), sql("SELECT datetime, n FROM (SELECT datetime, count(DISTINCT instrument) AS n FROM bars GROUP BY 1) WHERE n >= (SELECT greatest(floor(count(DISTINCT instrument) * 0.6), 10) FROM bars)", "datetime n"))
add("b10_periods", lambda s, d: B.period_list(pit(s, d).groupBy("instrument").agg(F.min("period").alias("first"), F.max("period").alias("last"))).select("first", "last", "period").distinct(), sql("SELECT DISTINCT f AS first, l AS last, (y * 100 + k)::INT AS period FROM (SELECT instrument, min(period) AS f, max(period) AS l FROM pit GROUP BY 1), range(1990, 2010) a(y), range(1, 5) b(k) WHERE y * 100 + k BETWEEN f AND l", "first last period", ctes=BARS + "," + PIT))


# C
def spans(spark, d):
    """Yearly spans of brands, leaving out some years by arithmetic."""
    b = bars(spark, d).withColumn("y", F.year("datetime"))
    number = F.regexp_extract("instrument", r"(\d+)", 1).cast("int")
    return b.where((F.col("y") + number) % 3 != 0).groupBy("instrument", "y").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end")).drop("y")


SPANS = "spans AS (SELECT instrument, min(datetime) AS a, max(datetime) AS b FROM bars WHERE (year(datetime) + regexp_extract(instrument, '(\\d+)', 1)::INT) % 3 <> 0 GROUP BY instrument, year(datetime))"
_BARS = BARS
add("c1_universe", lambda s, d: U.universe(spans(s, d), "1996-06-01", "1999-06-01"), sql("SELECT instrument, greatest(a, '1996-06-01'::TIMESTAMP) AS start, least(b, '1999-06-01'::TIMESTAMP) AS \"end\" FROM spans WHERE greatest(a, '1996-06-01'::TIMESTAMP) <= least(b, '1999-06-01'::TIMESTAMP)", "instrument start end", ctes=_BARS + "," + SPANS))
add("c2_restrict", lambda s, d: rounded(U.restrict(bars(s, d), spans(s, d)).select("instrument", "datetime", "close")), sql("SELECT instrument, datetime, close FROM bars WHERE EXISTS (SELECT 1 FROM spans WHERE spans.instrument = bars.instrument AND datetime BETWEEN a AND b)", KEYS, "close", ctes=_BARS + "," + SPANS))
add("c3_filter_name", lambda s, d: U.filter_name(bars(s, d), r"Brand#[12]\d", "1997-01-01", "1998-12-31").select("instrument", "datetime"), sql("SELECT instrument, datetime FROM bars WHERE regexp_matches(instrument, '^Brand#[12][0-9]') OR datetime NOT BETWEEN '1997-01-01' AND '1998-12-31'", KEYS))
add("c4_filter_flag", lambda s, d: U.filter_flag(bars(s, d).select("instrument", "datetime"), scores(s, d).where("instrument <> 'Brand#11'").select("instrument", "datetime", (F.col("score") > 0).alias("flag")), keep=True), sql("SELECT b.instrument, b.datetime FROM bars b LEFT JOIN scores s ON b.instrument = s.instrument AND b.datetime = s.datetime WHERE b.instrument = 'Brand#11' OR s.score > 0", KEYS))
add("c5_mask_to_spans", lambda s, d: U.mask_to_spans(panel(s, d).select("instrument", "datetime", "idx", F.col("close").isNotNull().alias("flag"))), sql("SELECT instrument, min(datetime) AS start, max(datetime) AS \"end\" FROM (SELECT instrument, datetime, idx - row_number() OVER (PARTITION BY instrument ORDER BY datetime) AS g FROM panel WHERE close IS NOT NULL) GROUP BY instrument, g", "instrument start end"))
add("c6_pipe", lambda s, d: U.filter_pipe(bars(s, d), lambda x: U.filter_name(x, "Brand#1"), lambda x: U.restrict(x, spans(s, d))).select("instrument", "datetime"), sql("SELECT instrument, datetime FROM bars WHERE instrument LIKE 'Brand#1%' AND EXISTS (SELECT 1 FROM spans WHERE spans.instrument = bars.instrument AND datetime BETWEEN a AND b)", KEYS, ctes=_BARS + "," + SPANS))
add("c7_covers", lambda s, d: U.covers_range(bars(s, d), "1995-01-03", "2001-11-01").select("instrument", "datetime"), sql("SELECT instrument, datetime FROM bars JOIN sp USING (instrument) WHERE a <= '1995-01-03' AND b >= '2001-11-01'", KEYS))


def snapshots(spark, d):
    return bars(spark, d).where("volume > 30").select(F.trunc("datetime", "year").alias("date"), F.concat_ws("_", "instrument", F.month("datetime").cast("string")).alias("symbol")).distinct()


_SNAP = "snap AS (SELECT DISTINCT date_trunc('year', datetime)::DATE AS date, instrument || '_' || month(datetime) AS symbol FROM bars WHERE volume > 30), dd AS (SELECT date, lag(date) OVER (ORDER BY date) AS p, lead(date) OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM snap))"
add("c8_changes", lambda s, d: U.changes_from_snapshots(snapshots(s, d)), sql("SELECT date, symbol, 'add' AS type FROM snap JOIN dd USING (date) WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snap o WHERE o.date = dd.p AND o.symbol = snap.symbol) UNION ALL SELECT n, symbol, 'remove' FROM snap JOIN dd USING (date) WHERE n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snap o WHERE o.date = dd.n AND o.symbol = snap.symbol)", "date symbol type", ctes=_BARS + "," + _SNAP))
add("c9_spans_from_changes", lambda s, d: U.spans_from_changes(U.changes_from_snapshots(snapshots(s, d)), snapshots(s, d).where("date = '2001-01-01'").select("symbol"), "1995-01-01", "2099-12-31"), sql(
    "SELECT symbol, date AS start, coalesce(nd, DATE '2099-12-31') AS \"end\" FROM ev WHERE type = 'add' UNION ALL SELECT symbol, DATE '1995-01-01', date FROM ev WHERE type = 'remove' AND pt IS NULL UNION ALL SELECT symbol, DATE '1995-01-01', DATE '2099-12-31' FROM snap WHERE date = DATE '2001-01-01' AND symbol NOT IN (SELECT symbol FROM ch)",
    "symbol start end", ctes=_BARS + "," + _SNAP + ", ch AS (SELECT date, symbol, 'add' AS type FROM snap JOIN dd USING (date) WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snap o WHERE o.date = dd.p AND o.symbol = snap.symbol) UNION ALL SELECT n, symbol, 'remove' FROM snap JOIN dd USING (date) WHERE n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snap o WHERE o.date = dd.n AND o.symbol = snap.symbol)), ev AS (SELECT *, lag(type) OVER (PARTITION BY symbol ORDER BY date) AS pt, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS nd FROM ch)"))
add("c10_symbols", lambda s, d: A.read(s, d, "customer").select("c_custkey", U.suffix_to_prefix(F.concat(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.when(F.col("c_custkey") % 2 == 0, ".ss").otherwise(".sz"))).alias("symbol"), U.prefix_to_suffix(F.concat(F.lit("SH"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))).alias("back")), "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'SH' ELSE 'SZ' END || lpad(c_custkey::VARCHAR, 6, '0') AS symbol, lpad(c_custkey::VARCHAR, 6, '0') || '.ss' AS back FROM customer")
