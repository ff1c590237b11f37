"""Market-data preparation (T), quality reports (U) and refreshing of tables (V)."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.sources.scratch import written

from tidepanel.functions.nulls import INF, unbiased_kurtosis, unbiased_skew
from tidepanel.operators.signals import pred_autocorr
from tidepanel.sources.tables import align_calendar

def by_time():
    return W.partitionBy("instrument").orderBy("datetime")

def history():
    return by_time().rowsBetween(W.unboundedPreceding, 0)

PRICES = ("open", "high", "low", "close")


def normalize_simple(raw: DataFrame, cal: DataFrame) -> DataFrame:
    """One row per key, on the calendar; the first by all its values is kept."""
    rest = [c for c in raw.columns if c not in ("instrument", "datetime")]
    first = raw.groupBy("instrument", "datetime").agg(F.min(F.struct(*rest)).alias("_v")).select("instrument", "datetime", "_v.*")
    return align_calendar(first, cal)


def normalize_daily(raw: DataFrame, cal: DataFrame) -> DataFrame:
    """T10, and days without volume have all values missing."""
    out = normalize_simple(raw, cal)
    return out.withColumns({c: F.when(F.col("volume") > 0, F.col(c)) for c in (*PRICES, "volume") if c in out.columns})


def calc_change(df: DataFrame, last_close: Column | None = None) -> DataFrame:
    """Filled close over the previous filled close - 1."""
    filled = df.withColumn("_f", F.last("close", True).over(history()))
    before = F.lag("_f").over(by_time())
    before = before if last_close is None else F.coalesce(before, last_close)
    return filled.withColumn("change", F.col("_f") / F.nullif(before, F.lit(0.0)) - 1).drop("_f")


def repair_units(df: DataFrame, rounds: int = 10) -> DataFrame:
    """Divide by 100 the prices of rows whose change lies in 89 to 111, until none does; a warning where ``rounds`` weren't enough.

    Each round's rows are written, and only the instruments that it changed go into the next one.
    """
    settled, left = [], df
    for _ in range(rounds):
        marked = written(calc_change(left).withColumn("_bad", F.coalesce(F.col("change").between(89, 111), F.lit(False))))
        changed = marked.where("_bad").select("instrument").distinct()
        settled.append(marked.join(changed, "instrument", "left_anti").select(*df.columns))
        if changed.isEmpty():
            break
        mended = {c: F.when(F.col("_bad"), F.col(c) / 100).otherwise(F.col(c)) for c in (*PRICES, "adjclose") if c in df.columns}
        left = marked.join(changed, "instrument", "left_semi").withColumns(mended).select(*df.columns)
    else:
        warnings.warn(f"changes of about 100 times may be left after {rounds} rounds", stacklevel=2)
        settled.append(left)
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def adjust(df: DataFrame) -> DataFrame:
    """T4: factor = filled adjclose / close; prices times, volume over the factor."""
    f = df.withColumn("factor", F.last(F.col("adjclose") / F.nullif(F.col("close"), F.lit(0.0)), True).over(history()))
    return f.withColumns({c: F.col(c) * F.col("factor") for c in PRICES if c in df.columns} | {"volume": F.col("volume") / F.nullif(F.col("factor"), F.lit(0.0))})


def rebase(df: DataFrame) -> DataFrame:
    """T5: prices over the first close, volume times it."""
    first = F.first("close", True).over(by_time().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    out = df.withColumn("_b", first)
    return out.withColumns({c: F.col(c) / F.nullif(F.col("_b"), F.lit(0.0)) for c in PRICES if c in df.columns} | {"volume": F.col("volume") * F.col("_b")}).drop("_b")


def splice(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New rows scaled so that the stored last date's close agrees, without the overlap."""
    last = stored.groupBy("instrument").agg(F.max("datetime").alias("_d"), F.max_by("close", "datetime").alias("_c"))
    at = new.join(last, "instrument")
    scale = F.max(F.when(F.col("datetime") == F.col("_d"), F.col("_c") / F.nullif(F.col("close"), F.lit(0.0)))).over(W.partitionBy("instrument"))
    scaled = at.withColumn("_s", scale).withColumns({c: F.col(c) * F.col("_s") for c in PRICES if c in new.columns} | {"volume": F.col("volume") / F.nullif(F.col("_s"), F.lit(0.0))})
    return scaled.where("datetime > _d").select(*new.columns)


def intraday_factor(minutes: DataFrame, daily: DataFrame) -> DataFrame:
    """factor = daily close over the day's last present minute close; paused without volume."""
    day = minutes.withColumn("date", F.to_date("datetime"))
    last = F.max_by("close", F.when(F.col("close").isNotNull(), F.col("datetime")))
    last = day.groupBy("instrument", "date").agg(last.alias("_m"))
    f = last.join(daily.select("instrument", F.to_date("datetime").alias("date"), F.col("close").alias("_d")), ["instrument", "date"])
    f = f.select("instrument", "date", (F.col("_d") / F.nullif(F.col("_m"), F.lit(0.0))).alias("factor"))
    out = day.join(f, ["instrument", "date"], "left")
    return out.withColumns({"close": F.col("close") * F.col("factor"), "volume": F.col("volume") / F.nullif(F.col("factor"), F.lit(0.0)), "paused": F.coalesce(F.col("volume") <= 0, F.lit(True))}).drop("date")


def paused_counter(days: DataFrame) -> DataFrame:
    """Length so far of the current run of days with volume; leading and trailing days without are dropped."""
    live = F.coalesce(F.col("volume") > 0, F.lit(False))
    marked = days.withColumns({"_live": live, "_g": F.sum(F.when(~live, 1).otherwise(0)).over(history())})
    whole = W.partitionBy("instrument")
    on = F.when(F.col("_live"), F.col("datetime"))
    marked = marked.withColumns({"_a": F.min(on).over(whole), "_b": F.max(on).over(whole)})
    count = F.sum(F.col("_live").cast("long")).over(W.partitionBy("instrument", "_g").orderBy("datetime"))
    return marked.withColumn("paused_num", count).where("datetime BETWEEN _a AND _b").drop("_live", "_g", "_a", "_b")


def missing_symbols(daily: DataFrame, minutes: DataFrame, slots: DataFrame) -> DataFrame:
    """Empty rows on all slots for instruments without minute bars."""
    gone = daily.select("instrument").distinct().join(minutes.select("instrument").distinct(), "instrument", "left_anti")
    return gone.withColumn("_k", F.lit(1)).join(slots.select("datetime", F.lit(1).alias("_k")), "_k").drop("_k").withColumn("paused_num", F.lit(0))


def normalize_pit(df: DataFrame, quarterly: bool = True) -> DataFrame:
    """Missing publish dates are 45 (90) days after the period's end; the period becomes yyyyqq (yyyy)."""
    out = df.withColumn("publish_date", F.coalesce("publish_date", F.date_add("period_end", 45 if quarterly else 90)))
    return out.withColumn("period", (F.year("period_end") * 100 + F.quarter("period_end") if quarterly else F.year("period_end")).cast("int"))


# U: quality
def missing_report(df: DataFrame, cols: tuple[str, ...], threshold: int = 0) -> DataFrame:
    """Instruments with more missing values than allowed in some column."""
    n = {c: F.sum(F.col(c).isNull().cast("long")) for c in cols}
    out = df.groupBy("instrument").agg(*[a.alias(c) for c, a in n.items()])
    return out.where(reduce(lambda a, b: a | b, [F.col(c) > threshold for c in cols]))


def step_report(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Per instrument and column the first and largest change beyond its limit."""
    out = []
    for c, limit in limits.items():
        step = F.abs(F.col(c) / F.nullif(F.lag(c).over(by_time()), F.lit(0.0)) - 1)
        out.append(F.struct(F.lit(c).alias("field"), step.alias("step"), F.lit(float(limit)).alias("limit")))
    long = df.select("instrument", "datetime", F.array(*out).alias("_s")).select("instrument", "datetime", F.explode("_s").alias("s")).where("s.step > s.limit")
    return long.groupBy("instrument", "s.field").agg(F.min("datetime").alias("first_date"), F.max("s.step").alias("largest"))


def absent_columns(df: DataFrame, wanted: tuple[str, ...] = (*PRICES, "volume")) -> list[str]:
    """U3."""
    return [c for c in wanted if c not in df.columns]


def missing_factor(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """U4: instruments whose factor is missing throughout."""
    return df.where(~F.col("instrument").isin(*skip) if skip else F.lit(True)).groupBy("instrument").agg(F.count("factor").alias("_n")).where("_n = 0").select("instrument")


def distinct_per_day(df: DataFrame, col: str) -> DataFrame:
    """Distinct values, a missing one counted once, and their share of the rows."""
    n = F.count_distinct(col) + F.max(F.col(col).isNull().cast("long"))
    return df.groupBy("datetime").agg(n.alias("n"), (n / F.count("*")).alias("ratio"))


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """(bin from 1, n) of equal widths between the least and the largest value; the largest falls in the last bin."""
    ends = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    at = F.least(F.floor((F.col(col) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins) + 1, F.lit(bins))
    return df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(1)).alias("bin")).agg(F.count("*").alias("n"))


def day_counts(df: DataFrame, col: str) -> DataFrame:
    """Per day infinities, missing values and their share, moments."""
    ok = F.when(F.abs(col) != F.lit(INF), F.col(col))
    n, flat = F.count(ok), F.stddev_pop(ok)
    return df.groupBy("datetime").agg(
        F.sum(F.coalesce(F.abs(col) == F.lit(INF), F.lit(False)).cast("long")).alias("inf"), F.sum(F.col(col).isNull().cast("long")).alias("missing"),
        F.avg(F.col(col).isNull().cast("double")).alias("missing_ratio"), F.avg(ok).alias("mean"), F.stddev_samp(ok).alias("std"),
        unbiased_skew(F.skewness(ok), n, flat).alias("skew"), unbiased_kurtosis(F.kurtosis(ok), n, flat, 0.0).alias("kurt"),
    )


def feature_autocorr(df: DataFrame, cols: list[str], lag: int = 1) -> DataFrame:
    """U9."""
    parts = [pred_autocorr(df.select("instrument", "datetime", F.col(c).alias("score")), lag).withColumn("feature", F.lit(c)) for c in cols]
    return reduce(DataFrame.unionByName, parts)


# V: combining and refreshing
def rolling_ensemble(parts: list[DataFrame]) -> DataFrame:
    """V1: one table of (instrument, datetime, score) parts; of repeated keys that of the part which starts later."""
    tagged = []
    for i, p in enumerate(parts):
        start = p.agg(F.min("datetime").alias("_start"))
        tagged.append(p.crossJoin(F.broadcast(start)).withColumn("_i", F.lit(i)))
    return reduce(DataFrame.unionByName, tagged).groupBy("instrument", "datetime").agg(F.max_by("score", F.struct("_start", "_i")).alias("score"))


def average_ensemble(df: DataFrame) -> DataFrame:
    """V2: rows (source, instrument, datetime, score): mean over sources of each day's z-scores."""
    w = W.partitionBy("source", "datetime")
    z = (F.col("score") - F.avg("score").over(w)) / F.nullif(F.stddev_samp("score").over(w), F.lit(0.0))
    return df.withColumn("z", z).groupBy("instrument", "datetime").agg(F.avg("z").alias("score"))


def grouped_ensemble(df: DataFrame) -> DataFrame:
    """V3: V1 within each model; rows (model, source, instrument, datetime, score)."""
    start = df.groupBy("model", "source").agg(F.min("datetime").alias("_start"))
    return df.join(start, ["model", "source"]).groupBy("model", "instrument", "datetime").agg(F.max_by("score", F.struct("_start", "source")).alias("score"))


def replace_range(stored: DataFrame, new: DataFrame) -> DataFrame:
    """V4: the dates of the new rows' range come from them."""
    ends = new.agg(F.min("datetime").alias("_a"), F.max("datetime").alias("_b"))
    kept = stored.crossJoin(F.broadcast(ends)).where("_a IS NULL OR NOT datetime BETWEEN _a AND _b").select(*stored.columns)
    return kept.unionByName(new.dropDuplicates(["instrument", "datetime"]))


def window_start(cal: DataFrame, last_end, history: int) -> DataFrame:
    """V6: the first slot an incremental run reads: history - 1 slots before ``last_end``."""
    at = cal.where(F.col("datetime") <= F.lit(last_end).cast("timestamp")).agg(F.max("idx").alias("_i"))
    return cal.join(F.broadcast(at), F.col("idx") == F.greatest(F.col("_i") - (history - 1), F.lit(0))).select("datetime")


def refresh(stored: DataFrame, panel: DataFrame, calendar: DataFrame, exprs: dict, last_update, end) -> DataFrame:
    """V5: recompute rows after ``last_update`` and the last rows before it that looked into the future."""
    from tidepanel.functions.expressions import reach
    from tidepanel.operators.datasets import features

    right = reach(exprs)[1]
    start = window_start(calendar, last_update, right).first()["datetime"] if right else last_update
    fresh = features(panel, calendar, exprs, start, end)
    if not right:
        fresh = fresh.where(F.col("datetime") > F.lit(last_update).cast("timestamp"))
    return replace_range(stored, fresh)
