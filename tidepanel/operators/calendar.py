"""Calendars and times (B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The two sessions of a trading day, first and last minute.
SESSIONS = (("09:30", "11:29"), ("13:00", "14:59"))


def calendar(cal: DataFrame, start, end) -> DataFrame:
    """B1: the slots between two times, both included."""
    return cal.where(F.col("datetime").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def locate_index(cal: DataFrame, start, end) -> DataFrame:
    """B2: one row with the positions of the first slot not before ``start`` and the last not after ``end``."""
    at = F.col("datetime")
    return cal.agg(F.min(F.when(at >= F.lit(start).cast("timestamp"), F.col("idx"))).alias("start_idx"), F.max(F.when(at <= F.lit(end).cast("timestamp"), F.col("idx"))).alias("end_idx"))


def resample_calendar(cal: DataFrame, unit: str, n: int = 1) -> DataFrame:
    """The first slot of each day, week or month, then every n-th of them."""
    key = F.date_trunc(unit, "datetime")
    first = cal.groupBy(key.alias("_k")).agg(F.min("datetime").alias("datetime"))
    return first.withColumn("_r", F.row_number().over(W.orderBy("datetime")) - 1).where(F.col("_r") % n == 0).select("datetime")


def minute_calendar(days: DataFrame, n: int = 1) -> DataFrame:
    """All n-minute slots of the sessions of each day in ``days`` (date)."""
    parts = [days.select(F.explode(F.sequence(*[F.to_timestamp(F.concat_ws(" ", F.col("date").cast("string"), F.lit(t))) for t in s], F.expr(f"INTERVAL {n} MINUTES"))).alias("datetime")) for s in SESSIONS]
    return parts[0].union(parts[1])


def minute_of_session(ts: Column) -> Column:
    """Minutes from the day's first session minute, leaving the break out; missing outside the sessions."""
    m = F.hour(ts) * 60 + F.minute(ts)
    return F.when(m.between(570, 689), m - 570).when(m.between(780, 899), m - 780 + 120)


def floor_minute(ts: Column, n: int) -> Column:
    """The n-minute slot of the session calendar that holds ``ts``."""
    slot = F.floor(minute_of_session(ts) / n) * n
    return F.date_trunc("day", ts) + F.make_dt_interval(mins=F.when(slot < 120, slot + 570).otherwise(slot - 120 + 780))


def day_index_range(start: Column, end: Column, n: int = 1) -> tuple[Column, Column]:
    """First and last slot index of a time interval within a day."""
    return F.floor(minute_of_session(start) / n), F.floor(minute_of_session(end) / n)


def shift_trading_date(dates: DataFrame, cal: DataFrame, k: int, align: str = "left", clip: bool = True) -> DataFrame:
    """For each row of ``dates`` (datetime, ...) the slot ``k`` positions on, as ``shifted``.

    A time that is no slot is first aligned to the next one (left) or to the last one (right).  Beyond the calendar the
    end is taken with ``clip``, else the result is missing.  The aligned position is found by a union sorted by
    time; with a calendar of one row per slot the window runs over slots and distinct dates.
    """
    distinct = dates.select("datetime").distinct()
    merged = cal.select("datetime", "idx").unionByName(distinct.select("datetime", F.lit(None).cast("long").alias("idx")))
    if align == "left":
        over = W.orderBy(F.desc("datetime"), F.desc_nulls_last("idx")).rowsBetween(W.unboundedPreceding, 0)
    else:
        over = W.orderBy("datetime", F.desc_nulls_last("idx")).rowsBetween(W.unboundedPreceding, 0)
    placed = merged.withColumn("_i", F.last("idx", True).over(over)).groupBy("datetime").agg(F.max("_i").alias("_i"))
    top = cal.agg(F.max("idx").alias("_top"))
    beyond = F.col("_top") if align == "left" else F.lit(0)
    to = (F.coalesce("_i", beyond) if clip else F.col("_i")) + k
    to = F.least(F.greatest(to, F.lit(0)), F.col("_top")) if clip else to
    found = placed.crossJoin(F.broadcast(top)).withColumn("_to", to).join(cal.select(F.col("idx").alias("_to"), F.col("datetime").alias("shifted")), "_to", "left")
    return dates.join(found.select("datetime", "shifted"), "datetime", "left")


def calendar_by_ratio(bars: DataFrame, threshold: float = 0.5, least: int = 10) -> DataFrame:
    """Dates on which at least max(int(instruments * threshold), least) instruments traded."""
    days = bars.groupBy("datetime").agg(F.count_distinct("instrument").alias("n"))
    need = bars.agg(F.greatest(F.floor(F.count_distinct("instrument") * threshold), F.lit(least)).alias("need"))
    return days.crossJoin(F.broadcast(need)).where("n >= need").select("datetime", "n")


def concat_date_time(date: Column, time: Column) -> Column:
    """A timestamp of a date and a time of day."""
    return F.to_timestamp(F.concat_ws(" ", date.cast("string"), time))


def epsilon_change(ts: Column, direction: str = "backward") -> Column:
    return ts - F.expr("INTERVAL 1 SECOND") if direction == "backward" else ts + F.expr("INTERVAL 1 SECOND")


def period_list(bounds: DataFrame, quarterly: bool = True) -> DataFrame:
    """All periods between the columns ``first`` and ``last`` (yyyyqq or yyyy), both included."""
    if not quarterly:
        return bounds.select("first", "last", F.explode(F.sequence("first", "last")).alias("period"))
    serial = lambda c: F.floor(F.col(c) / 100) * 4 + F.col(c) % 100 - 1
    n = bounds.select("first", "last", F.explode(F.sequence(serial("first"), serial("last"))).alias("_n"))
    return n.select("first", "last", (F.floor(F.col("_n") / 4) * 100 + F.col("_n") % 4 + 1).cast("int").alias("period"))
