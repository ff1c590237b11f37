"""Point-in-time values (I), instrument changes (J) and time resampling (H)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidepanel.functions.nulls import finite
from tidepanel.operators.slices import HALO, SLICE, carried, following, frame, frame_counts, frame_totals, micros, over_slices, previous


def known_values(records: DataFrame, days: DataFrame, last: str = "value") -> DataFrame:
    """For each (instrument, datetime) of ``days`` the value of the latest period known that day, in its latest revision.

    Records are (instrument, period, publish_date, value, load_seq).  Days and records are merged and a running maximum of
    (period, publish_date, load_seq) is taken: one shuffle, no range join.
    """
    key = F.struct("period", "publish_date", "load_seq", F.col("value").alias("v"))
    facts = records.select("instrument", F.col("publish_date").cast("timestamp").alias("datetime"), key.alias("k"), F.lit(0).alias("_o"))
    asks = days.select("instrument", "datetime", F.lit(None).cast(facts.schema["k"].dataType).alias("k"), F.lit(1).alias("_o"))
    w = W.partitionBy("instrument").orderBy("datetime", "_o").rowsBetween(W.unboundedPreceding, 0)
    merged = facts.unionByName(asks).withColumn("k", F.max("k").over(w)).where("_o = 1")
    return merged.select("instrument", "datetime", F.col("k.period").alias("period"), F.col("k.v").alias(last))


def period_value(records: DataFrame, days: DataFrame, period: int) -> DataFrame:
    """One named period as known on each day."""
    return known_values(records.where(F.col("period") == period), days).drop("period")


def next_period(p: Column, n) -> Column:
    """The yyyyqq period ``n`` quarters after ``p``."""
    serial = F.floor(p / 100) * 4 + p % 100 - 1 + n
    return (F.floor(serial / 4) * 100 + F.pmod(serial, F.lit(4)) + 1).cast("int")


def period_window(records: DataFrame, days: DataFrame, n: int, aggregate) -> DataFrame:
    """An aggregate over the last ``n`` periods known each day; unknown periods are missing.

    The state changes only when something is published, so it is computed at publish events and then carried to days.
    """
    events = records.select("instrument", F.col("publish_date").alias("event")).distinct()
    latest = known_values(records, events.select("instrument", F.col("event").cast("timestamp").alias("datetime"))).withColumnRenamed("period", "top").select("instrument", F.to_date("datetime").alias("event"), "top")
    wanted = latest.select("instrument", "event", "top", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("back")).withColumn("period", next_period(F.col("top"), -F.col("back")))
    known = wanted.join(records, ["instrument", "period"], "left").where("publish_date IS NULL OR publish_date <= event")
    values = known.groupBy("instrument", "event", "back").agg(F.max_by("value", F.struct("publish_date", "load_seq")).alias("value"))
    spine = wanted.select("instrument", "event", "back").join(values, ["instrument", "event", "back"], "left")
    at_event = spine.groupBy("instrument", "event").agg(aggregate(F.col("value"), F.col("back")).alias("value"))
    carried = at_event.select("instrument", F.lit(0).alias("period"), F.col("event").alias("publish_date"), "value", F.lit(0).alias("load_seq"))
    w = W.partitionBy("instrument").orderBy("datetime", "_o").rowsBetween(W.unboundedPreceding, 0)
    facts = carried.select("instrument", F.col("publish_date").cast("timestamp").alias("datetime"), F.struct("value").alias("k"), F.lit(0).alias("_o"))
    asks = days.select("instrument", "datetime", F.lit(None).cast(facts.schema["k"].dataType).alias("k"), F.lit(1).alias("_o"))
    return facts.unionByName(asks).withColumn("k", F.last("k", True).over(w)).where("_o = 1").select("instrument", "datetime", F.col("k.value").alias("value"))


def from_instrument(panel: DataFrame, instrument: str, cols: dict[str, str]) -> DataFrame:
    """Columns of another instrument at the same time, renamed by ``cols``.  One instrument is a row per slot."""
    other = panel.where(F.col("instrument") == instrument).select("datetime", *[F.col(c).alias(n) for c, n in cols.items()])
    return panel.join(other, "datetime", "left")


def rolling_beta(panel: DataFrame, n: int) -> DataFrame:
    """Covariance over variance of ret and bench in trailing frames, and the excess return."""
    w = W.partitionBy("instrument").orderBy("datetime").rowsBetween(1 - n, 0)
    both = F.col("ret").isNotNull() & F.col("bench").isNotNull()
    a, b = F.when(both, F.col("ret")), F.when(both, F.col("bench"))
    return panel.withColumns({"beta": F.covar_samp(a, b).over(w) / F.nullif(F.var_samp(b).over(w), F.lit(0.0)), "excess": F.col("ret") - F.col("bench")})


def resample(ticks: DataFrame, width: str, aggregates: dict[str, Column], fill: tuple[str, ...] = ()) -> DataFrame:
    """H1: left-closed buckets per instrument with empty ones present; ``fill`` columns carry the last value on."""
    bucket = F.window("datetime", width)["start"]
    found = ticks.groupBy("instrument", bucket.alias("datetime")).agg(*[a.alias(n) for n, a in aggregates.items()])
    ends = found.groupBy("instrument").agg(F.min("datetime").alias("a"), F.max("datetime").alias("b"))
    spine = ends.select("instrument", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {width}"))).alias("datetime"))
    out = spine.join(found, ["instrument", "datetime"], "left")
    # slices of a thousand buckets
    return carried(out, list(fill), 1000 * _seconds(width)) if fill else out


def _seconds(width: str) -> float:
    """Seconds of an interval like ``6 HOURS``."""
    seconds = {"MICROSECOND": 1e-6, "MILLISECOND": 1e-3, "SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86_400, "WEEK": 604_800}
    parts = width.split()
    return sum(float(n) * seconds[unit.upper().rstrip("S")] for n, unit in zip(parts[::2], parts[1::2], strict=True))


def resample_ts(panel: DataFrame, start, end, method: str, col: str) -> DataFrame:
    """H2, H3: one value per instrument over a slice: last, first, sum, mean, all or the last and first present ones."""
    part = panel.where(F.col("datetime").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    have = F.when(F.col(col).isNotNull(), F.col("datetime"))
    make = {
        "last": F.max_by(col, "datetime"), "first": F.min_by(col, "datetime"), "sum": F.sum(col), "mean": F.avg(col),
        "ts_data_last": F.max_by(col, have), "ts_data_first": F.min_by(col, have), "count": F.count(col),
    }[method] if method != "all" else F.bool_and(col)
    return part.groupBy("instrument").agg(make.alias(col))


def time_window(ticks: DataFrame, seconds: float, aggregates: dict[str, Callable[[Column], Column] | str], col: str = "value") -> DataFrame:
    """Aggregates of a trailing frame (t - seconds, t] by time.

    Those named ``mean``, ``sum``, ``count``, ``min`` or ``max`` cost the same however many rows a frame holds; any other Spark aggregate
    is taken anew for each frame. 
    """
    x = finite(F.col(col))
    named = {n: a for n, a in aggregates.items() if isinstance(a, str)}
    parts = {"mean": ("sum", "count")}
    totals = {f"_{n}_{k}": (k, x) for n, a in named.items() for k in parts.get(a, (a,))}
    df = frame_totals(ticks, seconds, totals) if named else ticks
    made = {n: F.col(f"_{n}_sum") / F.nullif(F.col(f"_{n}_count"), F.lit(0)) if a == "mean" else F.col(f"_{n}_{a}") for n, a in named.items()}
    df = df.withColumns(made).drop(*totals)
    if other := {n: a for n, a in aggregates.items() if n not in named}:
        df = over_slices(df, seconds, lambda df: df.withColumns({n: a(x).over(frame(seconds)) for n, a in other.items()}))
    return df.select(*ticks.columns, *aggregates)


def time_function(ticks: DataFrame, seconds: float, functions: dict[str, Callable[[pd.Series], float]], col: str = "value") -> DataFrame:
    """E23 by a user's functions of the Series of a frame (t - seconds, t], NaN where missing; NaN results are missing.

    Rows of one time have one frame, so a function is called once for each time of an instrument.
    """
    reach, fields = int(seconds * 1_000_000), ticks.columns
    schema = StructType([*ticks.schema.fields, *[StructField(n, DoubleType()) for n in functions]])

    def of_slice(table: pa.Table) -> pa.Table:
        t, x, halo = (table.column(c).to_numpy() for c in ("_t", "_x", HALO))
        order = np.argsort(t, kind="stable")
        sorted_t, values = t[order], pd.Series(x[order].astype(float))
        times, place = np.unique(t[~halo], return_inverse=True)
        starts, ends = np.searchsorted(sorted_t, times - reach, "right"), np.searchsorted(sorted_t, times, "right")
        out = table.filter(pa.array(~halo)).select(fields)
        for n, f in functions.items():
            found = np.array([f(values.iloc[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], float)[place]
            out = out.append_column(n, pa.array(found, mask=np.isnan(found)))
        return out

    ready = ticks.withColumns({"_t": F.coalesce(micros(), F.lit(0)), "_x": finite(F.col(col))})
    return over_slices(ready, seconds, lambda df: df.groupBy("instrument", SLICE).applyInArrow(of_slice, schema).withColumns({SLICE: F.lit(0), HALO: F.lit(False)}), 64 * seconds)


def change_rate(ticks: DataFrame, seconds: float, col: str = "value", order: tuple[str, ...] = ()) -> DataFrame:
    """The value over the first one of the trailing time frame - 1, with the frame's mean and count as depth and intensity.

    Every tick counts, also those of one time, of which the first is the least by ``order`` (by their values, if it isn't given).
    """
    x = F.col(col)
    rows = frame_totals(ticks, seconds, {"_sum": ("sum", x), "intensity": ("count", x)}, {"_first": x}, order or (col,))
    change, depth = x / F.nullif(F.col("_first"), F.lit(0.0)) - 1, F.col("_sum") / F.nullif(F.col("intensity"), F.lit(0))
    return rows.select("instrument", "datetime", col, change.alias("change"), depth.alias("depth"), "intensity")


def cut_ends(df: DataFrame, left: int, right: int) -> DataFrame:
    """Without the first ``left`` and the last ``right`` rows of each instrument."""
    w = W.partitionBy("instrument")
    n = df.withColumns({"_i": F.row_number().over(w.orderBy("datetime")), "_n": F.count("*").over(w)})
    return n.where((F.col("_i") > left) & (F.col("_i") <= F.col("_n") - right)).drop("_i", "_n")


def order_book(book: DataFrame, levels: int, width: str, step: str = "3 SECONDS", seconds: float = 3.0) -> DataFrame:
    """Per instrument and bucket the shape of an order book (ask1.., bid1.., asize1.., bsize1..).

    Size shares, spreads, mids and level differences, depth means, accumulated spreads, and changes of the levels between steps of
    ``step``.  Prices are over half the last best prices' sum, sizes over the bucket's total size.
    """
    sides = {"ask": "asize", "bid": "bsize"}
    every = [f"{n}{i}" for i in range(1, levels + 1) for n in ("ask", "bid", "asize", "bsize")]
    order = F.struct("datetime", *every)
    total = sum((F.col(f"{n}{i}") for n in sides.values() for i in range(1, levels + 1)), F.lit(0.0))
    found = book.groupBy("instrument", F.window("datetime", width)["start"].alias("datetime")).agg(
        F.sum(total).alias("_size"), F.max_by(F.struct(*every), order).alias("_last"), *[F.avg(f"{n}{i}").alias(f"_m{n}{i}") for n in sides.values() for i in range(1, levels + 1)]
    )
    steps = book.groupBy("instrument", F.window("datetime", step)["start"].alias("_step")).agg(
        F.max_by(F.struct(*[f"{n}{i}" for n in sides for i in range(1, levels + 1)]), order).alias("_p"), *[F.avg(f"{n}{i}").alias(f"_s{n}{i}") for n in sides.values() for i in range(1, levels + 1)]
    )
    levels_ = [f"{n}{i}" for n in (*sides, *sides.values()) for i in range(1, levels + 1)]
    now = {f"{n}{i}": F.col(f"_p.{n}{i}") for n in sides for i in range(1, levels + 1)} | {f"{n}{i}": F.col(f"_s{n}{i}") for n in sides.values() for i in range(1, levels + 1)}
    steps = previous(steps.select("instrument", "_step", *[x.alias(c) for c, x in now.items()]), levels_, 10_000 * seconds, "_step")
    moved = steps.select("instrument", "_step", *[(2 * (F.col(c) - F.col(f"_before_{c}")) / seconds).alias(c) for c in now])
    moved = moved.groupBy("instrument", F.window("_step", width)["start"].alias("datetime")).agg(*[F.avg(c).alias(f"_d{c}") for c in now])
    last = lambda c: F.col(f"_last.{c}")
    best, size = F.nullif(last("ask1") + last("bid1"), F.lit(0.0)), F.nullif(F.col("_size"), F.lit(0.0))
    out = {}
    for i in range(1, levels + 1):
        out |= {f"v_{n}_{i}": F.col(f"_m{n}{i}") / size for n in sides.values()}
        out |= {f"p_spread_{i}": 2 * (last(f"ask{i}") - last(f"bid{i}")) / best, f"p_mid_{i}": (last(f"ask{i}") + last(f"bid{i}")) / best}
        out |= {f"p_diff_{n}_{i}_step": F.col(f"_d{n}{i}") / best for n in sides} | {f"v_diff_{n}_{i}_step": F.col(f"_d{n}{i}") / size for n in sides.values()}
        if i < levels:
            out |= {f"p_diff_{n}_{i}_{i + 1}": 2 * F.abs(last(f"{n}{i + 1}") - last(f"{n}{i}")) / best for n in sides}
    out |= {f"p_diff_{n}_{levels}_1": 2 * F.abs(last(f"{n}{levels}") - last(f"{n}1")) / best for n in sides}
    depth = {n: sum((F.col(f"_m{n}{i}") for i in range(1, levels + 1)), F.lit(0.0)) for n in sides.values()}
    prices = {n: sum((last(f"{n}{i}") for i in range(1, levels + 1)), F.lit(0.0)) for n in sides}
    out |= {f"v_avg_{n}": depth[n] / levels / size for n in sides.values()}
    out |= {"p_accspread": 2 * (prices["ask"] - prices["bid"]) / best, "v_accspread": (depth["asize"] - depth["bsize"]) / size}
    return found.join(moved, ["instrument", "datetime"], "left").select("instrument", "datetime", *[v.alias(k) for k, v in out.items()])


def intensity(orders: DataFrame, flags: dict[str, Column], width: str, short: float, long: float) -> DataFrame:
    """Per bucket, for every kind of order (a flag), the mean share it has in trailing times of ``short`` seconds, and how often that is above its share in ``long`` ones."""
    whole = {"_n": F.lit(1)} | {f"_f_{n}": F.when(f, 1).otherwise(0) for n, f in flags.items()}
    seen = frame_counts(orders, whole, {"short": short, "long": long})
    share = lambda n, k: F.col(f"_f_{n}_{k}") / F.col(f"_n_{k}")
    mean = lambda x: F.sum(x * F.col("_n")) / F.sum("_n")  # noqa: E731  (orders of one time see the same frame)
    made = [x for n in flags for x in (mean(share(n, "short")).alias(f"{n}_intensity"), mean((share(n, "short") > share(n, "long")).cast("double")).alias(f"{n}_relative"))]
    return seen.groupBy("instrument", F.window("datetime", width)["start"].alias("datetime")).agg(*made)


def lagged_change(prices: DataFrame, lags: tuple[int, ...], width: str, step_seconds: int = 1, col: str = "value") -> DataFrame:
    """The mean over a bucket of the price some steps later over the price, less 1; steps without one carry the last price on."""
    steps = resample(prices, f"{step_seconds} SECONDS", {"p": F.max_by(col, F.struct("datetime", col))}, ("p",))
    steps = following(steps, "p", lags, step_seconds)
    later = steps.select("instrument", "datetime", *[(F.col(f"_after_{n}") / F.nullif(F.col("p"), F.lit(0.0)) - 1).alias(f"lag_{n}_change_rate") for n in lags])
    return later.groupBy("instrument", F.window("datetime", width)["start"].alias("datetime")).agg(*[F.avg(f"lag_{n}_change_rate").alias(f"lag_{n}_change_rate") for n in lags])
