"""Universes: spans, membership and rules (C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def by_time():
    return W.partitionBy("instrument").orderBy("datetime")



def universe(spans: DataFrame, start, end) -> DataFrame:
    """Spans (instrument, start, end) cut to a time window; empty ones go."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return spans.withColumns({"start": F.greatest("start", a), "end": F.least("end", b)}).where("start <= end")


def restrict(panel: DataFrame, spans: DataFrame) -> DataFrame:
    """The panel's rows inside any span of their instrument.  Spans of an instrument travel as one array, so it is an equi join."""
    arrays = spans.groupBy("instrument").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    inside = F.exists("_spans", lambda s: F.col("datetime").between(s["start"], s["end"]))
    return panel.join(arrays, "instrument").where(inside).drop("_spans")


def filter_name(panel: DataFrame, regex: str, start=None, end=None) -> DataFrame:
    """Keep instruments whose name matches from its beginning; days outside the rule's window are untouched."""
    rule = F.col("instrument").rlike(f"^(?:{regex})")
    outside = F.lit(False)
    if start is not None:
        outside = outside | (F.col("datetime") < F.lit(start).cast("timestamp"))
    if end is not None:
        outside = outside | (F.col("datetime") > F.lit(end).cast("timestamp"))
    return panel.where(rule | outside)


def filter_flag(panel: DataFrame, flags: DataFrame, keep: bool = False) -> DataFrame:
    """C4: keep rows whose flag (instrument, datetime, flag) is true; ``keep`` for instruments without flags."""
    known = flags.select("instrument").distinct().withColumn("_known", F.lit(True))
    out = panel.join(flags, ["instrument", "datetime"], "left").join(known, "instrument", "left")
    return out.where(F.coalesce("flag", F.when(F.col("_known"), F.lit(False)), F.lit(keep))).drop("flag", "_known")


def mask_to_spans(mask: DataFrame) -> DataFrame:
    """Rows (instrument, datetime, idx, flag) to the maximal spans of true flags on consecutive positions."""
    true = mask.where("flag").withColumn("_g", F.col("idx") - F.row_number().over(by_time()))
    return true.groupBy("instrument", "_g").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end")).drop("_g")


def filter_pipe(panel: DataFrame, *rules) -> DataFrame:
    """Rules applied in order, each on what the one before kept."""
    for rule in rules:
        panel = rule(panel)
    return panel


def covers_range(panel: DataFrame, start, end) -> DataFrame:
    """Instruments that exist at both ends of a range."""
    w = W.partitionBy("instrument")
    first, last = F.min("datetime").over(w), F.max("datetime").over(w)
    kept = panel.withColumns({"_a": first, "_b": last}).where((F.col("_a") <= F.lit(start).cast("timestamp")) & (F.col("_b") >= F.lit(end).cast("timestamp")))
    return kept.drop("_a", "_b")


def changes_from_snapshots(snapshots: DataFrame) -> DataFrame:
    """Membership snapshots (date, symbol) to add and remove events between consecutive ones, dated by the later snapshot."""
    dates = snapshots.select("date").distinct().select("date", F.lag("date").over(W.orderBy("date")).alias("_before"), F.lead("date").over(W.orderBy("date")).alias("_after"))
    placed = snapshots.join(dates, "date")
    before = snapshots.select(F.col("date").alias("_before"), "symbol")
    after = snapshots.select(F.col("date").alias("_after"), "symbol")
    added = placed.where("_before IS NOT NULL").join(before, ["_before", "symbol"], "left_anti").select("date", "symbol", F.lit("add").alias("type"))
    removed = placed.where("_after IS NOT NULL").join(after, ["_after", "symbol"], "left_anti").select(F.col("_after").alias("date"), "symbol", F.lit("remove").alias("type"))
    return added.union(removed)


def spans_from_changes(changes: DataFrame, current: DataFrame, bench_start, far) -> DataFrame:
    """Spans (symbol, start, end) from events and today's members; logs are well formed (adds and removes alternate)."""
    events = changes.select("symbol", "date", "type")
    w = W.partitionBy("symbol").orderBy("date")
    events = events.withColumns({"_prev": F.lag("type").over(w), "_next": F.lead("date").over(w)})
    opened = events.where("type = 'add'").select("symbol", F.col("date").alias("start"), F.coalesce("_next", F.lit(far).cast("date")).alias("end"))
    early = events.where("type = 'remove' AND _prev IS NULL").select("symbol", F.lit(bench_start).cast("date").alias("start"), F.col("date").alias("end"))
    always = current.join(changes.select("symbol").distinct(), "symbol", "left_anti").select("symbol", F.lit(bench_start).cast("date").alias("start"), F.lit(far).cast("date").alias("end"))
    return opened.union(early).union(always)


def suffix_to_prefix(symbol: Column) -> Column:
    """600000.ss to SH600000; other markets keep their letters."""
    code, market = F.split_part(symbol, F.lit("."), F.lit(1)), F.upper(F.split_part(symbol, F.lit("."), F.lit(2)))
    return F.concat(F.when(market == "SS", F.lit("SH")).otherwise(market), code)


def prefix_to_suffix(symbol: Column) -> Column:
    """The inverse; the last two characters of the market are its suffix."""
    market = F.lower(F.substring(symbol, 1, 2))
    return F.concat(F.substring(symbol, 3, 1_000_000), F.lit("."), F.when(market == "sh", F.lit("ss")).otherwise(market))
