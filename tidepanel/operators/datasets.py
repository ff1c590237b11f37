"""Queries of panels, splits and samples (M, O)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.expressions import Expr, evaluate, reach
from tidepanel.sources.scratch import written


def features(panel: DataFrame, calendar: DataFrame, exprs: dict[str, Expr], start, end) -> DataFrame:
    """M1: expressions of an aligned panel between two times.

    The slots read before and after the range come from the expressions; with the calendar they become bounds of dates (and of a stored
    panel's periods) below the windows, which reach the scan, and the result is cut to the range above them.
    """
    left, right = reach(exprs)
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    ends = calendar.agg(F.min(F.when(F.col("datetime") >= a, F.col("idx"))).alias("a"), F.max(F.when(F.col("datetime") <= b, F.col("idx"))).alias("b")).first()
    if ends["a"] is None or ends["b"] is None:
        return evaluate(panel.limit(0), exprs)
    first = ends["a"] - left if left is not None else 0
    reach_ = calendar.where(F.col("idx").between(first, ends["b"] + right)).agg(F.min("datetime").alias("a"), F.max("datetime").alias("b")).first()
    padded = panel.where(F.col("datetime").between(F.lit(reach_["a"]), F.lit(reach_["b"])))
    if "period" in panel.columns:
        padded = padded.where(F.col("period").between(reach_["a"].year, reach_["b"].year))
    return evaluate(padded, exprs).where(F.col("datetime").between(a, b))


def nested_load(frames: list[DataFrame], how: str = "left") -> DataFrame:
    """M3: later frames replace columns of the same name, then join on the keys."""
    out = frames[0]
    for df in frames[1:]:
        out = out.drop(*[c for c in df.columns if c not in ("instrument", "datetime")]).join(df, ["instrument", "datetime"], how)
    return out


def align_to(anchor: DataFrame, *frames: DataFrame) -> DataFrame:
    """M4: several frames on the anchor's keys."""
    for df in frames:
        anchor = anchor.join(df, ["instrument", "datetime"], "left")
    return anchor


def nearest_frequency(stored: list[str], wanted: str) -> str:
    """M5: the wanted frequency, else the coarsest stored one that is not coarser than it."""
    order = {"1min": 0, "5min": 1, "15min": 2, "30min": 3, "60min": 4, "day": 5, "week": 6, "month": 7}
    fits = [f for f in stored if order[f] <= order[wanted]]
    if not fits:
        raise ValueError(f"no stored frequency serves {wanted}")
    return max(fits, key=order.__getitem__)


def fetch(df: DataFrame, start=None, end=None, instruments: list[str] | None = None, group: str | None = None) -> DataFrame:
    """M6: rows by time range and instruments, columns of a group."""
    if start is not None:
        df = df.where(F.col("datetime") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("datetime") <= F.lit(end).cast("timestamp"))
    if instruments is not None:
        df = df.where(F.col("instrument").isin(instruments))
    return df.select("instrument", "datetime", *[c for c in df.columns if c.startswith(f"{group}__")]) if group else df


def trailing_ranges(df: DataFrame, periods: int) -> DataFrame:
    """M7: for every date the rows of its last ``periods`` distinct dates, as (as_of, ...)."""
    dates = df.select("datetime").distinct().withColumn("_i", F.row_number().over(W.orderBy("datetime")))
    last = dates.agg(F.max("_i").alias("_top"))
    reachable = dates.crossJoin(F.broadcast(last)).withColumn("_at", F.explode(F.sequence(F.col("_i"), F.least(F.col("_i") + periods - 1, F.col("_top")))))
    to = dates.select(F.col("_i").alias("_at"), F.col("datetime").alias("as_of"))
    return df.join(reachable.join(to, "_at").select("datetime", "as_of"), "datetime")


def split_scores(df: DataFrame, number: int | None = None, split_date=None) -> DataFrame:
    """M9: a column ``part`` (left, right) by a date, or after the first ``number`` dates."""
    if split_date is None:
        dates = df.select("datetime").distinct().withColumn("_i", F.row_number().over(W.orderBy("datetime")))
        return df.join(dates, "datetime").withColumn("part", F.when(F.col("_i") <= number, "left").otherwise("right")).drop("_i")
    return df.withColumn("part", F.when(F.col("datetime") <= F.lit(split_date).cast("timestamp"), "left").otherwise("right"))


def segments(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """O1: rows labelled by the inclusive date ranges that hold them."""
    marks = F.array(*[F.when(F.col("datetime").between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")), F.lit(n)) for n, (a, b) in ranges.items()])
    return df.withColumn("segment", F.explode(F.array_compact(marks)))


def sequence_samples(df: DataFrame, cols: list[str], step: int, fill: str | None = None, flag: str | None = None) -> DataFrame:
    """O2, O3: per row the last ``step`` slots of the features, padded in front; ``flag`` chooses sample rows, not history.

    A slot without any of the features is empty.  ``fill`` (ffill or ffill+bfill) puts the last filled slot of the same
    window, then the next one, in its place; values that a filled slot lacks stay missing.
    """
    by = W.partitionBy("instrument").orderBy("datetime")
    item = F.struct(*[F.col(c).cast("double").alias(c) for c in cols])
    past = F.collect_list(item).over(by.rowsBetween(1 - step, 0))
    empty = F.struct(*[F.lit(None).cast("double").alias(c) for c in cols])
    out = df.withColumn("sample", F.concat(F.array_repeat(empty, F.lit(step) - F.size(past)), past))
    if fill:
        there = lambda x: F.coalesce(*[x[c] for c in cols]).isNotNull()
        filled = lambda part: F.filter(part, there)
        back = lambda x, i: F.when(there(x), x).otherwise(F.try_element_at(filled(F.slice("sample", F.lit(1), i + 1)), F.lit(-1)))
        ahead = lambda x, i: F.when(there(x), x).otherwise(F.try_element_at(filled(F.slice("sample", i + 1, F.lit(step))), F.lit(1)))
        out = out.withColumn("sample", F.transform("sample", lambda x, i: F.coalesce(back(x, i), empty)))
        if fill == "ffill+bfill":
            out = out.withColumn("sample", F.transform("sample", lambda x, i: F.coalesce(ahead(x, i), empty)))
    return (out.where(F.col(flag)) if flag else out).select("instrument", "datetime", "sample")


def row_sequences(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of the instrument as arrays, zeros in front."""
    by = W.partitionBy("instrument").orderBy("datetime").rowsBetween(1 - n, 0)
    item = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    past = F.collect_list(item).over(by)
    zero = F.struct(*[F.lit(0.0).alias(c) for c in cols])
    return df.withColumn("sample", F.concat(F.array_repeat(zero, F.lit(n) - F.size(past)), past)).select("instrument", "datetime", "sample")


def daily_batches(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Up to ``n`` samples of each date, chosen by a hash."""
    place = F.md5(F.concat_ws(":", "instrument", F.unix_micros(F.col("datetime").cast("timestamp")).cast("string"), F.lit(str(seed))))
    order = W.partitionBy("datetime").orderBy(place, "instrument")
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def rolling_splits(cal: DataFrame, train: tuple[int, int], valid: tuple[int, int], test: tuple[int, int], step: int, expanding: bool = False, gap: int = 0) -> DataFrame:
    """Folds (fold, segment, start_idx, end_idx) of calendar positions, shifted by ``step``.

    Expanding folds keep the first train start; ``gap`` (days, or horizon plus leak) cuts the segments
    before the test to end that far before it.
    """
    top = cal.agg(F.max("idx").alias("_top"))
    folds = top.select("_top", F.explode(F.sequence(F.lit(0), F.floor((F.col("_top") - test[0]) / step))).alias("fold"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for n, (a, b) in (("train", train), ("valid", valid), ("test", test))]))
    shift = F.col("fold") * step
    out = folds.select("fold", "_top", shift.alias("_by"), rows.alias("s"))
    start = F.col("s.a") + (F.when(F.col("s.segment") == "train", F.lit(0)).otherwise(F.col("_by")) if expanding else F.col("_by"))
    end = F.col("s.b") + F.col("_by")
    cut = F.least(end, F.lit(test[0] - 1 - gap) + F.col("_by")) if gap else end
    end = F.least(F.when(F.col("s.segment") == "test", end).otherwise(cut), F.col("_top"))
    return out.select(F.col("fold").cast("long").alias("fold"), "s.segment", start.cast("long").alias("start_idx"), end.cast("long").alias("end_idx")).where("start_idx <= end_idx")


def fold_moments(raw: DataFrame, ranges: DataFrame, cols: list[str]) -> DataFrame:
    """For each fold of ``ranges`` (fold, start_idx, end_idx) and column c: n_c, mean_c, var_c (population), min_c and max_c.

    Rows are reduced to one row of mergeable moments a calendar position first; folds combine those, so what they share is
    computed once.  Squares are about the column's overall mean, which keeps their digits.
    """
    parts = [a for c in cols for x in [F.col(c)] for a in (F.count(x).alias(f"n_{c}"), F.avg(x).alias(f"m_{c}"), (F.var_pop(x) * F.count(x)).alias(f"q_{c}"), F.min(x).alias(f"a_{c}"), F.max(x).alias(f"b_{c}"))]
    days = written(raw.groupBy("idx").agg(*parts))
    centre = days.agg(*[(F.sum(F.col(f"n_{c}") * F.col(f"m_{c}")) / F.sum(f"n_{c}")).alias(f"o_{c}") for c in cols])
    reached = ranges.select("fold", F.explode(F.sequence("start_idx", "end_idx")).alias("idx")).join(days, "idx").crossJoin(F.broadcast(centre))  # one row
    made = []
    for c in cols:
        n, off = F.sum(f"n_{c}"), F.col(f"m_{c}") - F.col(f"o_{c}")
        shift = F.sum(F.col(f"n_{c}") * off) / n
        spread = F.sum(F.coalesce(F.col(f"q_{c}"), F.lit(0.0)) + F.col(f"n_{c}") * F.coalesce(off * off, F.lit(0.0))) / n - shift * shift
        made += [n.alias(f"n_{c}"), (shift + F.max(f"o_{c}")).alias(f"mean_{c}"), F.greatest(spread, F.lit(0.0)).alias(f"var_{c}"), F.min(f"a_{c}").alias(f"min_{c}"), F.max(f"b_{c}").alias(f"max_{c}")]
    return reached.groupBy("fold").agg(*made)


#: Fits of ``refit_per_fold`` from a fold's moments.
FITS = {
    "count": lambda c: F.col(f"n_{c}"), "mean": lambda c: F.col(f"mean_{c}"), "std_pop": lambda c: F.sqrt(f"var_{c}"), "min": lambda c: F.col(f"min_{c}"), "max": lambda c: F.col(f"max_{c}"),
    "std": lambda c: F.sqrt(F.col(f"var_{c}") * F.col(f"n_{c}") / F.nullif(F.col(f"n_{c}") - 1, F.lit(0))),
}


def refit_per_fold(raw: DataFrame, folds: DataFrame, fits: dict[str, tuple[str, str]], apply: dict[str, Column], fit_on: str = "train", segments: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of every fold's ``segments`` (all by default), transformed with parameters fitted on that fold's own range.

    ``raw`` (instrument, datetime, idx, ...) is computed once; ``folds`` are those of ``rolling_splits``.  ``fits`` name (kind, column) of
    ``FITS`` over the fold's ``fit_on`` segment and ``apply`` makes columns from them.  Rows are joined to folds for the segments
    that come out alone.
    """
    moments = fold_moments(raw, folds.where(F.col("segment") == fit_on), sorted({c for _, c in fits.values()}))
    params = moments.select("fold", *[FITS[kind](c).alias(n) for n, (kind, c) in fits.items()])
    wanted = folds.where(F.col("segment").isin(*segments)) if segments else folds
    rows = raw.join(wanted.select("fold", "segment", F.explode(F.sequence("start_idx", "end_idx")).alias("idx")), "idx")
    return rows.join(params, "fold").withColumns(apply).drop(*fits)


def reweight(df: DataFrame, weight: Column) -> DataFrame:
    """One weight per row from the user's expression; a missing or negative one counts as 0."""
    return df.withColumn("weight", F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0)))
