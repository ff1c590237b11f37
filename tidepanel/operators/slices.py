"""Trailing time frames and carried values of long series, cut into slices of time so that no task holds a whole series.

A slice gets the rows of the frame before it as a halo, which are dropped again; a last value goes from slice to slice through a
table of one row a slice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE, HALO = "_slice", "_halo"
#: Frames that a slice is long.
FRAMES = 8


def micros(time: str = "datetime") -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def frame(seconds: float) -> WindowSpec:
    """(t - seconds, t] within a slice."""
    return W.partitionBy("instrument", SLICE).orderBy(micros()).rangeBetween(-int(seconds * 1_000_000) + 1, 0)


def over_slices(df: DataFrame, seconds: float, make: Callable[[DataFrame], DataFrame], length: float | None = None) -> DataFrame:
    """``make`` adds columns by ``frame`` windows of ``seconds`` at most; partitions are (instrument, slice of ``length`` seconds).

    A slice is as long as the longest frame at least, so what a row sees lies in its own slice or the one before.
    """
    reach = int(seconds * 1_000_000)
    size = max(reach, int((length or FRAMES * seconds) * 1_000_000), 1)
    at = F.floor(micros() / F.lit(size))
    own = F.struct(at.alias("s"), F.lit(False).alias("h"))
    late = micros() > (at + 1) * F.lit(size) - F.lit(reach)
    places = F.when(late, F.array(own, F.struct((at + 1).alias("s"), F.lit(True).alias("h")))).otherwise(F.array(own))
    rows = df.withColumn("_at", F.explode(places)).withColumns({SLICE: F.col("_at.s"), HALO: F.col("_at.h")}).drop("_at")
    return make(rows).where(~F.col(HALO)).drop(SLICE, HALO)


def frame_counts(df: DataFrame, whole: dict[str, Column], seconds: dict[str, float]) -> DataFrame:
    """A row an instant of an instrument: columns ``<name>`` with the sum of the whole numbers ``whole[name]`` of its rows,
    and ``<name>_<frame>`` with that of all rows in (t - seconds[frame], t].

    An instant's numbers enter at its time and leave a frame later, so one running sum over both is the frame's sum, exact as
    the numbers are whole; rows cost the same however many a frame holds.
    """
    instants = df.groupBy("instrument", "datetime").agg(*[F.sum(x.cast("long")).alias(n) for n, x in whole.items()])
    reach = {k: int(s * 1_000_000) for k, s in seconds.items()}
    most = max(1, *reach.values())
    size = FRAMES * most
    at = F.floor(micros() / F.lit(size))
    late = micros() > (at + 1) * F.lit(size) - F.lit(most)
    # the instant itself in its slice, in the next one where a frame begins in this one, and its end for each frame
    parts = [F.struct(at.alias("s"), micros().alias("t"), F.lit("").alias("end"), F.lit(True).alias("own"))]
    parts += [F.when(late, F.struct((at + 1).alias("s"), micros().alias("t"), F.lit("").alias("end"), F.lit(False).alias("own")))]
    for k, r in reach.items():
        gone = micros() + F.lit(r)
        parts += [F.when(F.floor(gone / F.lit(size)) == at, F.struct(at.alias("s"), gone.alias("t"), F.lit(k).alias("end"), F.lit(False).alias("own")))]
        parts += [F.when(late, F.struct((at + 1).alias("s"), gone.alias("t"), F.lit(k).alias("end"), F.lit(False).alias("own")))]
    rows = instants.withColumn("_at", F.explode(F.array(*parts))).where("_at IS NOT NULL")
    w = W.partitionBy("instrument", "_at.s").orderBy("_at.t").rangeBetween(W.unboundedPreceding, W.currentRow)
    change = lambda n, k: F.when(F.col("_at.end") == "", F.col(n)).when(F.col("_at.end") == k, -F.col(n)).otherwise(0)
    rows = rows.withColumns({f"{n}_{k}": F.sum(change(n, k)).over(w) for n in whole for k in reach})
    return rows.where("_at.own").drop("_at")


#: How totals of two parts of a frame become one.
TOTALS = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": F.least, "max": F.greatest}


def frame_totals(df: DataFrame, seconds: float, totals: dict[str, tuple[str, Column]], first: dict[str, Column] | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with totals (sum, count, min or max of a column) of (t - seconds, t], and the ``first`` values there; of rows of one time the first is the least by ``order``.

    Time is cut into blocks as long as a frame.  A frame is the end of a block and the beginning of the next one, whose
    running totals backward and forward are made once and met by merging times; nothing is subtracted, and rows cost the same
    however many a frame holds.
    """
    first = first or {}
    size = max(1, int(seconds * 1_000_000))
    fields = df.columns
    rows = df.withColumns({"_t": micros(), "_b": F.floor(micros() / F.lit(size))}).withColumns({f"_x_{n}": x for n, (_, x) in totals.items()} | {f"_x_{n}": x for n, x in first.items()})
    block = W.partitionBy("instrument", "_b")
    ties = [F.col(c) for c in order]
    so_far = {f"_p_{n}": getattr(F, kind)(f"_x_{n}").over(block.orderBy("_t")) for n, (kind, _) in totals.items()}
    so_far |= {f"_p_{n}": F.first(f"_x_{n}").over(block.orderBy("_t", *ties)) for n in first}
    rows = rows.withColumns(so_far)
    rows = rows.withColumns({f"_s_{n}": getattr(F, kind)(f"_x_{n}").over(block.orderBy(F.desc("_t"))) for n, (kind, _) in totals.items()} | {f"_s_{n}": F.col(f"_x_{n}") for n in first})
    # a row's backward total holds for the times of the next block that lie less than a frame after it
    names = [*totals, *first]
    own = F.struct(F.col("_b").alias("b"), F.col("_t").alias("t"), F.lit(False).alias("end"))
    end = F.struct((F.col("_b") + 1).alias("b"), (F.col("_t") + F.lit(size)).alias("t"), F.lit(True).alias("end"))
    rows = rows.withColumn("_at", F.explode(F.array(own, end)))
    last = F.when(F.col("_at.end"), F.struct(*[F.col(f"_s_{n}").alias(n) for n in names]))
    merged = W.partitionBy("instrument", "_at.b").orderBy(F.desc("_at.t"), "_at.end", *[c.desc() for c in ties]).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_before", F.last(last, True).over(merged)).where("NOT _at.end")
    made = {n: TOTALS[kind](F.col(f"_before.{n}"), F.col(f"_p_{n}")) for n, (kind, _) in totals.items()}
    made |= {n: F.when(F.col("_before").isNotNull(), F.col(f"_before.{n}")).otherwise(F.col(f"_p_{n}")) for n in first}
    return rows.select(*fields, *[x.alias(n) for n, x in made.items()])


def with_slice(df: DataFrame, seconds: float, time: str = "datetime") -> DataFrame:
    return df.withColumn(SLICE, F.floor(micros(time) / F.lit(max(1, int(seconds * 1_000_000)))))


def carried(df: DataFrame, cols: list[str], seconds: float, time: str = "datetime") -> DataFrame:
    """Missing values of ``cols`` become the last present one of their instrument, however long ago."""
    rows = with_slice(df, seconds, time)
    last = rows.groupBy("instrument", SLICE).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(f"_last_{c}") for c in cols])
    before = W.partitionBy("instrument").orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)  # a row a slice
    last = last.select("instrument", SLICE, *[F.last(f"_last_{c}", True).over(before).alias(f"_last_{c}") for c in cols])
    w = W.partitionBy("instrument", SLICE).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(last, ["instrument", SLICE])
    return rows.withColumns({c: F.coalesce(F.last(c, True).over(w), F.col(f"_last_{c}")) for c in cols}).select(*df.columns)


def previous(df: DataFrame, cols: list[str], seconds: float, time: str = "datetime") -> DataFrame:
    """Columns ``_before_<c>`` of the instrument's row before, in its slice or the last one that has rows."""
    rows = with_slice(df, seconds, time)
    item = F.struct(*cols)
    ends = rows.groupBy("instrument", SLICE).agg(F.max_by(item, time).alias("_end"))
    ends = ends.select("instrument", SLICE, F.lag("_end").over(W.partitionBy("instrument").orderBy(SLICE)).alias("_end"))
    w = W.partitionBy("instrument", SLICE).orderBy(time)
    rows = rows.join(ends, ["instrument", SLICE]).withColumn("_row", F.when(F.row_number().over(w) == 1, F.col("_end")).otherwise(F.lag(item).over(w)))
    return rows.select(*df.columns, *[F.col(f"_row.{c}").alias(f"_before_{c}") for c in cols])


def following(df: DataFrame, col: str, steps: tuple[int, ...], step_seconds: float, time: str = "datetime", length: float | None = None) -> DataFrame:
    """Columns ``_after_<n>``: the value ``n`` steps on, of a series that has a row for every step."""
    most = max(steps) * step_seconds
    size = max(1, int(max(most, length or FRAMES * most) * 1_000_000))
    at = F.floor(micros(time) / F.lit(size))
    own = F.struct(at.alias("s"), F.lit(False).alias("h"))
    early = micros(time) <= at * F.lit(size) + F.lit(int(most * 1_000_000))
    places = F.when(early, F.array(own, F.struct((at - 1).alias("s"), F.lit(True).alias("h")))).otherwise(F.array(own))
    rows = df.withColumn("_at", F.explode(places)).withColumns({SLICE: F.col("_at.s"), HALO: F.col("_at.h")}).drop("_at")
    w = W.partitionBy("instrument", SLICE).orderBy(time)
    return rows.withColumns({f"_after_{n}": F.lead(col, n).over(w) for n in steps}).where(~F.col(HALO)).drop(SLICE, HALO)
