"""Panels from the star-schema tables, and reading and writing of bars, calendars and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.sources.scratch import written

FIELDS = ("open", "high", "low", "close", "vwap", "volume")
METRICS = ("account", "return", "total_turnover", "turnover", "total_cost", "cost", "value", "cash", "bench")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_bars(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A1: bars from CSV (with a header) or Parquet, by suffix."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else reader.parquet(path)


def select_fields(df: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """The included fields, else all but the excluded ones."""
    return df.select(*include) if include else df.drop(*exclude)


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (instrument, datetime, open ...) of part brands by ship date.  The order within a day is by the row's own values."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("instrument"))
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return item_bars(item.join(part, item.l_partkey == part.p_partkey))


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of suppliers."""
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return item_bars(item.withColumn("instrument", F.col("l_suppkey").cast("string")))


def item_bars(rows: DataFrame) -> DataFrame:
    """Daily bars of line items with an ``instrument``.

    Totals and the first and last order of a day need no sort of the items.  The order by all values, which needs one, is
    taken over the items of these two orders, so items are read twice.
    """
    rows = rows.withColumns({"price": F.col("l_extendedprice") / F.col("l_quantity"), "_key": F.coalesce("l_orderkey", F.lit(-(2**63)))})
    totals = written(rows.groupBy("instrument", F.col("l_shipdate").alias("datetime")).agg(
        F.max("price").alias("high"), F.min("price").alias("low"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"), F.sum("l_quantity").alias("volume"),
        F.min("_key").alias("_first"), F.max("_key").alias("_last"),
    ))
    days = totals.select(F.col("instrument").alias("_i"), F.col("datetime").alias("_d"), "_first", "_last")
    same = rows["instrument"].eqNullSafe(days["_i"]) & rows["l_shipdate"].eqNullSafe(days["_d"]) & ((F.col("_key") == F.col("_first")) | (F.col("_key") == F.col("_last")))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    keys = days.select(F.explode(F.array("_first", "_last")).alias("_k")).distinct()
    ends = rows.join(keys, F.col("_key") == F.col("_k"), "left_semi").join(days, same).groupBy("_i", "_d").agg(F.min_by("price", order).alias("open"), F.max_by("price", order).alias("close"))
    bars = totals.join(ends, totals["instrument"].eqNullSafe(ends["_i"]) & totals["datetime"].eqNullSafe(ends["_d"]))
    return bars.select("instrument", "datetime", *FIELDS)


def calendar_of(bars: DataFrame) -> DataFrame:
    """Distinct sorted times with their position (datetime, idx from 0).  A calendar has one row per slot, so one global window numbers it."""
    return bars.select("datetime").distinct().withColumn("idx", (F.row_number().over(W.orderBy("datetime")) - 1).cast("long"))


def spans_of(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"))


def aligned(bars: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every instrument on all slots between its own first and last, its span).  Rows have their ``_slot``, from 1.

    Bars get their calendar position once; an instrument's least and largest are its span, which is laid out as a
    sequence, so no range join is planned.  ``bars`` is read twice: pass a stored table.
    """
    at = calendar.select("datetime", "idx")
    ends = bars.join(at, "datetime").groupBy("instrument").agg(F.min("idx").alias("_start"), F.max("idx").alias("_end"), F.min("datetime").alias("start"), F.max("datetime").alias("end"))
    slot = (F.col("idx") - F.col("_start") + 1).cast("int").alias("_slot")
    grid = ends.select("instrument", "_start", F.explode(F.sequence("_start", "_end")).alias("idx")).join(at, "idx").select("instrument", "datetime", "idx", slot)
    return grid.join(bars, ["instrument", "datetime"], "left"), ends.select("instrument", "start", "end")


def align_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """A5: every instrument on all slots between its own first and last; gaps have missing fields."""
    return aligned(bars, calendar)[0].drop("_slot")


def build_panel(bars: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A2: (calendar, spans, aligned panel) of raw bars, one row kept of repeated keys."""
    bars = bars.dropDuplicates(["instrument", "datetime"])
    calendar = calendar_of(bars)
    return calendar, spans_of(bars), align_calendar(bars, calendar)


def add_instruments(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """A3: stored spans and those of the instruments not stored yet."""
    return spans.unionByName(spans_of(bars).join(spans, "instrument", "left_anti"))


def append_panel(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: the rows to append (known instruments after their stored end, new ones whole) and the new span table."""
    spans = spans_of(stored)
    fresh = new.join(spans.select("instrument", F.col("end").alias("_end")), "instrument", "left").where("_end IS NULL OR datetime > _end").drop("_end")
    return fresh, spans.unionByName(spans_of(fresh)).groupBy("instrument").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def append_pit(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Revisions published after the last stored one of their instrument and field."""
    last = stored.groupBy("instrument", "field").agg(F.max("publish_date").alias("_last"))
    return new.join(last, ["instrument", "field"], "left").where("_last IS NULL OR publish_date > _last").drop("_last")


def load_groups(groups: dict[str, DataFrame], how: str = "outer") -> DataFrame:
    """Several frames side by side on (instrument, datetime), columns prefixed by group."""
    out = None
    for name, df in groups.items():
        df = df.select("instrument", "datetime", *[F.col(c).alias(f"{name}__{c}") for c in df.columns if c not in ("instrument", "datetime")])
        out = df if out is None else out.join(df, ["instrument", "datetime"], how)
    return out


def compare_tables(source: DataFrame, stored: DataFrame, abs_tol: float = 1e-8, rel_tol: float = 1e-5) -> DataFrame:
    """Per instrument of the source, true or false on the stored keys, null when it isn't stored."""
    fields = [c for c in stored.columns if c not in ("instrument", "datetime")]
    both = stored.join(source.select("instrument", "datetime", *[F.col(c).alias(f"_{c}") for c in fields]), ["instrument", "datetime"], "left")
    near = lambda c: F.col(c).eqNullSafe(F.col(f"_{c}")) | F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= abs_tol + rel_tol * F.abs(c), F.lit(False))
    same = near(fields[0])
    for c in fields[1:]:
        same = same & near(c)
    verdict = both.groupBy("instrument").agg(F.bool_and(same).alias("same"))
    return source.select("instrument").distinct().join(verdict, "instrument", "left")


def save_metrics(df: DataFrame, path: str) -> None:
    """A10: the portfolio report as CSV."""
    df.write.mode("overwrite").option("header", True).csv(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("datetime TIMESTAMP, " + ", ".join(f"`{c}` DOUBLE" for c in METRICS)).csv(path)


def export_samples(panel: DataFrame, path: str, by: str = "date") -> None:
    """One unit per day or instrument; units that exist are left as they are."""
    panel = panel.withColumn("date", F.to_date("datetime")) if by == "date" else panel
    spark = panel.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        panel = panel.join(spark.read.parquet(path).select(by).distinct(), by, "left_anti")
    panel.write.mode("append").partitionBy(by).parquet(path)
