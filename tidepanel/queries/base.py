"""Shared frames of the queries and their common SQL."""

from __future__ import annotations

import hashlib
import inspect
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.sources import store, tables
from tidepanel.sources.scratch import changed_at, move, scratch_dir
from tidepanel.sources.store import StoredPanel, open_panel, save_panel
from tidepanel.sources.tables import read

SHIFT = 0.03711
def by_time():
    return W.partitionBy("instrument").orderBy("datetime")


BARS = """
b0 AS (SELECT p_brand AS instrument, l_shipdate AS datetime, l_extendedprice / l_quantity AS price, l_quantity AS q, l_extendedprice AS e,
  l_orderkey AS a1, l_linenumber AS a2, l_partkey AS a3, l_suppkey AS a4 FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS MATERIALIZED (SELECT instrument, datetime, first(price ORDER BY a1, a2, a3, a4, q, e) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY a1, a2, a3, a4, q, e) AS close, sum(e) / sum(q) AS vwap, sum(q) AS volume FROM b0 GROUP BY ALL),
cal AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS idx FROM (SELECT DISTINCT datetime FROM bars)),
sp AS (SELECT instrument, min(datetime) AS a, max(datetime) AS b FROM bars GROUP BY 1),
panel AS MATERIALIZED (SELECT sp.instrument, cal.datetime, cal.idx, open, high, low, close, vwap, volume,
  row_number() OVER (PARTITION BY sp.instrument ORDER BY cal.datetime) AS slot
  FROM sp JOIN cal ON cal.datetime BETWEEN sp.a AND sp.b LEFT JOIN bars ON bars.instrument = sp.instrument AND bars.datetime = cal.datetime),
scores AS MATERIALIZED (SELECT * FROM (SELECT instrument, datetime, idx, vwap / close - 1 AS score, lead(close, 2) OVER w / lead(close, 1) OVER w - 1 AS label, close, volume
  FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY datetime)) WHERE score IS NOT NULL)"""

TICKS = "ticks AS (SELECT event_type AS instrument, ts AS datetime, event_id, value FROM events)"


#: Panels that this session has opened, by their path.
_opened: dict[tuple[str, str], StoredPanel] = {}


def stored(spark: SparkSession, sf_dir: str) -> StoredPanel:
    """The panel of brands, stored by the first query that asks for it; later ones, also of later sessions, open it.

    Its folder is named by what it is made of: the tables' path and times, the number of buckets and the code that makes it.
    """
    code = inspect.getsource(tables) + inspect.getsource(store)
    made_of = [sf_dir, *[changed_at(spark, f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem")], spark.conf.get("spark.sql.shuffle.partitions"), code]
    path = f"{scratch_dir(spark)}/panel-{hashlib.md5(repr(made_of).encode()).hexdigest()}"
    key = (spark.sparkContext.applicationId, path)
    if changed_at(spark, f"{path}/layout/_SUCCESS") is None:
        made = save_panel(tables.brand_bars(spark, sf_dir), f"{path}-{uuid.uuid4().hex}")
        move(spark, made.path, path)
        _opened.pop(key, None)
    if key not in _opened:
        _opened[key] = open_panel(spark, path)
    return StoredPanel(spark, path, _opened[key].name)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).bars()


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).panel()


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores (vwap over close - 1) with the next-but-one return as label, on traded days."""
    p = panel(spark, sf_dir)
    label = F.lead("close", 2).over(by_time()) / F.lead("close", 1).over(by_time()) - 1
    return p.withColumns({"label": label, "score": F.col("vwap") / F.col("close") - 1}).where("score IS NOT NULL").select("instrument", "datetime", "idx", "score", "label", "close", "volume")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("instrument"), F.col("ts").alias("datetime"), "event_id", "value")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily series (datetime, return, bench, cost, turnover) from mean bars; returns are small differences."""
    b = bars(spark, sf_dir)
    day = b.groupBy("datetime").agg(F.avg(F.col("close") / F.col("open") - 1).alias("return"), F.avg(F.col("vwap") / F.col("open") - 1).alias("bench"), F.sum("volume").alias("turnover"))
    return day.withColumn("cost", F.lit(0.001))


MARKET = "market AS (SELECT datetime, avg(close / open - 1) AS ret, avg(vwap / open - 1) AS bench, sum(volume) AS turnover, 0.001::DOUBLE AS cost FROM bars GROUP BY 1)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero, so that sums of another order compare equal.

    A small shift before keeps exact halves, which prices often are, from being rounded either way.
    """
    return df.select(*[(F.round(F.col(f"`{c}`") + F.lit(SHIFT / 10**digits), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def sql(inner: str, keys: list[str] | str, doubles: list[str] | str = (), ctes: str = BARS, digits: int = 6) -> str:
    keys = keys.split() if isinstance(keys, str) else keys
    doubles = doubles.split() if isinstance(doubles, str) else doubles
    columns = ", ".join([f'"{k}"' for k in keys] + [f'round("{d}" + {SHIFT / 10**digits:.12f}, {digits}) + 0 AS "{d}"' for d in doubles])
    return f"WITH {ctes}\nSELECT {columns} FROM ({inner})"
