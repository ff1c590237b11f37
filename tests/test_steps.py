"""Plans whose tasks hold few sorts, with the results of the plain definitions."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidepanel.operators import processors
from tidepanel.sources import tables

T0 = datetime(1997, 3, 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_section_norm_keeps_few_sorts_in_a_task(spark):
    x = spark.range(400).select(
        F.concat(F.lit("i"), (F.col("id") % 20).cast("string")).alias("instrument"), (F.lit(T0) + F.make_dt_interval((F.col("id") / 20).cast("int"))).alias("datetime"),
        *[F.rand(k).alias(c) for k, c in enumerate(("STD5", "KMID", "KLOW2", "MAX5", "WVMA5", "CORR5", "label"))])
    found = processors.section_norm(x, ["STD5", "KMID", "KLOW2", "MAX5", "WVMA5", "CORR5"], ["label"])
    assert plan_of(found).count("Sort [") <= 4
    assert found.columns == x.columns and found.count() == 400


def test_bars_of_many_items_are_made_without_sorting_them(spark):
    """Keys that repeat, missing keys, numbers and dates; the first and last by all values."""
    items = spark.range(3000).select(
        F.when(F.col("id") % 97 > 0, F.concat(F.lit("i"), (F.col("id") % 3).cast("string"))).alias("instrument"),
        F.when(F.col("id") % 89 > 0, F.lit(T0) + F.make_dt_interval((F.col("id") % 4).cast("int"))).alias("l_shipdate"),
        F.when(F.col("id") % 13 > 0, F.hash("id") % 40).cast("long").alias("l_orderkey"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).cast("int").alias("l_linenumber"),
        (F.col("id") % 11).alias("l_partkey"), (F.col("id") % 2).alias("l_suppkey"), (1 + F.col("id") % 50).cast("double").alias("l_quantity"), (F.rand(3) * 900).alias("l_extendedprice"))
    items = items.where("NOT (l_orderkey IS NULL AND instrument = 'i1')").localCheckpoint()
    found = tables.item_bars(items)
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    want = items.groupBy("instrument", F.col("l_shipdate").alias("datetime")).agg(F.min_by(price, order), F.max(price), F.min(price), F.max_by(price, order), F.sum("l_quantity"))
    assert found.columns == ["instrument", "datetime", *tables.FIELDS]
    assert sorted(map(repr, map(tuple, found.drop("vwap").collect()))) == sorted(map(repr, map(tuple, want.collect())))
    # what is sorted are the items of the first and last orders, below which stands the join with these
    text = plan_of(found)
    assert "SortAggregate" not in text or text.index("SortAggregate") < text.rindex("Join")
