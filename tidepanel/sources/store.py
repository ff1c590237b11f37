"""A panel that is built once: bars, calendar, spans and the aligned panel as written tables that queries read by range.

The panel is partitioned by year and bucketed by instrument.  A query of a range of dates reads the years of it only, with
the dates pushed to the scan, and its windows need no exchange, as a bucket holds all rows of its instruments.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepanel.functions.expressions import SLOT
from tidepanel.sources.tables import aligned, calendar_of

PERIOD = "period"


@dataclass(frozen=True)
class StoredPanel:
    """Tables below ``path``; the panel is also the session's table ``name``, as a path alone doesn't tell its buckets."""

    spark: SparkSession
    path: str
    name: str

    def bars(self) -> DataFrame:
        """The bars as they came, one row kept of repeated keys."""
        return self.spark.read.parquet(f"{self.path}/bars")

    def calendar(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/calendar")

    def spans(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/spans")

    def rows(self) -> DataFrame:
        """The aligned panel with each row's slot and period."""
        return self.spark.table(self.name)

    def panel(self) -> DataFrame:
        """The aligned panel: instrument, datetime, idx and the fields."""
        return self.rows().drop(SLOT, PERIOD)


def save_panel(bars: DataFrame, path: str, buckets: int | None = None) -> StoredPanel:
    """Write bars (instrument, datetime, fields ...) and the panel made of them, which reads the written bars.

    ``buckets`` (the session's shuffle partitions by default) bounds how many tasks share an instrument-wise query.
    """
    spark = bars.sparkSession
    bars.dropDuplicates(["instrument", "datetime"]).write.parquet(f"{path}/bars")
    bars = spark.read.parquet(f"{path}/bars")
    calendar_of(bars).write.parquet(f"{path}/calendar")
    rows, spans = aligned(bars, spark.read.parquet(f"{path}/calendar"))
    spans.write.parquet(f"{path}/spans")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = [c for c in bars.columns if c not in ("instrument", "datetime")]
    rows = rows.select("instrument", "datetime", "idx", *fields, SLOT, F.year("datetime").alias(PERIOD))
    name = f"panel_{uuid.uuid4().hex}"
    # one writer a bucket, so that a bucket of a year is one file
    laid = rows.repartition(buckets, "instrument").sortWithinPartitions(PERIOD, "instrument", "datetime")
    laid.write.partitionBy(PERIOD).bucketBy(buckets, "instrument").sortBy("instrument", "datetime").option("path", f"{path}/panel").saveAsTable(name)
    spark.createDataFrame([(buckets, rows.drop(PERIOD).schema.json())], "buckets int, schema string").coalesce(1).write.parquet(f"{path}/layout")
    return StoredPanel(spark, path, name)


def open_panel(spark: SparkSession, path: str) -> StoredPanel:
    """A panel that an earlier session saved."""
    layout = spark.read.parquet(f"{path}/layout").first()
    name = f"panel_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(layout["schema"])).fields)
    spark.sql(
        f"CREATE TABLE {name} ({columns}, {PERIOD} INT) USING parquet PARTITIONED BY ({PERIOD}) "
        f"CLUSTERED BY (instrument) SORTED BY (instrument, datetime) INTO {layout['buckets']} BUCKETS LOCATION '{path}/panel'"
    )
    spark.catalog.recoverPartitions(name)
    return StoredPanel(spark, path, name)
