"""Streaming form of bucket resampling: late ticks within the watermark are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def resample_stream(ticks: DataFrame, width: str, late: str, aggregates: dict[str, Column]) -> DataFrame:
    """Left-closed buckets (instrument, datetime) of a stream of ticks; buckets older than ``late`` are final."""
    bucket = F.window("datetime", width)
    found = ticks.withWatermark("datetime", late).groupBy("instrument", bucket.alias("_w")).agg(*[a.alias(n) for n, a in aggregates.items()])
    return found.select("instrument", F.col("_w.start").alias("datetime"), *aggregates)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream, with the schema that it has now; as a pattern, since a stream of one file must be one."""
    path = path.rstrip("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Take what is there now, write the final rows below ``path`` and read them; a later call goes on where this one ended."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
