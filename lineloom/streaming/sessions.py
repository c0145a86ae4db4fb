"""Extension: sessions of events, over a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """(user_id, start, end, n, value): a session ends when nothing comes for ``gap``. For a stream give a watermark."""
    rows = events.withColumn("_t", F.to_timestamp(F.col("ts").cast("string")))
    if watermark:
        rows = rows.withWatermark("_t", watermark)
    out = rows.groupBy("user_id", F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    return out.select("user_id", ntz("w.start").alias("start"), ntz("w.end").alias("end"), "n", "value")


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)
