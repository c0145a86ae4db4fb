"""Sinks (K1, K3, K5, K7, S14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_json(df: DataFrame, key: str, value: str, group: str | None = None) -> DataFrame:
    """K1, E5: one JSON object of key to value (a row each ``group``), keys in string order. Of repeated keys the largest value stays.
    An object is one value, so a group's keys come together in one task."""
    by = [group] if group else []
    one = df.groupBy(*by, F.col(key).cast("string").alias("k")).agg(F.max(value).alias("v"))
    whole = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))))
    return one.groupBy(*by).agg(whole.alias("json"))


def write_chapters(df: DataFrame, path: str, order: str = "verse") -> None:
    """K3: text files partitioned by book and chapter, verses in order inside each."""
    row = F.concat(F.col("chapter").cast("string"), F.lit(":"), F.col("verse").cast("string"), F.lit(" "), F.col("text"))
    out = df.select("book", F.lpad(F.col("chapter").cast("string"), 2, "0").alias("nn"), order, row.alias("value"))
    out.repartition("book", "nn").sortWithinPartitions("book", "nn", order).select("book", "nn", "value").write.mode("overwrite").partitionBy("book", "nn").text(path)


def add_if_absent(df: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """Fill ``column`` from ``found`` where it is null."""
    other = found.select(key, F.col(column).alias("_new"))
    return df.join(other, key, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def manifest(df: DataFrame, group: str) -> DataFrame:
    """K5, K7: one row of JSON: the groups with their row counts, and the total."""
    counts = df.groupBy(group).agg(F.count("*").alias("rows"))
    return counts.agg(F.to_json(F.struct(F.count("*").alias("groups"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total"), F.sort_array(F.collect_list(F.struct(F.col(group).cast("string").alias("name"), "rows"))).alias("items"))).alias("json"))
