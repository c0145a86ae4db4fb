"""Unions, unpivots and explodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagged_union(tables: Mapping[object, DataFrame], tag: str) -> DataFrame:
    """Tables of different shapes one under another, with the tag of each; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(tag, F.lit(k)) for k, t in tables.items()])


def long_form(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """A row for each non-null cell."""
    return df.unpivot(list(keep), list(columns), name, value).where(F.col(value).isNotNull())


def range_rows(df: DataFrame, first: str, last: str, out: str) -> DataFrame:
    """A row for each whole number from first to last; none if the range runs backwards."""
    return df.where(F.col(last) >= F.col(first)).withColumn(out, F.explode(F.sequence(first, last)))


def split_rows(df: DataFrame, column: str, separator: str, out: str) -> DataFrame:
    """A row for each part of a list such as ``8 & 9``; parts that are no whole number are dropped."""
    parts = df.select("*", F.explode(F.split(F.col(column), separator)).alias("_part"))
    return parts.withColumn(out, F.trim("_part").try_cast("int")).drop("_part").where(F.col(out).isNotNull())


def counted(df: DataFrame, n: str, out: str) -> DataFrame:
    """Rows 1..n."""
    return df.where(F.col(n) >= 1).withColumn(out, F.explode(F.sequence(F.lit(1).cast("int"), F.col(n).cast("int"))))


def nested_map(df: DataFrame, outer: str, inner: str, value: str, out: str = "map") -> DataFrame:
    """E5: a map of inner key to value for each outer key; of repeated keys the largest value stays."""
    one = df.groupBy(outer, inner).agg(F.max(value).alias("_v"))
    return one.groupBy(outer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(inner, "_v")))).alias(out))
