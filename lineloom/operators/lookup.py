"""Lookups and completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_default(df: DataFrame, dimension: DataFrame, key: str, value: str, default: Column, out: str) -> DataFrame:
    """A dictionary lookup; keys that the dimension lacks get the default."""
    other = dimension.select(F.col(key), F.col(value).alias("_v"))
    return df.join(other, key, "left").withColumn(out, F.coalesce("_v", default)).drop("_v")


def first_of(df: DataFrame, lookups: Sequence[tuple[DataFrame, str, str]], value: str, default: Column, out: str) -> DataFrame:
    """The value from the first of several (table, df's key, table's key) that has one, else the default."""
    found = []
    for i, (table, own, other) in enumerate(lookups):
        df = df.join(table.select(F.col(other).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), F.col(own) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return df.withColumn(out, F.coalesce(*found, default)).drop(*[f"_{c}{i}" for c in "kv" for i in range(len(lookups))])


def list_or_empty(df: DataFrame, items: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    """The ordered list of a key's items; an empty list for a key without any."""
    lists = items.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(out))
    return df.join(lists, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def flagged(df: DataFrame, members: DataFrame, key: Sequence[str], out: str = "flag") -> DataFrame:
    """Whether the key is among the members. Repeated members don't repeat rows."""
    return df.join(members.select(*key).distinct().withColumn("_in", F.lit(True)), list(key), "left").withColumn(out, F.coalesce("_in", F.lit(False))).drop("_in")


def completeness(expected: DataFrame, actual: DataFrame, key: Sequence[str], group: str) -> DataFrame:
    """For each group how many of its expected keys there are, and whether all are."""
    rows = flagged(expected, actual, key, "_there")
    return rows.groupBy(group).agg(F.count("*").alias("expected"), F.count_if("_there").alias("present"), F.bool_and("_there").alias("complete"))


def missing(expected: DataFrame, actual: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected keys that aren't there."""
    return expected.select(*key).join(actual.select(*key), list(key), "left_anti")
