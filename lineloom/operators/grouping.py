"""Grouping, precedence and renumbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions.numerals import natural_number


def grouped(df: DataFrame, by: Sequence[str], order: Sequence[str], fields: Sequence[str], out: str = "items") -> DataFrame:
    """An array of structs for each group, sorted by ``order`` (a number, or the ordinal of insertion)."""
    items = F.sort_array(F.collect_list(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("item"))))
    return df.groupBy(*by).agg(F.transform(items, lambda x: x["item"]).alias(out))


def joined(df: DataFrame, by: Sequence[str], order: Sequence[str], text: str, separator: str, out: str = "joined") -> DataFrame:
    """The texts of each group in order, as one string."""
    items = F.sort_array(F.collect_list(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(text).cast("string").alias("item"))))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: x["item"]), separator).alias(out))


def last_wins(df: DataFrame, by: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Of the rows of a key the last in ``order``; an aggregation with map-side combine, no sort."""
    best = F.max_by(F.struct(*fields), F.struct(*order)).alias("_best")
    return df.groupBy(*by).agg(best).select(*by, "_best.*")


def first_wins(df: DataFrame, by: str, order: Sequence[str], keep_blank: bool = True) -> DataFrame:
    """The first row of each key; rows whose key is empty all stay if ``keep_blank``."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    blank = (F.coalesce(F.col(by).cast("string"), F.lit("")) == "") if keep_blank else F.lit(False)
    some = df.where(~blank).withColumn("_n", n).where("_n = 1").drop("_n")
    return some.unionByName(df.where(blank)) if keep_blank else some


def by_priority(sources: Sequence[DataFrame], by: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The union of the sources, a key's rows from the first source that has it."""
    union = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_no", F.lit(i))
        union = s if union is None else union.unionByName(s, allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy(*by).orderBy("source_no", *order))
    return union.withColumn("_n", n).where("_n = 1").drop("_n")


def first_and_last(df: DataFrame, by: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """first_<field> and last_<field> of each group."""
    ends = [f(F.struct(*fields), F.struct(*order)).alias(n) for f, n in ((F.min_by, "_first"), (F.max_by, "_last"))]
    return df.groupBy(*by).agg(*ends).select(*by, *[F.col(f"_{e}.{f}").alias(f"{e}_{f}") for e in ("first", "last") for f in fields])


def renumbered(df: DataFrame, by: Sequence[str], number: str, out: str = "display_number", ties: Sequence[str] = ()) -> DataFrame:
    """Sequential numbers in each group after a natural sort; rows with one number are in the order of ``ties``."""
    w = Window.partitionBy(*by).orderBy(natural_number(F.col(number)), number, *ties)
    return df.withColumn(out, F.row_number().over(w))


def enumerated(df: DataFrame, by: Sequence[str], order: Sequence[str], content: str, out: str = "number") -> DataFrame:
    """Numbers in document order, given before empty contents are dropped, so these leave gaps. P9."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.length(F.coalesce(content, F.lit(""))) > 0)


def last_match(s: Column, pattern: str, group: int = 0) -> Column:
    """W10"""
    return F.try_element_at(F.regexp_extract_all(s, F.lit(pattern), F.lit(group)), F.lit(-1))


def first_matching(items: Column, pattern: str) -> Column:
    """The first element of an array that matches."""
    return F.try_element_at(F.filter(items, lambda x: x.rlike(pattern)), F.lit(1))


def nth(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: Column, n: int) -> DataFrame:
    """The n-th row (from 1) of those that qualify, in each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.where(keep).withColumn("_n", F.row_number().over(w)).where(F.col("_n") == n).drop("_n")
