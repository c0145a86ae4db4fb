"""Keyword search over lines (Q1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions.markup import cut_bytes, highlight
from lineloom.sources.readers import lines


def contains(line: Column, term: str) -> Column:
    """P5: the term in any case, anywhere in the line."""
    return F.contains(F.lower(line), F.lit(term.lower()))


def split_line(line: Column) -> Column:
    """struct(ref, text) at the first blank; null if there is none."""
    parts = F.split(line, " ", 2)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("ref"), parts[1].alias("text")))


def search(df: DataFrame, term: str, order: list[str], text: str = "text", most: int = 20, width: int = 200) -> DataFrame:
    """The first ``most`` lines with the term, in order: place, reference, and the text with the term marked and cut to ``width`` bytes.

    The empty term finds nothing. Only the rows that the limit leaves are marked and cut.
    """
    found = lines(df.select(*order, text), text).where(F.lit(term != "") & contains(F.col("line"), term))
    found = found.withColumn("_s", split_line(F.col("line"))).where("_s IS NOT NULL").orderBy(*order, "line_no").limit(most)
    return found.select(*order, "line_no", F.col("_s.ref").alias("ref"), cut_bytes(highlight(F.col("_s.text"), term), width).alias("snippet"))


def result_count(df: DataFrame, term: str, text: str = "text", most: int = 20) -> DataFrame:
    """Matching lines, how many are shown, and whether the report says that it shows the first ones only."""
    n = lines(df.select(text), text).where(contains(F.col("line"), term)).where(split_line(F.col("line")).isNotNull()).agg(F.count("*").alias("n"))
    return n.select("n", F.least("n", F.lit(most)).alias("shown"), (F.col("n") >= most).alias("first_only"))
