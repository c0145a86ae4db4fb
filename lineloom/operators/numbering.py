"""Numbers along a total order without sorting a table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about, and ranges at most.
ROWS, RANGES = 1_000_000, 1024


def _cuts(df: DataFrame, order: Sequence[str], ranges: int) -> list:
    """Keys between ranges, from a sample of bounded size. Whatever it holds, numbers come out right; it only decides how even ranges are."""
    n = 64 * ranges
    some = df.select(F.struct(*order).alias("k")).orderBy(F.xxhash64(*order)).limit(n).select("k").distinct().orderBy("k").collect()
    step = max(1, len(some) // ranges)
    return [r["k"] for r in some[step::step]]


def _range(key: Column, cuts: list, kind: str) -> Column:
    """How many of the cuts are at or before a key. They are compared in two steps, so few per row."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    quoted = lambda some: F.from_json(F.lit("[" + ",".join(_json(c) for c in some) + "]"), f"array<{kind}>")
    coarse = F.size(F.filter(quoted(cuts[width - 1 :: width]), lambda c: c <= key))
    near = F.slice(quoted(cuts), coarse * width + 1, width)
    return coarse * width + F.size(F.filter(near, lambda c: c <= key))


def _json(row) -> str:
    import json

    return json.dumps(row.asDict(), default=str)


def numbered(df: DataFrame, order: Sequence[str], out: str = "row_no", by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Add each row's number from 1 in the order of columns ``order``, nulls first; with ``by``, from 1 in each group.

    Rows are cut into ranges of keys, numbered inside each, and shifted by what the ranges before it have. A group that
    fills many ranges is numbered by many tasks. ``order`` should be total: rows that are equal in it share a range and
    get their numbers in any order. Columns of ``order`` and ``by`` must be numbers, strings, dates or booleans.
    """
    keys = [*by, *order]
    if ranges is None:
        ranges = max(1, min(RANGES, df.count() // ROWS))
    cuts = _cuts(df, keys, ranges) if ranges > 1 else []
    kind = df.select(F.struct(*keys).alias("k")).schema["k"].dataType.simpleString()
    rows = df.withColumn("_range", _range(F.struct(*keys), cuts, kind))
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)) if by else F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    # at most one group goes on from one range to the next, so there are no more shifts than ranges
    shifts = counts.withColumn("_before", before).where("_before > 0").drop("_n")
    for b in by:
        shifts = shifts.withColumnRenamed(b, f"_by_{b}")
    shifts = F.broadcast(shifts.withColumnRenamed("_range", "_to"))
    same = (F.col("_range") == F.col("_to")) & F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    place = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    return rows.join(shifts, same, "left").withColumn(out, place + F.coalesce("_before", F.lit(0))).drop("_range", "_to", "_before", *[f"_by_{b}" for b in by])
