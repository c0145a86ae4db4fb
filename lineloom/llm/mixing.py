"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Sources share a budget of words by weight; a source's target stops at a multiple of its size and the excess is shared
again by weight among the others (water filling). The documents of a source queue in shuffled order, pass after pass.
A document's virtual finish time in a pass is the number of its source's words up to its end, divided by the source's
target. All queues are range-sorted by finish time into one, which is cut where the budget is spent: the ranges' sums
tell the range in which that happens, and running sums inside this range tell the document. What comes before it is taken
whole, and it itself up to the last word of the budget. So each source is within one document, or so, of its target.

Running sums over a source are made in two steps: the shuffle key cuts every source into buckets, whose sums are added
up in a small table, and a window then runs inside each bucket. So a source that holds most rows is spread over many
tasks. Documents are never grouped or joined by their ids; repeated rows queue one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm._common import checkpointed, hidden, place

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Mean rows of a bucket over all sources, and the most buckets of a source.
BUCKET_ROWS, MOST_BUCKETS = 128, 1_000_000
SALT = "mix"
PLAN_COLUMNS = ("size", "source_size", "target", "taken", "finish_time")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _queued(df: DataFrame, key: str, source: str, text: str, buckets: int) -> DataFrame:
    """Columns of the queue: source, place in the shuffle, bucket and size. A null source is a source of its own."""
    order = F.md5(F.concat(F.lit(SALT), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return df.select(
        *df.columns,
        words(F.col(text)).alias("size"),
        F.col(source).isNull().alias("_null"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        order.alias("_place"),
        F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long").alias("_bucket"),
    )


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0, share: float = 1.0) -> DataFrame:
    """Target of each source of ``sizes`` (_null, _source, source_size): one row a source, so one task holds them all.

    Sources in code point order, null last, weigh ``weights`` in turn. They share ``share`` of all sizes.
    """
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights)).cast("int") + 1)
    every = Window.partitionBy()
    cap = F.lit(float(most)) * F.col("source_size")
    t = sizes.withColumn("_n", F.row_number().over(Window.orderBy("_null", "_source")) - 1).withColumn("_w", weigh)
    t = t.withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(every)).withColumn("_all", F.sum("_w").over(every)).withColumn("_ratio", cap / F.col("_w"))
    before = Window.orderBy("_ratio", "_n").rowsBetween(Window.unboundedPreceding, -1)
    # Were the sources of smaller ratio held at their caps, what would one unit of weight of the others get?
    t = t.withColumn("_unit", (F.col("_budget") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.col("_all") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    t = t.withColumn("_level", F.min_by(F.when(F.col("_unit") <= F.col("_ratio"), F.col("_unit")), F.when(F.col("_unit") <= F.col("_ratio"), F.struct("_ratio", "_n"))).over(every))
    return t.select("_null", "_source", "source_size", F.least(cap, F.coalesce(F.col("_level") * F.col("_w"), cap)).alias("target"))


#: Order of the merged queue: a source's documents differ in pass and start, so it has no ties.
ORDER = ("_finish", "_null", "_source", "_pass", "_start")


def _placed(df: DataFrame, key: str, source: str, text: str, weights: Sequence[float], most: int, share: float) -> tuple[DataFrame, DataFrame, int]:
    """The queue with each row's start (words of its source before it), the same without texts, cut off from its lineage, and the budget. Over the columns as ``hidden`` names them."""
    buckets = max(1, min(MOST_BUCKETS, math.ceil(df.count() / BUCKET_ROWS)))
    by = ["_null", "_source"]
    queue = _queued(df, key, source, text, buckets)
    sums = checkpointed(queue.groupBy(*by, "_bucket").agg(F.sum("size").alias("_sum")))
    target = targets(sums.groupBy(*by).agg(F.sum("_sum").alias("source_size")), weights, most, share)
    ahead = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum").join(target, by)
    queue = queue.withColumn("_hash", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_place", key, "size", "_hash").rowsBetween(Window.unboundedPreceding, -1)

    def start(rows: DataFrame) -> DataFrame:
        rows = rows.join(offsets, [*by, "_bucket"]).withColumn("_start", F.col("_ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        return rows.drop("_place", "_bucket", "_ahead", "_hash")

    total = sums.agg(F.sum("_sum")).collect()[0][0] or 0
    return start(queue), checkpointed(start(queue.drop(text))), math.floor(share * total + 0.5)


def _served(rows: DataFrame, most: int) -> DataFrame:
    """One row for each pass of each document that has words."""
    passes = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("_pass")
    out = rows.where("size > 0 AND target > 0").select("*", passes)
    return out.withColumn("_finish", _finish(F.col("_pass")))


def _finish(p: Column) -> Column:
    return (p * F.col("source_size") + F.col("_start") + F.col("size")) / F.col("target")


def _cut(rows: DataFrame, most: int, budget: int) -> tuple[dict, int] | None:
    """The row of the merged queue in which the budget is spent, by ``ORDER``, and how many of its words are in it; None if there is no such row."""
    spark = rows.sparkSession
    served = _served(rows, most).select(*ORDER, "size")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_ = served.repartitionByRange(ranges, *ORDER).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*ORDER)).alias("low"), F.sum("size").alias("n"))
    spent = 0
    found = sorted(sorted_.collect(), key=lambda r: tuple(r["low"]))  # a row for each range
    for i, r in enumerate(found):
        if spent + r["n"] >= budget:
            break
        spent += r["n"]
    else:
        return None
    literal = lambda low: F.struct(*[F.lit(low[c]).cast(served.schema[c].dataType).alias(c) for c in ORDER])
    inside = served.where(F.struct(*ORDER) >= literal(r["low"]))
    if i + 1 < len(found):
        inside = inside.where(F.struct(*ORDER) < literal(found[i + 1]["low"]))
    # one range of the sort, so one task's share of the rows
    running = inside.withColumn("_total", F.sum("size").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)) + spent)
    last = running.where(F.col("_total") >= budget).orderBy(*ORDER).limit(1).collect()[0]
    return last.asDict(), budget - (last["_total"] - last["size"])


def _planned(df: DataFrame, key: str, source: str, text: str, weights: Sequence[float], most: int, share: float, keep_text: bool) -> DataFrame:
    """The plan over the columns as ``hidden`` names them."""
    key, source, text = (place(df, c) for c in (key, source, text))
    df = hidden(df)
    rows, narrow, budget = _placed(df, key, source, text, weights, most, share)
    rows = rows if keep_text else narrow
    cut = _cut(narrow, most, budget)

    def taken(p: int) -> Column:
        if cut is None:
            return F.when(F.col("target") > 0, F.col("size")).otherwise(0)
        end, words_ = cut
        mine = F.struct(_finish(F.lit(p)), "_null", "_source", F.lit(p), "_start")
        last = F.struct(F.lit(end["_finish"]), F.lit(end["_null"]), F.lit(end["_source"]), F.lit(end["_pass"]), F.lit(end["_start"]).cast("long"))
        return F.when((F.col("size") == 0) | (F.col("target") <= 0), 0).when(mine < last, F.col("size")).when(mine == last, words_).otherwise(0)

    of_all = sum((taken(p) for p in range(1, most)), taken(0))
    rows = rows.withColumn("taken", of_all.cast("long")).withColumn("finish_time", F.when(F.col("target") > 0, _finish(F.lit(0))))
    return rows.drop("_start", "_null", "_source")


def plan(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, most: int = 3, share: float = 1.0, keep_text: bool = True) -> DataFrame:
    """Add size, source_size, target, taken and finish_time (of the first pass) to every row; rows come sorted by finish time.

    Null and empty texts have size 0 and nothing is taken of them; no row of a source with target 0 is taken either. The
    order of the queues depends on ``key``, size and text alone, so reruns agree; of rows equal in all three any may come
    first. Columns that already have these names are replaced. An empty table gives an empty plan.
    """
    rows = _planned(df, key, source, text, weights, most, share, keep_text)
    kept = [(f"_c{i}", c) for i, c in enumerate(df.columns) if c.lower() not in PLAN_COLUMNS and (keep_text or c.lower() != text.lower())]
    return rows.sort("finish_time", place(df, key)).select(*[F.col(h).alias(c) for h, c in kept], *PLAN_COLUMNS)


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, most: int = 3, share: float = 1.0) -> DataFrame:
    """The mixed corpus: the columns of ``df``, one row for each time that a document is taken, sorted by finish time over the whole result.

    The text of the one document that the budget cuts ends after the last word taken.
    """
    planned = _planned(df, key, source, text, weights, most, share, True)
    hidden_text = place(df, text)
    size, taken = F.col("size"), F.col("taken")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    rest = taken - whole * size
    copies = F.explode(F.sequence(F.lit(1), whole + F.when(rest > 0, 1).otherwise(0)))
    planned = planned.where(taken > 0).withColumn("_rest", rest).withColumn("_whole", whole).select("*", copies.alias("_copy"))
    pieces = F.regexp_extract_all(F.col(hidden_text), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    cut = F.array_join(F.slice(pieces, 1, F.col("_rest").cast("int")), "")
    at = F.col("finish_time") + (F.col("_copy") - 1) * F.col("source_size") / F.col("target")
    out = planned.withColumn("_at", at).withColumn(hidden_text, F.when(F.col("_copy") > F.col("_whole"), cut).otherwise(F.col(hidden_text)))
    return out.sort("_at", place(df, key), "_copy").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)])
