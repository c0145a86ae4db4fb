"""Finite automata along ordered events (S12): states by composing transition functions, without Python.

An event is a function from states to states, written as an array: element s is the state that follows s. Composing
functions is associative, so the functions of all prefixes come from log2(n) rounds of ``lag``, each of which doubles the
reach; they share one sort. Only events that change some state take part in the rounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an event does: a condition, and the states it leads to from others. States that aren't named stay as they are.
Rules = Sequence[tuple[Column, Mapping[str, str]]]


def transitions(states: Sequence[str], rules: Rules) -> Column:
    """The function of an event: that of the first rule whose condition holds; null if none does, as nothing changes."""
    out = F.lit(None).cast("array<int>")
    for condition, moves in reversed(rules):
        unknown = (set(moves) | set(moves.values())) - set(states)
        if unknown:
            raise ValueError(f"no such states: {sorted(unknown)}")
        after = F.array(*[F.lit(states.index(moves.get(s, s))) for s in states])
        out = F.when(F.coalesce(condition, F.lit(False)), after).otherwise(out)
    return out


def composed(df: DataFrame, partition: Sequence[str], order: str, function: str, out: str = "composed") -> DataFrame:
    """The function of all events up to and with each one; events whose ``function`` is null are left out."""
    rows = df.where(F.col(function).isNotNull()).withColumn(out, F.col(function))
    most = rows.groupBy(*partition).count().agg(F.max("count")).first()[0] or 1
    w, reach = Window.partitionBy(*partition).orderBy(order), 1
    while reach < most:
        before = F.lag(out, reach).over(w)
        rows = rows.withColumn("_before", before).withColumn(out, F.when(F.col("_before").isNull(), F.col(out)).otherwise(F.transform("_before", lambda s: F.get(F.col(out), s)))).drop("_before")
        reach *= 2
    return rows


def run(df: DataFrame, partition: Sequence[str], order: str, states: Sequence[str], rules: Rules, start: str, out: str = "state") -> DataFrame:
    """Add the state behind each event, from ``start`` before a partition's first one. ``order`` must be unique in a partition."""
    events = df.withColumn("_f", transitions(states, rules))
    changed = composed(events.select(*partition, order, "_f"), partition, order, "_f", "_g")
    changed = changed.select(*partition, order, F.get("_g", F.lit(list(states).index(start))).alias("_s"))
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    name = F.get(F.array(*map(F.lit, states)), F.coalesce(F.last("_s", ignorenulls=True).over(w), F.lit(list(states).index(start))))
    return events.join(changed, [*partition, order], "left").withColumn(out, name).drop("_f", "_s")
