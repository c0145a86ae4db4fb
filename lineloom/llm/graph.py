"""Connected components of a link table, and filters of fixed size that keep joins small."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm._common import checkpointed

#: Bits of a filter for each of its keys, about; least and most bits as powers of two. Beyond the most, a filter lets more through.
BITS_OF_KEY, LEAST_BITS, MOST_BITS = 64, 24, 27


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id that links lead to.

    Alternates large-star and small-star steps until the links stand still. A step takes one minimum for each id and
    joins it back, so an id with very many links is never gathered in one place. Links with a null end are left out.
    """
    e = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.hash("x", "y").cast("long"))).collect()[0]
        if now == mark or now[0] == 0:
            return e.select(F.col("x").alias("id"), F.col("y").alias("component")).union(e.select("y", "y").distinct())
        mark = now
        both = e.union(e.select("y", "x"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(low)
        e = checkpointed(small.distinct())


def filter_of(keys: DataFrame) -> np.ndarray:
    """A bit set (uint64 words) that has every key of the only column (long) of ``keys``, and by chance others.

    Its size follows the number of keys up to 16 MB; at most 2**21 rows come to the driver, however many keys there are.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, int(BITS_OF_KEY * keys.count()).bit_length()))
    k = F.col(f"`{keys.columns[0]}`").bitwiseAND((1 << bits) - 1)
    one = F.expr("shiftleft(1L, cast(k & 63 as int))")
    words = keys.select(k.alias("k")).groupBy(F.shiftright("k", 6).alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    if words.num_rows:
        out[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    return out


def in_filter(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (uint64) the filter may have."""
    at = keys & np.uint64(len(words) * 64 - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
