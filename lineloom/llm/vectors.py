"""Vector tables as the search operators read them, and the tiles in which queries meet rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.llm._common import checkpointed

ID, VECTOR = "vec_id", "embedding"


def usable(df: DataFrame, key: str = ID, vector: str = VECTOR, zeros: bool = True) -> DataFrame:
    """(id long, h long, vec array<double>, copies long): the rows that take part, each different (id, vec) once.

    Left out are null ids, vectors that are null or empty or hold null or non-finite components, and zero vectors unless
    ``zeros``. h is a hash of vec. Copies are counted before they are shuffled.
    """
    x = F.col("vec")
    rows = df.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda c: c.cast("double")).alias("vec"))
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    if not zeros:
        rows = rows.where(F.exists(x, lambda c: c != 0))
    return checkpointed(rows.groupBy("id", F.xxhash64("vec").alias("h")).agg(F.first("vec").alias("vec"), F.count("*").alias("copies")))


def by_length(rows: DataFrame, search: Callable[[DataFrame, int], DataFrame], schema: str) -> DataFrame:
    """``search(rows, how many)`` for the vectors of each length by themselves: nearness is between vectors of one length only."""
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy("d").collect()  # usually one
    found = [search(rows.where(F.size("vec") == r["d"]) if len(sizes) > 1 else rows, r["count"]) for r in sizes]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], schema)


def every(step: int) -> Column:
    """The query set of a search: rows whose id ``step`` divides."""
    return F.col("id") % step == 0


def numbered(queries: DataFrame) -> DataFrame:
    """(id, q, vec, copies): queries, those that share an id numbered."""
    from pyspark.sql import Window

    return queries.select("id", F.row_number().over(Window.partitionBy("id").orderBy("vec", "h")).alias("q"), "vec", "copies")


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """A column of equally long lists as rows of float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1).astype(np.float64, copy=False) if rows else np.zeros((0, 1))


def smallest(values: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k smallest values; of equal values those of smaller index."""
    n = values.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), values.shape)
    edge = np.partition(values, k - 1, axis=1)[:, k - 1 : k]
    below, at = values < edge, values == edge
    take = below | at & (np.cumsum(at, axis=1) <= k - below.sum(1, keepdims=True))
    return np.nonzero(take)[1].reshape(len(values), k)


#: Columns of what is found for a query: ``own`` is the score of the query's own row.
FOUND = "query_id long, q int, vec_id long, score {0}, own {0}, copies long, queries long"


def best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """The k + 1 best (vec_id, score) of each query, ties to the smaller vec_id, as ``place`` from 1."""
    from pyspark.sql import Window

    score = F.desc("score") if descending else F.asc("score")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "q").orderBy(score, "vec_id"))).where(F.col("place") <= k + 1)


def ranked(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query but for its own row, ties to the smaller vec_id, with rank from 1.

    ``found`` may hold a query's own row or not. Rows that are repeated count each, as candidates and as queries.
    """
    from pyspark.sql import Window

    each = lambda n: F.explode(F.sequence(F.lit(1), F.least(n, F.lit(k + 1)).cast("int")))
    rows = best(best(found, k, descending).withColumn("_copy", each(F.col("copies"))), k, descending)
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("place"))).over(Window.partitionBy("query_id", "q"))
    rows = rows.withColumn("_own", F.coalesce(own, F.lit(k + 2))).where(F.col("place") != F.col("_own"))
    rows = rows.withColumn("rank", (F.col("place") - (F.col("place") > F.col("_own")).cast("int")).cast("int")).where(F.col("rank") <= k)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("queries"))))
    return rows.select("query_id", "rank", "vec_id", "score")
