"""Exact search for the largest inner products by a Voronoi join.

Rows and queries are grouped by their nearest of the same pivots, which lie far from each other. A summary of each group
(rows, greatest distance and greatest angle from its pivot, the k + 1 smallest distances, least and greatest norm) bounds the
inner products between a query group and a row group, by distances and by the cone that each group fills. The k + 1 best
lower bounds of single rows set a query group's threshold; a row group whose upper bound is below it can't hold an answer.
Query groups that lie near each other share a tile; rows are replicated to the tiles of which a group needs theirs, and inside a
tile each query group meets only the row groups it needs. What a tile needs is split by a hash into parts of bounded size, so a
group that holds most rows (say, near copies of one vector) fills many. Each part is solved on its own, and their best are merged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm._common import attach
from lineloom.llm.vectors import FOUND, ID, VECTOR, by_length, every, matrix, numbered, ranked, smallest, usable

#: Rows and queries of a tile at most, about; pivots, and rows that they are chosen from, at most.
ROWS, QUERIES = 8192, 2048
PIVOTS, SAMPLE = 1024, 8192
_EXACT = float(1 << 53)


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as int64: in doubles where those are exact, else in 64-bit integers, which wrap."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < _EXACT:
        return (q @ x.T).astype(np.int64)
    return np.clip(q, -(2.0**62), 2.0**62).astype(np.int64) @ np.clip(x, -(2.0**62), 2.0**62).astype(np.int64).T


def far_apart(x: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of ``x`` that lie far from each other: each is the one furthest from those before it."""
    chosen, away = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(x)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _angles(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Angle of each row with its pivot; the greatest where one of them is zero."""
    norms = np.sqrt((x * x).sum(1) * (p * p).sum(1))
    return np.where(norms > 0, np.arccos(np.clip((x * p).sum(1) / np.where(norms > 0, norms, 1), -1, 1)), np.pi)


def _assigned(rows: DataFrame, pivots: np.ndarray, scale: float) -> DataFrame:
    """Add the nearest pivot of each (scaled) vector, its distance and angle from it and its norm."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS at most
    names = rows.columns

    def run(batches):
        p = sent.value
        half = (p * p).sum(1) / 2
        for b in batches:
            x = scaled(matrix(b.column(names.index("vec")), b.num_rows), scale)
            near = np.argmin(half - x @ p.T, axis=1) if b.num_rows else np.zeros(0, int)
            away, angle, norm = (np.sqrt(((x - p[near]) ** 2).sum(1)), _angles(x, p[near]), np.sqrt((x * x).sum(1))) if b.num_rows else [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(away), pa.array(angle), pa.array(norm)], names=[*names, "near", "away", "angle", "norm"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, near int, away double, angle double, norm double")


@dataclass
class Groups:
    """Summaries of groups: a row for each."""

    near: np.ndarray  # numbers of their pivots
    pivot: np.ndarray  # and these
    n: np.ndarray
    away: np.ndarray
    angle: np.ndarray
    norm: np.ndarray
    least: np.ndarray  # least norm

    @classmethod
    def of(cls, rows: DataFrame, pivots: np.ndarray) -> Groups:
        sums = [F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("away", "angle", "norm")], F.min("norm").alias("least")]
        found = rows.groupBy("near").agg(*sums).orderBy("near").collect()  # PIVOTS at most
        near, n, *rest = (np.array([r[c] for r in found], float) for c in ("near", "n", "away", "angle", "norm", "least"))
        return cls(near.astype(int), pivots[near.astype(int)], n.astype(int), *rest)


def necessary(q: Groups, x: Groups, closest: list[list[float]], k: int) -> np.ndarray:
    """Which row groups (columns) a query group (rows) needs, by bounds on the inner products of their members.

    ``closest`` are the smallest distances of each row group's members from its pivot. A query's own row may be among the
    rows, so a threshold has k + 1 rows behind it.
    """
    middle = q.pivot @ x.pivot.T
    pn, xn = np.sqrt((q.pivot**2).sum(1)), np.sqrt((x.pivot**2).sum(1))
    room = 1e-6 * (1 + np.abs(middle))
    # q x = qp xp + (q - qp) xp + q (x - xp), and no more than the norms allow
    high = np.minimum(middle + q.away[:, None] * xn + q.norm[:, None] * x.away, q.norm[:, None] * x.norm)
    both = pn[:, None] * xn
    apart = np.where(both > 0, np.arccos(np.clip(middle / np.where(both > 0, both, 1), -1, 1)), 0.0)
    cone = np.cos(np.maximum(apart - q.angle[:, None] - x.angle - 1e-6, 0.0))  # the least angle that two members can have
    high = np.minimum(high, np.where(cone > 0, q.norm[:, None] * x.norm, q.least[:, None] * x.least) * cone)
    high = high * (1 + 1e-9 * np.sign(high)) + room
    owner = np.repeat(np.arange(len(x.n)), [len(c) for c in closest])
    near = np.concatenate(closest) if len(closest) else np.zeros(0)
    need = np.ones(high.shape, bool)
    for i in range(len(q.n)):
        low = middle[i, owner] - q.away[i] * xn[owner] - min(q.norm[i], pn[i] + q.away[i]) * near - room[i, owner]
        if len(low) > k:
            need[i] = high[i] >= np.partition(low, len(low) - k - 1)[len(low) - k - 1]
    return need


def packed(q: Groups, room: int) -> list[list[int]]:
    """Query groups in tiles of about ``room`` queries, those near each other together; one of more has a tile of its own."""
    coarse = far_apart(q.pivot, max(1, math.isqrt(len(q.n))))
    order = np.lexsort((q.near, np.argmin((coarse**2).sum(1) / 2 - q.pivot @ coarse.T, axis=1)))
    tiles: list[list[int]] = []
    held = 0
    for i in order.tolist():
        if not tiles or held + q.n[i] > room:
            tiles.append([])
            held = 0
        tiles[-1].append(i)
        held += q.n[i]
    return tiles


def search(df: DataFrame, k: int = 5, step: int = 50, scale: float = 256.0, key: str = ID, vector: str = VECTOR) -> DataFrame:
    """(query_id, rank, vec_id, score long): each query's k rows with the largest inner product of floor(scale * x).

    Queries are the rows whose id ``step`` divides, candidates all rows but the query's own; rows that are repeated or
    share an id are queries and candidates each. Ties go to the smaller id. Vectors meet those of their own length. Rows
    that take no part: see ``usable``. An empty table gives no rows. Scores are exact while they fit 64 bits.
    """
    attach(df.sparkSession)
    schema = FOUND.format("long")
    rows = usable(df, key, vector)
    return ranked(by_length(rows, lambda r, n: _search(r, n, k, step, scale, schema), schema), k, True)


def _search(rows: DataFrame, n: int, k: int, step: int, scale: float, schema: str) -> DataFrame:
    spark = rows.sparkSession
    queries = numbered(rows.where(every(step)))
    some = rows.orderBy(F.xxhash64("id", "h"), "id").limit(SAMPLE).select("vec").toArrow()
    pivots = far_apart(scaled(matrix(some.column("vec"), some.num_rows), scale), min(PIVOTS, math.ceil(2 * math.sqrt(n))))
    rows, queries = _assigned(rows, pivots, scale), _assigned(queries, pivots, scale)
    xs, qs = Groups.of(rows, pivots), Groups.of(queries, pivots)
    if not len(qs.n):
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("near").orderBy("away")
    close: dict[int, list[float]] = {j: [] for j in xs.near.tolist()}
    for r in rows.select("near", "away", F.row_number().over(order).alias("i")).where(F.col("i") <= k + 1).select("near", "away").collect():  # k + 1 for each pivot
        close[r["near"]].append(r["away"])
    need = necessary(qs, xs, list(close.values()), k)
    tiles = packed(qs, QUERIES)
    wanted = np.stack([need[t].any(0) for t in tiles])  # tiles x row groups
    x_parts = np.maximum(1, -(-(wanted * xs.n).sum(1) // ROWS))
    q_parts = np.array([max(1, math.ceil(qs.n[t].sum() / QUERIES)) for t in tiles])
    base = np.concatenate(([0], np.cumsum(x_parts * q_parts)[:-1]))
    plan = [(int(xs.near[j]), int(x_parts[t]), int(q_parts[t]), int(base[t])) for t, j in zip(*np.nonzero(wanted), strict=True)]
    one = [(int(qs.near[i]), int(x_parts[t]), int(q_parts[t]), int(base[t])) for t, members in enumerate(tiles) for i in members]
    plan = spark.createDataFrame(plan, "x_near int, x_parts int, q_parts int, tile long")  # PIVOTS rows a tile at most
    one = spark.createDataFrame(one, "q_near int, x_parts int, q_parts int, tile long")
    part = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n))
    x_rows = rows.join(plan, F.col("near") == F.col("x_near")).select("id", "vec", "copies", "near", F.explode(F.transform(F.sequence(F.lit(0), F.col("q_parts") - 1), lambda t: F.col("tile") + part("x_parts", "id", "h") * F.col("q_parts") + t)).alias("tile"))
    q_rows = queries.join(one, F.col("near") == F.col("q_near")).select("id", "q", "vec", "copies", "near", F.explode(F.transform(F.sequence(F.lit(0), F.col("x_parts") - 1), lambda t: F.col("tile") + t * F.col("q_parts") + part("q_parts", "id", "q"))).alias("tile"))
    grid = np.zeros((len(pivots), len(pivots)), bool)
    grid[np.ix_(qs.near, xs.near)] = need
    sent = spark.sparkContext.broadcast(grid)  # PIVOTS x PIVOTS at most
    names = [f.split()[0] for f in schema.split(", ")]

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        qi, qq, qc, qg = (q.column(c).to_numpy() for c in ("id", "q", "copies", "near"))
        xi, xg = x.column("id").to_numpy(), x.column("near").to_numpy()
        order = np.argsort(xi, kind="stable")
        xi, xg, xc = xi[order], xg[order], x.column("copies").to_numpy()[order]
        xv = scaled(matrix(x.column("vec"), len(xi)), scale)[order]
        qv = scaled(matrix(q.column("vec"), len(qi)), scale)
        out = [[] for _ in names]
        for g in np.unique(qg) if len(xi) else []:
            here = np.flatnonzero(sent.value[g][xg])  # rows of the groups that this one needs
            mine = np.flatnonzero(qg == g)
            for at in range(0, len(mine) if len(here) else 0, 64):
                to = mine[at : at + 64]
                score = products(qv[to], xv[here])
                own = np.array([products(v[None], v[None])[0, 0] for v in qv[to]])
                best = smallest(-score, k + 1)
                wide = lambda v: np.broadcast_to(v[:, None], best.shape)  # noqa: B023, E731
                for o, v in zip(out, (wide(qi[to]), wide(qq[to]), xi[here[best]], np.take_along_axis(score, best, 1), wide(own), xc[here[best]], wide(qc[to])), strict=True):
                    o.append(v.ravel())
        kinds = [pa.int32() if c == "q" else pa.int64() for c in names]
        return pa.table([pa.array(np.concatenate(o) if o else [], t) for o, t in zip(out, kinds, strict=True)], names=names)

    return q_rows.groupBy("tile").cogroup(x_rows.groupBy("tile")).applyInArrow(solve, schema)
