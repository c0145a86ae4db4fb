"""Hard negatives for contrastive training, exact, over k-means inverted lists.

Centroids come from a bounded sample; every row goes to the list of its nearest centroid, and each list stores its
radius. For an anchor a, no row of a list with centroid c and radius r scores above a c + |a| r or below a c - |a| r
(Cauchy-Schwarz). Lists are visited in the order of the upper bound, those outside of a score window are skipped, and the
visit ends when the bound is strictly below the score of the k-th row found so far. The sample's own rows give each anchor
a first k-th score, so anchors are only sent to tiles that have a list they may need. A tile holds some small lists or a
part of a large one, cut by a hash, so a list of very many rows fills many tiles.

Two visits: the best rows of the anchor's label are its positives; their scores set the windows of the second visit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm._common import attach, checkpointed
from lineloom.llm.exact_search import products, scaled
from lineloom.llm.vectors import ID, VECTOR, by_length, every, matrix

#: Rows that centroids are fitted to, and centroids, at most; rows and anchors of a tile, about.
SAMPLE, LISTS = 8192, 1024
ROWS, ANCHORS = 32_768, 8192
_LEAST = -(1 << 62)
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Index:
    """What all tasks know of the lists: of fixed size, whatever the table's."""

    centroids: np.ndarray  # lists x components
    radius: np.ndarray  # the greatest distance of a list's rows from its centroid; -1: no rows
    tile: np.ndarray  # number of the first tile of each list
    parts: np.ndarray  # tiles of each list: over 1 for large lists, which then share none
    sample: np.ndarray  # scaled vectors of the sample
    label: np.ndarray  # and their labels

    def bounds(self, a: np.ndarray, lists: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score (anchors x lists) that rows of a list can have."""
        c, r = self.centroids[lists], self.radius[lists]
        middle, spread = a @ c.T, np.sqrt((a * a).sum(1))[:, None] * r
        room = 1e-9 * (np.abs(middle) + spread) + 1e-3  # scores are whole numbers
        none = r[None, :] < 0
        return np.where(none, np.inf, middle - spread - room), np.where(none, -np.inf, middle + spread + room)


def centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means; the same sample always gives the same centroids."""
    c = x[np.random.default_rng(11).choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        count, total = np.bincount(near, minlength=lists), np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) / 2 - x @ c.T, axis=1) if len(x) else np.zeros(0, int)


def labelled(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, h, label, vec, copies): rows that take part, each different (id, label, vec) once."""
    rows = df.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(F.col(vector), lambda c: c.cast("double")).alias("vec"))
    finite = F.forall("vec", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)
    return checkpointed(rows.groupBy("id", "label", F.xxhash64("vec").alias("h")).agg(F.first("vec").alias("vec"), F.count("*").alias("copies")))


def mine(df: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, step: int = 50, scale: float = 256.0, key: str = ID, vector: str = VECTOR, label: str | Column = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of floor(scale * component). Anchors are the rows whose id ``step`` divides; their
    positives are the ``positives`` best other rows of their label; of each positive the ``negatives`` best rows of other
    labels are returned whose score is from ``low`` to ``high`` hundredths of the positive's. Ties go to the smaller id.

    Rows without an id or label, and vectors that are null, empty or hold null or non-finite components, take no part.
    Vectors meet those of their own length. Rows that repeat or share an id count each, as anchors, positives and
    negatives. Labels are whole numbers; what doesn't cast to one is null. An empty table gives no rows. Scores are exact
    while a hundredfold of them fits 64 bits. Other columns of ``df`` are ignored, whatever their names.
    """
    attach(df.sparkSession)
    rows = labelled(df, key, vector, F.col(label) if isinstance(label, str) else label)
    return by_length(rows, lambda r, n: _mine(r, n, positives, negatives, low, high, step, scale), _OUT)


def _fit(rows: DataFrame, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Labels and scaled vectors of the ``SAMPLE`` rows that are first by a hash of their ids."""
    some = rows.orderBy(F.xxhash64("id"), "id", "label", "h").limit(SAMPLE).select("label", "vec").toArrow()
    return some.column("label").to_numpy(), scaled(matrix(some.column("vec"), some.num_rows), scale)


def _mine(rows: DataFrame, n: int, positives: int, negatives: int, low: int, high: int, step: int, scale: float) -> DataFrame:
    spark = rows.sparkSession
    label, sample = _fit(rows, scale)
    c = centroids(sample, min(LISTS, len(sample), max(1, math.isqrt(n))))
    lists = checkpointed(_listed(rows, c, scale))
    index = _index(spark, lists, n, c, sample, label)
    anchors = rows.where(every(step)).select("id", F.row_number().over(Window.partitionBy("id").orderBy("label", "vec", "h")).alias("q"), "label", "vec", "copies")
    q_parts = max(1, math.ceil(n / step / ANCHORS))
    like = _visit(anchors.withColumn("windows", F.array().cast("array<bigint>")), lists, index, scale, positives, q_parts, low, high)
    found = checkpointed(_positives(like, positives))
    windows = found.groupBy("id", "q").agg(F.sort_array(F.collect_set("score"), False).alias("windows"))  # at most ``positives``
    unlike = _visit(anchors.join(windows, ["id", "q"]), lists, index, scale, negatives, q_parts, low, high)
    best = Window.partitionBy("id", "q", "window").orderBy(F.desc("score"), "vec_id", "_copy")
    each = unlike.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(negatives)))))
    each = each.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= negatives)
    met = found.withColumnRenamed("score", "window").join(each.select("id", "q", "window", "rank", "vec_id", "score"), ["id", "q", "window"])
    met = met.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("anchors"))))
    return met.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("window").alias("positive_score"), F.col("score").alias("negative_score"))


def _positives(like: DataFrame, k: int) -> DataFrame:
    """(id, q, positive_id, score, anchors): the k best of each anchor but for its own row; those that repeat are as many rows."""
    best = Window.partitionBy("id", "q").orderBy(F.desc("score"), "vec_id", "_copy")
    each = like.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k + 1)))))
    each = each.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    own = F.min(F.when((F.col("vec_id") == F.col("id")) & (F.col("score") == F.col("own")), F.col("_n"))).over(Window.partitionBy("id", "q"))
    each = each.withColumn("_own", F.coalesce(own, F.lit(k + 1))).where(F.col("_n") != F.col("_own"))
    return each.select("id", "q", F.col("vec_id").alias("positive_id"), "score", "anchors")


def _listed(rows: DataFrame, c: np.ndarray, scale: float) -> DataFrame:
    """Add the list of each row and its distance from the centroid."""
    sent = rows.sparkSession.sparkContext.broadcast(c)  # LISTS centroids at most

    def run(batches):
        for b in batches:
            x = scaled(matrix(b.column(3), b.num_rows), scale)
            near = nearest(x, sent.value)
            away = np.sqrt(((x - sent.value[near]) ** 2).sum(1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(away)], names=["id", "h", "label", "vec", "copies", "list", "away"])

    return rows.select("id", "h", "label", "vec", "copies").mapInArrow(run, "id long, h long, label long, vec array<double>, copies long, list int, away double")


def _index(spark, lists: DataFrame, n: int, c: np.ndarray, sample: np.ndarray, label: np.ndarray) -> Index:
    radius, count = np.full(len(c), -1.0), np.zeros(len(c), int)
    for r in lists.groupBy("list").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():  # LISTS rows at most
        radius[r["list"]], count[r["list"]] = r["r"], r["n"]
    room = max(1, min(ROWS, math.ceil(n / max(1, min(spark.sparkContext.defaultParallelism, n // 1024)))))
    tile, parts, at, filled = np.zeros(len(c), int), np.ones(len(c), int), 0, 0
    for i in np.argsort(nearest(c, c[:: max(1, math.isqrt(len(c)))]), kind="stable").tolist():  # neighbours share tiles
        if count[i] > room:
            at += filled > 0
            tile[i], parts[i], filled = at, math.ceil(count[i] / room), 0
            at += parts[i]
        else:
            if filled + count[i] > room:
                at, filled = at + 1, 0
            tile[i], filled = at, filled + count[i]
    return Index(c, radius, tile, parts, sample, label)


def limits(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest whole number from ``low`` to ``high`` hundredths of each score."""
    return -(-low * score // 100), high * score // 100


class Anchor:
    """An anchor's windows of scores with the best rows found for each: without windows given, one of all scores.

    Rows of the anchor's label are wanted in the one case, rows of other labels in the other.
    """

    def __init__(self, label: int, windows: np.ndarray, k: int, low: int, high: int):
        self.alike, self.label, self.k = not len(windows), label, k + (not len(windows))  # its own row may be among those found
        self.low, self.high = limits(windows, low, high) if len(windows) else (np.array([_LEAST]), np.array([-_LEAST]))
        self.kth = self.low.copy()
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.low]

    def needs(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which lists (of these bounds) may have a row that belongs to the best of a window."""
        return ((most[:, None] >= self.kth) & (least[:, None] <= self.high)).any(1)

    def offer(self, score: np.ndarray, label: np.ndarray, place: np.ndarray) -> None:
        wanted = (label == self.label) == self.alike
        for w in range(len(self.low)):
            hit = np.flatnonzero(wanted & (score >= self.kth[w]) & (score <= self.high[w]))
            if len(hit):
                self.found[w].append((score[hit], place[hit]))
                if sum(len(f[0]) for f in self.found[w]) >= self.k:
                    self._cut(w)

    def _cut(self, w: int) -> None:
        """Keep the k best; of equal scores the first places."""
        score, place = (np.concatenate(x) for x in zip(*self.found[w], strict=True))
        best = np.lexsort((place, -score))[: self.k]
        self.found[w] = [(score[best], place[best])]
        if len(best) == self.k:
            self.kth[w] = max(self.kth[w], score[best[-1]])


def _seeded(index: Index, label: int, a: np.ndarray, windows: np.ndarray, k: int, low: int, high: int) -> Anchor:
    """An anchor whose k-th scores come from the sample: those are rows of the table, so the true ones are as high at least."""
    seed = Anchor(label, windows, k, low, high)
    seed.offer(products(a[None], index.sample)[0], index.label, np.arange(len(index.label)))
    seed.found = [[] for _ in seed.low]
    return seed


def _visit(anchors: DataFrame, lists: DataFrame, index: Index, scale: float, k: int, q_parts: int, low: int, high: int) -> DataFrame:
    """(id, q, window, vec_id, score, own, copies, anchors): of each tile the best rows of each anchor and window."""
    sent = anchors.sparkSession.sparkContext.broadcast(index)  # of fixed size

    def route(batches):
        x = sent.value
        for b in batches:
            a = scaled(matrix(b.column(3), b.num_rows), scale)
            least, most = x.bounds(a)
            label, at, tiles, kths = b.column(2).to_numpy(), [], [], []
            for i in range(b.num_rows):
                one = _seeded(x, label[i], a[i], np.array(b.column(5)[i].as_py(), np.int64), k, low, high)
                for j in np.flatnonzero(one.needs(least[i], most[i])).tolist():
                    tiles += range(x.tile[j], x.tile[j] + x.parts[j])
                some = sorted(set(tiles[len(at) :]))
                tiles[len(at) :] = some
                at += [i] * len(some)
                kths += [one.kth.tolist()] * len(some)
            part = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tiles, pa.int32()), pa.array(kths, pa.list_(pa.int64()))], names=["id", "q", "label", "vec", "copies", "windows", "tile", "kth"])

    routed = anchors.select("id", F.col("q").cast("int").alias("q"), "label", "vec", "copies", "windows").mapInArrow(route, "id long, q int, label long, vec array<double>, copies long, windows array<bigint>, tile int, kth array<bigint>")
    first, parts = (F.get(F.expr(f"array({', '.join(map(str, values))})"), F.col("list")) for values in (index.tile, index.parts))
    held = lists.withColumn("tile", first + F.pmod(F.xxhash64("id", "h", "label"), parts).cast("int"))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))
    routed = routed.withColumn("block", F.pmod(F.xxhash64("id", "q"), F.lit(q_parts)).cast("int"))

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(8)]
        if q.num_rows and x.num_rows:
            known = sent.value
            xi, xl = x.column("id").to_numpy(), x.column("list").to_numpy()
            order = np.lexsort((x.column("h").to_numpy(), xi, xl))
            xi, xl, xlabel, xc = xi[order], xl[order], x.column("label").to_numpy()[order], x.column("copies").to_numpy()[order]
            xv = scaled(matrix(x.column("vec"), len(xi)), scale)[order]
            ids = np.argsort(np.argsort(xi, kind="stable"), kind="stable")  # places by id, for ties
            here, start = np.unique(xl, return_index=True)
            end = np.append(start[1:], len(xl))
            columns = [q.column(c).to_numpy() for c in ("id", "q", "label", "copies")]
            qv = scaled(matrix(q.column("vec"), q.num_rows), scale)
            least, most = known.bounds(qv, here)
            by_id = np.argsort(ids, kind="stable")
            for i, (qi, qq, ql, qc) in enumerate(zip(*columns, strict=True)):
                one = Anchor(ql, np.array(q.column("windows")[i].as_py(), np.int64), k, low, high)
                one.kth = np.array(q.column("kth")[i].as_py(), np.int64)
                for j in np.argsort(-most[i], kind="stable").tolist():
                    if most[i, j] < one.kth.min():
                        break
                    if one.needs(least[i, j : j + 1], most[i, j : j + 1])[0]:
                        rows = slice(start[j], end[j])
                        one.offer(products(qv[i : i + 1], xv[rows])[0], xlabel[rows], ids[rows])
                own = products(qv[i : i + 1], qv[i : i + 1])[0, 0]
                windows = q.column("windows")[i].as_py() or [0]
                for w, found in enumerate(one.found):
                    for score, place in found:
                        at, n = by_id[place], len(place)
                        for o, v in zip(out, (np.full(n, qi), np.full(n, qq), np.full(n, windows[w]), xi[at], score, np.full(n, own), xc[at], np.full(n, qc)), strict=True):
                            o.append(v)
        kinds = [pa.int32() if i == 1 else pa.int64() for i in range(8)]
        return pa.table([pa.array(np.concatenate(o) if o else [], t) for o, t in zip(out, kinds, strict=True)], names=["id", "q", "window", "vec_id", "score", "own", "copies", "anchors"])

    return routed.groupBy("tile", "block").cogroup(held.groupBy("tile", "block")).applyInArrow(solve, "id long, q int, window long, vec_id long, score long, own long, copies long, anchors long")
