"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one full-dimensional codeword from each of several codebooks. The codebooks are
trained one after the other on the residuals of a bounded sample; encoding keeps a beam of partial sums, so a later
codeword can make up for an earlier one. Vectors are coded at length one, so that a few long ones don't take the codewords
from the others. The index holds each row's codes, its norm and the factor that makes its
approximation fit it best. A query makes a table of its inner products with all codewords; table look-ups and the stored
norm give its distance from each row, about. Tiles of queries and rows exchange codes and norms, not vectors; a query's
nearest rows by that over all tiles are its shortlist, and only these are fetched and ranked by exact distance. Every row is
indexed and every query scans all codes.

How long a shortlist must be depends on rows, components and data, so it is measured: for some queries the true nearest of all
rows are found, of equally near ones those of smaller id, and the shortlist is made so long that ``RECALL`` of them are on it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm._common import attach, checkpointed
from lineloom.llm.vectors import FOUND, ID, VECTOR, by_length, every, matrix, numbered, ranked, smallest, usable

#: Codewords in a codebook, partial sums that encoding keeps, vectors to train on at most.
WORDS, BEAM, SAMPLE = 256, 4, 8_192
#: Rows and queries of a tile, about.
ROWS, QUERIES = 16_384, 4096
#: Share of the true nearest that shortlists must have, queries that it is measured with, and the least length for each result.
RECALL, PROBES, LEAST = 0.985, 128, 4


def books_for(components: int) -> int:
    """More codebooks for longer vectors, up to 32."""
    return max(16, min(32, 3 * components // 8))



@dataclass
class Codebooks:
    words: np.ndarray  # books x words x components

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x books, uint8) and squared norms of the approximations."""
        m, k, d = self.words.shape
        n = len(x)
        sums, error = np.zeros((n, 1, d)), np.full((n, 1), 0.0)
        codes = np.zeros((n, 1, 0), np.uint8)
        for b in range(m):
            w = self.words[b]
            rest = x[:, None, :] - sums
            # squared error of each partial sum with each codeword, but for the constant |rest|^2, which differs in a beam
            e = (rest * rest).sum(2)[:, :, None] - 2 * rest @ w.T + (w * w).sum(1)
            flat = e.reshape(n, -1)
            keep = min(beam, flat.shape[1]) if b < m - 1 else 1
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.broadcast_to(np.arange(keep), (n, keep))
            source, code = best // k, best % k
            sums = np.take_along_axis(sums, source[:, :, None], 1) + w[code]
            codes = np.concatenate([np.take_along_axis(codes, source[:, :, None], 1), code[:, :, None].astype(np.uint8)], axis=2)
        s = sums[:, 0]
        return codes[:, 0], (s * s).sum(1)


def train(x: np.ndarray, books: int = 16, words: int = WORDS, rounds: int = 6) -> Codebooks:
    """Residual k-means; the same sample always gives the same codebooks."""
    rest, out = x.copy(), []
    k = max(1, min(words, len(x)))
    rng = np.random.default_rng(7)
    for _ in range(books):
        w = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(rounds):
            near = np.argmin((w * w).sum(1) - 2 * rest @ w.T, axis=1)
            count = np.bincount(near, minlength=k)
            total = np.zeros_like(w)
            np.add.at(total, near, rest)
            w = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], w)
        near = np.argmin((w * w).sum(1) - 2 * rest @ w.T, axis=1)
        rest = rest - w[near]
        out.append(w)
    return Codebooks(np.stack(out))


def fit(df: DataFrame, key: str = ID, vector: str = VECTOR, sample: int = SAMPLE, books: int | None = None, words: int = WORDS) -> Codebooks | None:
    """Codebooks from the ``sample`` rows that are first by a hash of their ids; None for a table without usable rows."""
    return _fit(usable(df, key, vector, zeros=False), sample, books, words)


def _fit(rows: DataFrame, sample: int = SAMPLE, books: int | None = None, words: int = WORDS) -> Codebooks | None:
    some = rows.orderBy(F.xxhash64("id"), "id", "h").limit(sample).select("vec").toArrow()
    if not some.num_rows:
        return None
    x = _unit(matrix(some.column("vec"), some.num_rows))
    return train(x, books or books_for(x.shape[1]), words)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one. They are scaled to a largest component of one first, so that no square leaves the range of numbers."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def index(rows: DataFrame, books: Codebooks, beam: int = BEAM) -> DataFrame:
    """(id, h, codes binary, norm double, fit double) of every row of ``rows`` (as ``usable`` gives them, of one length)."""
    sent = attach(rows.sparkSession).sparkContext.broadcast(books)  # books x words codewords, whatever the table's size

    def run(batches):
        for b in batches:
            codes, norm, fits = [], [], []
            x = matrix(b.column(2), b.num_rows)
            for at in range(0, b.num_rows, 512):
                c, s = sent.value.encode(_unit(x[at : at + 512]), beam)
                like = sum(w[i] for w, i in zip(sent.value.words, c.T, strict=True))
                codes += [r.tobytes() for r in c]
                norm.append((x[at : at + 512] ** 2).sum(1))
                fits.append(np.where(s > 0, (like * x[at : at + 512]).sum(1) / np.where(s > 0, s, 1), 1.0))
            flat = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.binary()), flat(norm), flat(fits)], names=["id", "h", "codes", "norm", "fit"])

    return rows.select("id", "h", "vec").mapInArrow(run, "id long, h long, codes binary, norm double, fit double")


def search(df: DataFrame, k: int = 10, step: int = 100, key: str = ID, vector: str = VECTOR, books: Codebooks | None = None, rerank: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by exact Euclidean distance, ties to the smaller id.

    Queries are the rows whose id ``step`` divides, candidates all rows but the query's own; rows that are repeated or
    share an id are queries and candidates each. Vectors meet those of their own length; ``books`` given must be of that
    length. ``rerank``, rows on a shortlist for each result, is measured if it isn't given. Null, empty, zero and
    non-finite vectors take no part. An empty table gives no rows.
    """
    attach(df.sparkSession)
    schema = FOUND.format("double")
    rows = usable(df, key, vector, zeros=False)
    return ranked(by_length(rows, lambda r, n: _search(r, n, k, step, books or _fit(r), rerank), schema), k, False)


def _near(table: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Squared distance of rows from a query, about, but for the query's norm. ``table`` (books x words) are its inner products with the codewords."""
    like = table[0][codes[0]]
    for m in range(1, len(table)):
        like += table[m][codes[m]]
    return norm - 2 * fit * like


def _codes(column: pa.Array | pa.ChunkedArray, n: int, books: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, books).T)


def shortlist(rows: DataFrame, held: DataFrame, queries: DataFrame, books: Codebooks, k: int, n: int) -> int:
    """So many rows by approximate distance hold ``RECALL`` of the true k nearest, measured with ``PROBES`` queries against all rows."""
    spark = rows.sparkSession
    probes = queries.select("id", "vec").orderBy(F.xxhash64("id", F.lit("probe")), "id", "q").limit(PROBES).toArrow()  # not the sample's order
    if not probes.num_rows or n <= LEAST * k:
        return LEAST * k
    sent = spark.sparkContext.broadcast((books.words, probes.column("id").to_numpy(), matrix(probes.column("vec"), probes.num_rows)))

    def true(batches):
        """The k nearest of a task's rows to each probe, ties to the smaller id, with their approximate distances."""
        words, qi, qv = sent.value
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0)) for _ in qi]
        for b in batches:
            x, codes = matrix(b.column(1), b.num_rows), _codes(b.column(2), b.num_rows, len(words)) if b.num_rows else None
            for i in range(len(qi) if b.num_rows else 0):
                ids, away = b.column(0).to_numpy(), np.sqrt(((x - qv[i]) ** 2).sum(1))
                near = _near(words @ qv[i], codes, b.column(3).to_numpy(), b.column(4).to_numpy())
                away[(ids == qi[i]) & (away == 0)] = np.inf  # its own row
                away, ids, near = (np.concatenate(pair) for pair in zip(best[i], (away, ids, near), strict=True))
                first = np.lexsort((ids, away))[:k]
                best[i] = away[first], ids[first], near[first]
        at = np.repeat(np.arange(len(qi)), [len(x[0]) for x in best])
        flat = [pa.array(np.concatenate(column)) for column in zip(*best, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *flat], names=["p", "away", "id", "near"])

    both = rows.select("id", "h", "vec").join(held, ["id", "h"]).select("id", "vec", "codes", "norm", "fit")
    place = F.row_number().over(Window.partitionBy("p").orderBy("away", "id"))
    found = both.mapInArrow(true, "p int, away double, id long, near double").withColumn("_n", place).where((F.col("_n") <= k) & (F.col("away") < float("inf"))).select("p", "near", "id").collect()  # k for each probe
    limits = [[(r["near"], r["id"]) for r in found if r["p"] == p] for p in range(probes.num_rows)]
    told = spark.sparkContext.broadcast(limits)

    def ahead(batches):
        """How many of a task's rows are nearer to each probe than each of its true nearest, by approximate distance and then by id."""
        words, _, qv = sent.value
        total = [np.zeros(len(x), np.int64) for x in told.value]
        for b in batches:
            if b.num_rows:
                codes, ids = _codes(b.column(0), b.num_rows, len(words)), b.column(3).to_numpy()
                for i, of in enumerate(told.value):
                    near = _near(words @ qv[i], codes, b.column(1).to_numpy(), b.column(2).to_numpy())
                    for j, (x, id_) in enumerate(of):
                        total[i][j] += np.count_nonzero(near < x) + np.count_nonzero(ids[near == x] < id_)
        at, j = np.repeat(np.arange(len(total)), [len(t) for t in total]), np.concatenate([np.arange(len(t)) for t in total])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.concatenate(total))], names=["p", "j", "n"])

    counts = held.select("codes", "norm", "fit", "id").mapInArrow(ahead, "p int, j int, n long").groupBy("p", "j").agg(F.sum("n").alias("n")).collect()
    places = sorted(r["n"] for r in counts)
    return max(LEAST * k, places[math.ceil(RECALL * len(places)) - 1] + 1) if places else LEAST * k


def _search(rows: DataFrame, n: int, k: int, step: int, books: Codebooks, rerank: int | None) -> DataFrame:
    spark = rows.sparkSession
    queries = numbered(rows.where(every(step)))
    held = checkpointed(index(rows, books))
    short = k * rerank if rerank else shortlist(rows, held, queries, books, k, n)
    least = spark.sparkContext.defaultParallelism
    x_parts, q_parts = max(1, math.ceil(n / ROWS), min(least, n // 1024)), max(1, math.ceil(n / step / QUERIES))
    # rows are dealt by a hash, so a tile has about its share of a shortlist: six deviations more leave none out
    own = short / x_parts
    few = min(short, math.ceil(own + 6 * math.sqrt(own) + 16))
    part = lambda m, *by: F.pmod(F.xxhash64(*by), F.lit(m))
    x_rows = held.withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(q_parts - 1)), lambda t: part(x_parts, "id", "h") * q_parts + t)))
    q_rows = queries.drop("copies").withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(x_parts - 1)), lambda t: t * q_parts + part(q_parts, "id", "q"))))
    sent = spark.sparkContext.broadcast(books)

    def scan(q: pa.Table, x: pa.Table) -> pa.Table:
        words = sent.value.words
        qi, qq = (q.column(c).to_numpy() for c in ("id", "q"))
        xi, xh, norm, fit = (x.column(c).to_numpy() for c in ("id", "h", "norm", "fit"))
        order = np.argsort(xi, kind="stable")
        xi, xh, norm, fit = xi[order], xh[order], norm[order], fit[order]
        codes = _codes(x.column("codes"), len(xi), len(words))[:, order] if len(xi) else None
        qv = matrix(q.column("vec"), len(qi))
        out = [[] for _ in range(5)]
        for i in range(len(qi) if len(xi) else 0):
            near = _near(words @ qv[i], codes, norm, fit)
            best = smallest(near[None, :], few)[0]
            for o, v in zip(out, (np.full(len(best), qi[i]), np.full(len(best), qq[i]), xi[best], xh[best], near[best]), strict=True):
                o.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.concatenate(o) if o else [], t) for o, t in zip(out, kinds, strict=True)], names=["query_id", "q", "id", "h", "near"])

    found = q_rows.groupBy("tile").cogroup(x_rows.groupBy("tile")).applyInArrow(scan, "query_id long, q int, id long, h long, near double")
    place = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("near", "id", "h"))
    listed = found.withColumn("_n", place).where(F.col("_n") <= short).select("query_id", "q", "id", "h")
    met = listed.join(rows, ["id", "h"]).join(queries.select(F.col("id").alias("query_id"), "q", F.col("vec").alias("q_vec"), F.col("copies").alias("queries")), ["query_id", "q"])

    def measure(batches):
        for b in batches:
            x, q = matrix(b.column(3), b.num_rows), matrix(b.column(4), b.num_rows)
            away = np.sqrt(((x - q) ** 2).sum(1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(away), pa.array(np.zeros(b.num_rows)), *b.columns[5:]], names=["query_id", "q", "vec_id", "score", "own", "copies", "queries"])

    return met.select("query_id", "q", "id", "vec", "q_vec", "copies", "queries").mapInArrow(measure, FOUND.format("double"))
