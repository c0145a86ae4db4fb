"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree is counted over a bounded, labelled sample; its statistics are then
frozen. A text's tokens (what stands between ASCII white space, each with the space after it) are coded symbol by
symbol: from the longest context known to the language, a symbol costs -log2 of its share there, or the escape cost and
then its cost in the next shorter context, where the symbols already ruled out are excluded; beyond order 0 the
remaining byte values are equally likely. Escape probabilities are those of method C (distinct symbols against total).
Contexts reach back to the space before the token and runs of white space are one space, so what is coded is the sequence
of tokens, a token costs the same wherever it stands, and workers keep the costs of tokens that they have met. The language with the shortest exact code wins; ties go to the smaller name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.llm._common import attach, with_columns

#: Contexts hold at most so many bytes.
ORDER = 4
#: Bounds of the training sample of each language: documents, and bytes of their texts.
TRAIN_DOCS, TRAIN_BYTES = 400, 600_000
#: Ranges of the hash by which training documents are chosen.
SLOTS = 65_536
#: Bytes of memory for the costs of tokens that a worker keeps.
CACHE_BYTES = 40_000_000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def grams(data: np.ndarray, order: int) -> list[np.ndarray]:
    """For each d up to ``order``, the key of the symbol and the d before it at each place, or 0 where a space cuts them off.

    ``data`` begins and ends with a space.
    """
    symbol = data.astype(np.uint64)
    keys, key, open_ = [], symbol.copy(), np.ones(len(data), bool)
    for d in range(order + 1):
        if d:
            # the symbol d-1 before must not be a space: a space is the last that a context holds
            back = np.zeros(len(data), np.uint64)
            back[d:] = symbol[:-d]
            cut = np.ones(len(data), bool)
            cut[d:] = False
            if d > 1:
                cut[d - 1 :] |= data[: len(data) - d + 1] == 32
            open_ = open_ & ~cut
            key = key | back << np.uint64(8 * d)
        keys.append(np.where(open_, key | np.uint64(d + 1) << np.uint64(56), np.uint64(0)))
    return keys


@dataclass
class Tree:
    """Frozen statistics of one language. ``key``: its sorted grams; a row of the tables (one column each) is a gram.

    log_count: log2 of the gram's count, NaN if it hasn't been seen. As a context: ``total`` is log2 of the
    denominator, ``escape`` the cost of an escape, ``total_x`` and ``escape_x`` the same in the next shorter context with
    this one's symbols excluded; NaN where the context is unknown.
    """

    order: int
    key: np.ndarray
    log_count: np.ndarray
    total: np.ndarray
    escape: np.ndarray
    total_x: np.ndarray
    escape_x: np.ndarray
    root: np.ndarray  # total, escape, cost beyond order 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the keys; the last row, of NaN, for those that haven't been seen."""
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, at, len(self.key) - 1)

    def costs(self, data: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        """Code length in bits of each token of ``data``, of which ``found`` are the grams."""
        rows = [self.find(k) for k in found]
        none = len(self.key) - 1
        n = len(data) - 1
        cost = np.zeros((n, 1))
        going = np.ones(cost.shape, bool)
        escaped = np.zeros(cost.shape, bool)
        last_total = last_escape = np.zeros(cost.shape)
        for d in range(self.order, -1, -1):
            if d:
                c = rows[d - 1][:-1]  # the context is the gram that ends one place before
                if d > 1 and (c == none).all():
                    continue
                total, escape = self.total[c], self.escape[c]
            else:
                total, escape = np.broadcast_to(self.root[0], cost.shape), np.broadcast_to(self.root[1], cost.shape)
            seen = going & ~np.isnan(total)
            count = self.log_count[rows[d][1:]]
            hit = seen & ~np.isnan(count)
            cost += np.where(hit, np.where(escaped, last_total, total) - np.nan_to_num(count), 0)
            miss = seen & ~hit
            cost += np.where(miss, np.where(escaped, last_escape, escape), 0)
            going &= ~hit
            escaped |= miss
            if d:
                last_total = np.where(seen, self.total_x[c], last_total)
                last_escape = np.where(seen, self.escape_x[c], last_escape)
        cost += np.where(going, self.root[2], 0)
        ends = np.flatnonzero(data == 32)[:-1]
        return np.add.reduceat(cost, ends, axis=0)


@dataclass
class Model:
    """A tree for each language: as large as what the languages' samples hold, not as languages times grams."""

    languages: list[str]
    trees: list[Tree]
    order: int
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def costs(self, words: list[bytes]) -> np.ndarray:
        """Code length in bits of each token under each language."""
        if not words or not self.trees:
            return np.zeros((len(words), len(self.languages)))
        data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
        found = grams(data, self.order)
        return np.concatenate([t.costs(data, found) for t in self.trees], axis=1)


def fit(samples: Iterable[tuple[str, str]], order: int = ORDER) -> Model:
    """Count the context trees of (language, text) pairs; each language's counts do not depend on their order."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in samples:
        texts.setdefault(lang, []).extend(text.encode("utf-8", "replace").split())
    languages = sorted(texts)
    return Model(languages, [grown(texts[lang], order) for lang in languages], order)


def grown(words: list[bytes], order: int) -> Tree:
    """The context tree of one language's tokens."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    of = [np.unique(k[1:][k[1:] > 0], return_counts=True) for k in grams(data, order)]
    seen_keys, counts = np.concatenate([k for k, _ in of]), np.concatenate([c for _, c in of])
    key = np.unique(np.append(seen_keys, np.uint64((1 << 64) - 1)))
    shape = (len(key), 1)
    count = np.zeros(shape)
    count[np.searchsorted(key, seen_keys), 0] = counts
    top = np.uint64(56)
    width = (key >> top).astype(int)
    symbols = key & np.uint64((1 << 56) - 1)
    n, q, n_x, q_x = (np.zeros(shape) for _ in range(4))
    root_n, root_q = count[width == 1].sum(0), (count[width == 1] > 0).sum(0)
    for w in range(2, order + 2):  # grams of w symbols under their contexts of w - 1
        at = np.flatnonzero(width == w)
        if not len(at):
            continue
        context = np.searchsorted(key, symbols[at] >> np.uint64(8) | np.uint64(w - 1) << top)
        known = (context < len(key)) & (key[np.minimum(context, len(key) - 1)] == (symbols[at] >> np.uint64(8) | np.uint64(w - 1) << top))
        at, context = at[known], context[known]
        shorter = np.searchsorted(key, symbols[at] & np.uint64((1 << 8 * (w - 1)) - 1) | np.uint64(w - 1) << top)
        np.add.at(n, context, count[at])
        np.add.at(q, context, count[at] > 0)
        # what the same symbols have in the next shorter context
        np.add.at(n_x, context, np.where(count[at] > 0, count[shorter], 0))
    for w in range(1, order + 1):  # contexts of w symbols and the next shorter ones
        at = np.flatnonzero(width == w)
        if w == 1:
            n_s, q_s = np.broadcast_to(root_n, (len(at), shape[1])), np.broadcast_to(root_q, (len(at), shape[1]))
        else:
            s = np.searchsorted(key, symbols[at] & np.uint64((1 << 8 * (w - 1)) - 1) | np.uint64(w - 1) << top)
            n_s, q_s = n[s], q[s]
        n_x[at], q_x[at] = n_s - n_x[at], q_s - q[at]
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = n > 0
        log = lambda x: np.where(seen, x, np.nan).astype(np.float32)
        rest = n_x + q_x
        tables = {
            "log_count": np.where(count > 0, np.log2(count), np.nan).astype(np.float32),
            "total": log(np.log2(n + q)),
            "escape": log(np.log2((n + q) / q)),
            "total_x": log(np.where(rest > 0, np.log2(rest), 0)),
            "escape_x": log(np.where(q_x > 0, np.log2(rest / q_x), 0)),
        }
        root = np.stack([np.log2(root_n + root_q), np.log2((root_n + root_q) / root_q), np.where(root_q < 256, np.log2(256 - root_q), 0)])
    return Tree(order, key, root=root, **tables)


def sample(df: DataFrame, key: str, text: str = "text", lang: str = "lang", docs: int = TRAIN_DOCS, size: int = TRAIN_BYTES) -> DataFrame:
    """At most ``docs`` whole documents and ``size`` bytes of each language: those first by a hash of ``key``.

    Rows with a null key, text or language are left out. The first cut needs the keys alone: rows are counted by language and
    range of the hash, and only the lowest ranges that hold ``docs`` rows of a language are ranked. So a task ranks at most
    about docs + n / SLOTS rows of a language that has n.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull())
    order = [F.xxhash64(key), F.col(key)]
    first = rows.select(F.col(key).alias("_k"), F.col(lang).alias("_l"), F.octet_length(text).alias("_b"))
    # The first by hash are in the lowest of SLOTS ranges of it, so only these are ranked. Counts of ranges say how many it takes.
    slot = F.floor((F.xxhash64("_k") / F.lit(float(1 << 63)) + 1) / 2 * SLOTS)
    counts = first.groupBy("_l", slot.alias("_s")).agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_l").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    last = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).where(F.col("_before") < docs).groupBy(F.col("_l").alias("_of")).agg(F.max("_s").alias("_last"))
    first = first.join(F.broadcast(last), (F.col("_l") == F.col("_of")) & (slot <= F.col("_last"))).drop("_of", "_last")  # a row for each language
    w = Window.partitionBy("_l").orderBy(F.xxhash64("_k"), "_k")
    first = first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= docs)
    first = first.withColumn("_sum", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("_sum") <= size) | (F.col("_n") == 1))
    few = first.select("_k", "_l").distinct()
    return rows.join(F.broadcast(few), (F.col(key) == F.col("_k")) & (F.col(lang) == F.col("_l"))).orderBy(*order).select(F.col(lang).alias("lang"), F.col(text).alias("text"))


def train(df: DataFrame, key: str, text: str = "text", lang: str = "lang", order: int = ORDER, docs: int = TRAIN_DOCS, size: int = TRAIN_BYTES) -> Model:
    """A model of every language in ``df``; only the bounded sample reaches the driver. No labelled row gives a model of no language."""
    return fit([(r["lang"], r["text"]) for r in sample(df, key, text, lang, docs, size).toLocalIterator()], order)


_models: dict[str, _Scorer] = {}


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.known, self.costs = model, {}, np.zeros((0, len(model.languages)))
        self.most = CACHE_BYTES // (120 + 16 * len(model.languages))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names = self.model.languages
        if not names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        split = [t.encode("utf-8", "replace").split() if t and _LETTER.search(t) else [] for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known, self.costs = {}, self.costs[:0]
            new = set().union(*split)
        words = sorted(new)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        parts, block = [self.costs], max(1000, 40_000 // len(names))
        parts += [self.model.costs(words[i : i + block]) for i in range(0, len(words), block)]
        self.costs = np.concatenate(parts)
        label, score = [], []
        for s in split:
            if not s:
                label.append(UNKNOWN)
                score.append(0.0)
                continue
            bits = self.costs[np.fromiter(map(self.known.__getitem__, s), np.int64, len(s))].sum(0)
            best = int(np.argmin(bits))
            label.append(names[best])
            score.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
        return label, score


def predict(df: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add ``label`` and ``score``: the language with the shortest code and its share of the probability of all.

    A null text, one without a letter, or a model of no language gives ``und`` and 0. Columns that already have these
    names are replaced; no other column is read than ``text``.
    """
    attach(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)  # as large as the training sample's bounds allow

    def make():
        m = sent.value
        if m.name not in _models:
            _models.clear()
            _models[m.name] = _Scorer(m)
        return _models[m.name]

    return with_columns(df, make, [T.StructField(label, T.StringType(), False), T.StructField(score, T.DoubleType(), False)], text, _models.clear)
