"""Token counts under a published sentencepiece BPE vocabulary, without making the tokens.

Rank-synchronous array merging: the distinct pre-tokens of a batch lie one after another in a ragged numpy array of
symbols; each round applies all places of every pre-token's lowest-rank pair at once, and a pre-token drops out when it has
no pair left. So a very long one takes as many rounds as it uses ranks, not as it has pairs. The symbols that survive are
counted, an unknown character as its UTF-8 bytes.

No piece holds the word mark after another character, so pre-tokens (a run of marks and what follows it) are merged
independently.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lineloom.llm._common import attach, with_columns

MARK = "▁"
CACHE = 400_000
_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_NONE = np.int64(1) << 62


class PieceCounter:
    """A ``.model`` file with BPE pieces, byte fallback, identity normalisation and a mark before the first word."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n, t = spec.normalizer_spec, spec.trainer_spec
        kinds = {p.type for p in spec.pieces}
        if t.model_type != 2 or not t.byte_fallback or t.treat_whitespace_as_suffix or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces or kinds - {1, 2, 3, 6}:
            raise ValueError(f"{path}: not a BPE vocabulary of the supported kind")
        pieces = {p.piece: p.score for p in spec.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"{path}: a piece holds the word mark inside")
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.symbol = {p: i for i, p in enumerate(pieces)}
        for c in sorted({c for p in pieces for c in p}):
            self.symbol.setdefault(c, len(self.symbol))
        s = self.symbol
        self.size = len(s) + 1  # and one that stands for all characters of no piece
        pairs = [(s[p[:i]] * self.size + s[p[i:]], order[score], s[p]) for p, score in pieces.items() for i in range(1, len(p)) if p[:i] in s and p[i:] in s]
        pairs.sort()
        self.pair, self.rank, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        # Tokens that a symbol counts as: one, or its bytes if it is no piece.
        self.weight = np.array([1 if p in pieces else len(p.encode()) for p in s] + [0], np.int64)
        self.char = {c: i for c, i in s.items() if len(c) == 1}
        self.known: dict[str, int] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.rank[at], -1), self.made[at]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(words), np.int64)
        rows = [i for i, w in enumerate(words) if w]
        if not rows:
            return out
        text = "".join(words[i] for i in rows)
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        chars, index = np.unique(code, return_inverse=True)
        dead = self.size - 1
        ids = np.array([self.char.get(chr(c), dead) for c in chars], np.int64)[index]
        size = np.array([len(words[i]) for i in rows], np.int64)
        row = np.array(rows)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        # Characters of no piece never merge: their bytes are counted now.
        cost = np.where(np.array([chr(c) in self.char for c in chars]), 0, np.array([len(chr(c).encode("utf-8", "replace")) for c in chars]))[index]
        np.add.at(out, row, np.add.reduceat(cost, first))
        last = np.zeros(len(ids), bool)
        last[first + size - 1] = True
        rank, made = self.look_up(ids, np.append(ids[1:], dead))
        rank[last] = -1
        while True:
            best = np.minimum.reduceat(np.where(rank >= 0, rank, _NONE), first)
            going = best < _NONE
            if not going.all():  # what has no pair left is counted and leaves
                over = np.repeat(~going, size)
                ends = np.add.reduceat(self.weight[ids], first)
                out[row[~going]] += ends[~going]
                ids, rank, made, last = ids[~over], rank[~over], made[~over], last[~over]
                row, size, best = row[going], size[going], best[going]
                if not len(row):
                    return out
                first = np.concatenate(([0], np.cumsum(size)[:-1]))
            at, of = self.merged_at_once(ids, rank, made, last, first, size, best)
            ids[at] = made[at]
            last[at] = last[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank, made, last = ids[keep], rank[keep], made[keep], last[keep]
            size = size - np.bincount(of, minlength=len(size))
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            at = at - np.arange(len(at))  # one symbol went behind each earlier place
            for p in (at, at[at > first[of]] - 1):
                r, m = self.look_up(ids[p], ids[np.minimum(p + 1, len(ids) - 1)])
                rank[p] = np.where(last[p], -1, r)
                made[p] = m

    def merged_at_once(self, ids: np.ndarray, rank: np.ndarray, made: np.ndarray, last: np.ndarray, first: np.ndarray, size: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that each pre-token applies in this round, and the pre-tokens they are of.

        These are all pairs of its lowest rank that don't overlap, from the left; but if a new pair that one of them makes has
        no higher rank, that pair would be next, and the places behind it wait.
        """
        lowest = np.repeat(best, size)
        at = np.flatnonzero(rank == lowest)
        begins = np.concatenate(([True], np.diff(at) != 1))
        at = at[(np.arange(len(at)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]) % 2 == 0]  # of places in a row, every second
        of = np.searchsorted(first, at, side="right") - 1
        new, end = made[at], len(ids) - 1
        after, _ = self.look_up(new, ids[np.minimum(at + 2, end)])
        left = ids[np.maximum(at - 1, 0)]
        joined = np.concatenate(([False], np.diff(at) == 2)) & (at - 2 >= first[of])
        left[joined] = new[:-1][joined[1:]]
        before, _ = self.look_up(left, new)
        soon = (after >= 0) & ~last[at + 1] & (after <= best[of]) | (before >= 0) & (at > first[of]) & (before <= best[of])
        waits = np.cumsum(soon) - soon
        start = np.concatenate(([True], of[1:] != of[:-1]))
        keep = waits == np.repeat(waits[start], np.diff(np.append(np.flatnonzero(start), len(of))))
        return at[keep], of[keep]

    def split(self, text: str) -> list[str]:
        """Pre-tokens, without the one mark that each begins with."""
        if "  " in text or MARK in text or text[0] == " ":
            return [w[1:] for w in _RUNS.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def count_texts(self, texts: list[str | None]) -> list[int]:
        split = [self.split(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = set().union(*split)
        words = list(new)
        self.known.update(zip(words, self.count([MARK + w for w in words]).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, s)) for s in split]


@lru_cache(2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add column ``out`` (long): tokens of each whole text, without begin, end or added special tokens.

    Null and empty texts have none; strings of special tokens inside a text are ordinary text. A column that already
    has the name is replaced; all others stay as they are.
    """
    attach(df.sparkSession)
    return with_columns(df, lambda: lambda texts: (counter(path).count_texts(texts),), [T.StructField(out, T.LongType(), False)], text, counter.cache_clear)
