"""Byte-level BPE encoding and decoding with a published vocabulary.

Encoding cuts a text into pre-tokens and merges each one's symbols: a priority queue holds the merge ranks of
neighbouring symbols, the symbols form a doubly linked list, and queue entries whose pair has changed meanwhile are
skipped. Decoding concatenates the vocabulary's byte strings and reads the result as UTF-8.

Results are those of the ``tokenizers`` library without added special tokens, truncation or padding. Strings of the
vocabulary's special tokens inside a text give the special ids. Pre-tokens repeat, so each worker keeps the ids of
those it has met, up to ``CACHE`` of them; the cache never changes a result.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lineloom.llm._common import attach, with_columns

CACHE = 200_000
#: White space of Unicode, as the vocabulary's pre-tokenizer sees it.
SPACE = "\t-\r \x85\xa0  -     　"
#: The pre-token pattern of byte-level BPE vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?=[{SPACE}]|\\Z)").replace(r"\s+", f"[{SPACE}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Bpe:
    """A vocabulary read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec.get("pre_tokenizer") or {}).get("type"), spec["model"].get("type", "BPE")
        if kind != ("ByteLevel", "BPE") or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        vocab, sign = spec["model"]["vocab"], byte_alphabet()
        back = {c: b for b, c in sign.items()}
        self.first = [vocab[sign[b]] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.words: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for w, i in vocab.items():
            self.words[i] = bytes(back[c] for c in w) if all(c in back for c in w) else w.encode()
        for w, i in self.special.items():
            self.words[i] = w.encode()
        self.cut_special = regex.compile("(" + "|".join(regex.escape(w) for w in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pretoken = regex.compile(PRETOKEN)
        self.before_word = regex.compile(f" (?![{SPACE}])")
        self.odd_space = regex.compile(f" (?:[{SPACE}]|\\Z)")
        self.chunks: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Symbols left of one pre-token's bytes."""
        first, known = self.first, self.merges.get
        ids = [first[b] for b in data]
        n = len(ids)
        queue = []
        for i in range(n - 1):
            found = known(ids[i] << 32 | ids[i + 1])
            if found:
                queue.append((found[0], i, found[1]))
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            rank, i, made = heappop(queue)
            left = ids[i]
            if left < 0 or (j := after[i]) >= n:
                continue
            found = known(left << 32 | ids[j])
            if found is None or found[0] != rank:  # stale: the pair has changed
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = known(made << 32 | ids[k])
                if found:
                    heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = known(ids[h] << 32 | made)
                if found:
                    heappush(queue, (found[0], h, found[1]))
        return [x for x in ids if x >= 0]

    def chunk(self, text: str) -> bytes:
        """Packed ids of a stretch that starts and ends between pre-tokens."""
        out, kept = [], self.pretokens
        for w in self.pretoken.findall(text):
            got = kept.get(w)
            if got is None:
                got = np.array(self.merge(w.encode("utf-8", "replace")), "<u4").tobytes()
                if len(kept) >= CACHE:
                    kept.clear()
                kept[w] = got
            out.append(got)
        got = b"".join(out)
        if len(text) <= 64:
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            self.chunks[text] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null gives none."""
        if not text:
            return b""
        if self.cut_special and any(w in text for w in self.special):
            return b"".join(np.uint32(self.special[p]).astype("<u4").tobytes() if p in self.special else self._plain(p) for p in self.cut_special.split(text) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        # A space before anything but white space opens a pre-token, so such stretches are independent.
        parts = self.before_word.split(text) if self.odd_space.search(text) else text.split(" ")
        known, chunk = self.chunks.get, self.chunk
        out = [known(parts[0]) or chunk(parts[0])] if parts[0] else []
        for p in parts[1:]:
            p = " " + p
            out.append(known(p) or chunk(p))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """Text of packed ids; bytes that aren't UTF-8 become U+FFFD; null gives an empty text."""
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", packed: bool = False) -> DataFrame:
    """Add column ``ids``: array<int>, or with ``packed`` binary of little-endian unsigned 32-bit integers.

    Null and empty texts give no ids. A column that already has the name is replaced; all others stay as they are.
    """
    attach(df.sparkSession)

    def make():
        bpe = vocabulary(path)
        if packed:
            return lambda texts: ([bpe.encode(t) for t in texts],)
        return lambda texts: ([np.frombuffer(bpe.encode(t), "<u4").astype(np.int32) for t in texts],)

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)
    return with_columns(df, make, [T.StructField(ids, kind, False)], text, vocabulary.cache_clear)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add column ``text``: the text of the ids in column ``ids`` (array<int> or packed); null ids give an empty text."""
    attach(df.sparkSession)
    packed = isinstance(df.schema[ids].dataType, T.BinaryType)

    def make():
        bpe = vocabulary(path)
        if packed:
            return lambda rows: ([bpe.decode(x) for x in rows],)
        return lambda rows: ([bpe.decode(np.array(x or [], "<u4").tobytes()) for x in rows],)

    return with_columns(df, make, [T.StructField(text, T.StringType(), False)], ids, vocabulary.cache_clear)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that a task needs one Python worker: adds array<int> ``ids`` and ``decoded``."""
    attach(df.sparkSession)

    def make():
        bpe = vocabulary(path)

        def work(texts: list[str | None]) -> tuple[list[np.ndarray], list[str]]:
            packed = [bpe.encode(t) for t in texts]
            return [np.frombuffer(p, "<u4").astype(np.int32) for p in packed], [bpe.decode(p) for p in packed]

        return work

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)]
    return with_columns(df, make, fields, text, vocabulary.cache_clear)
