"""Removal of every byte that a long repeated string covers, with a logarithmic family of suffix arrays.

A string of ``length`` bytes that starts at two places of the corpus is repeated; all its bytes go, at both places. To
spread the search, every window of ``length`` bytes is keyed by its anchor, the ``ANCHOR`` bytes in it whose hash is
smallest: equal windows have equal anchors at equal places. Neighbouring windows with one anchor make a stretch. Stretches
with an anchor that occurs nowhere else can't hold a repeat and are set aside. Equal stretches are one entry of the index,
with all its windows repeated if it occurs twice. Entries that share an anchor with other entries are dealt out by anchor
and indexed:

* a batch of entries gets a suffix array (of the suffixes where windows start, by their first ``length`` bytes), in which
  equal neighbours are repeats;
* it is merge-scanned against the levels that the index has, for matches of ``length`` bytes;
* it becomes the newest level, and levels of about equal size merge, so there are logarithmically many.

Levels go when no later entry can share their anchors. Documents are never compared pair by pair, and copies of a text or
stretch are counted where they are read, so large groups of copies gather nowhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm._common import attach, checkpointed, hidden, place, slices, working
from lineloom.llm.graph import filter_of, in_filter
from lineloom.llm.jaccard_join import mixed

LENGTH = 200
#: Bytes of an anchor (a power of two), bytes hashed at once, bytes of entries in a batch of the index.
ANCHOR, PIECE, BATCH = 64, 1 << 20, 1 << 20
_AT_BITS = np.uint64(21)
_BASE = 0x9E3779B97F4A7C15


def anchored(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``data`` (at most 2 * PIECE bytes), where its anchor starts; and the hash at each place."""
    h = mixed(data.astype(np.uint64) + np.uint64(1))
    size, power = 1, _BASE
    while size < ANCHOR:
        h = h[: len(h) - size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2
    h = mixed(h)
    best = h >> _AT_BITS << _AT_BITS | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
    width, size = length - ANCHOR + 1, 1
    while size * 2 <= width:
        best = np.minimum(best[: len(best) - size], best[size:])
        size *= 2
    if width > size:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    return (best & np.uint64((1 << int(_AT_BITS)) - 1)).astype(np.int64), h


Part = tuple[int, int, bytes]


def parts_of(texts: list[bytes], length: int) -> Iterator[list[Part]]:
    """(text number, offset, bytes) in groups of about PIECE bytes; a long text comes in overlapping parts. Each text has its parts in order."""
    group: list[Part] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - length + 1), PIECE):
            part = t[at : at + PIECE + length - 1]
            if group and size + len(part) > PIECE:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield group


class Stretches:
    """The stretches of a group of parts: text number, first window, windows, anchor and content hash of each."""

    def __init__(self, group: list[Part], length: int):
        self.joined = joined = b"".join(g[2] for g in group)
        self.length = length
        anchor, h = anchored(np.frombuffer(joined, np.uint8), length)
        size = np.array([len(g[2]) for g in group])
        ends = np.cumsum(size)
        starts = ends - size
        own = np.repeat(np.arange(len(group)), size)[: len(anchor)]
        valid = np.arange(len(anchor)) + length <= ends[own]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new & valid)
        # a text's valid windows are its first ones, so a stretch of valid windows ends where the next begins or the text's last window is
        last = np.minimum(np.append(np.flatnonzero(new)[1:], len(anchor))[np.searchsorted(np.flatnonzero(new), first)] - 1, ends[own[first]] - length)
        part = own[first]
        self.first, self.last = first, last
        self.text = np.array([g[0] for g in group])[part]
        self.at = first - starts[part] + np.array([g[1] for g in group])[part]
        self.windows = last - first + 1
        self.anchor = h[anchor[first]].view(np.int64)
        view = memoryview(joined)
        self.content = np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first)).view(np.int64)

    def bytes(self, i: int) -> bytes:
        return self.joined[self.first[i] : self.last[i] + self.length]


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the string of ``length`` bytes at every place where one starts: equal for equal strings, in byte order."""
    size = 8
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    rank = np.unique(np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    while size < length:
        step = min(size, length - size)
        key = rank[: len(rank) - step] << np.uint64(32) | rank[step:]
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        size += step
    return rank


class Level:
    """Suffixes of ``text`` at ``at``, in byte order of their first ``length`` bytes and all different; ``owner``: window numbers."""

    def __init__(self, text: np.ndarray, at: np.ndarray, owner: np.ndarray, length: int):
        self.text, self.at, self.owner, self.length = text, at, owner, length

    def keys(self, which: np.ndarray) -> np.ndarray:
        """The suffixes as rows of big-endian words, zero padded."""
        rows = np.lib.stride_tricks.sliding_window_view(self.text, self.length)[self.at[which]]
        pad = -self.length % 8
        if pad:
            rows = np.concatenate((rows, np.zeros((len(rows), pad), np.uint8)), axis=1)
        return np.ascontiguousarray(rows).view(">u8")

    def scan(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of ``other``: its place among this level's, and whether that one is equal."""
        place, equal = np.zeros(len(other.at), np.int64), np.zeros(len(other.at), bool)
        for start in range(0, len(other.at), 8192):
            which = np.arange(start, min(start + 8192, len(other.at)))
            want = other.keys(which)
            low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.at))
            while (open_ := low < high).any():
                mid = np.minimum((low + high) // 2, len(self.at) - 1)
                have = self.keys(mid)
                differs = have != want
                first = differs.argmax(1)
                row = np.arange(len(which))
                less = differs.any(1) & (have[row, first] < want[row, first])
                low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
            place[which] = low
            inside = low < len(self.at)
            equal[which[inside]] = (self.keys(low[inside]) == want[inside]).all(1)
        return place, equal

    def merged(self, other: Level) -> Level:
        place, equal = self.scan(other)
        place, at, owner = place[~equal], other.at[~equal], other.owner[~equal]
        return Level(np.concatenate((self.text, other.text)), np.insert(self.at, place, at + len(self.text)), np.insert(self.owner, place, owner), self.length)


class SuffixLevels:
    """The logarithmic family. ``repeated``: window numbers found at two places."""

    def __init__(self, length: int = LENGTH):
        self.length, self.levels, self.repeated = length, [], []

    def add(self, entries: list[bytes], windows: np.ndarray, number: int) -> None:
        """Index a batch; entry i has windows[i] windows, which are numbered on from ``number``."""
        text = np.frombuffer(b"".join(entries), np.uint8)
        start = np.cumsum([0, *map(len, entries)][:-1])
        ends = np.cumsum(windows)
        at = np.repeat(start - (ends - windows), windows) + np.arange(ends[-1])
        rank = suffix_ranks(text, self.length)[at]
        order = np.argsort(rank, kind="stable")
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = rank[order][1:] == rank[order][:-1]
        self.repeated.append(order[same[1:] | same[:-1]] + number)
        kept = order[~same[:-1]]
        new = Level(text, at[kept], kept + number, self.length)
        for level in self.levels:
            place, equal = level.scan(new)
            self.repeated += [new.owner[equal], level.owner[place[equal]]]
            new = Level(text, new.at[~equal], new.owner[~equal], self.length)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2].at) <= 2 * len(self.levels[-1].at):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)


def _runs(found: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run in sorted distinct numbers."""
    cut = np.flatnonzero(np.diff(found) != 1) + 1
    return list(zip(found[np.concatenate(([0], cut))].tolist(), found[np.concatenate((cut - 1, [len(found) - 1]))].tolist(), strict=True))


def index_entries(rows: Iterator[tuple[int, int, bytes]], length: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(anchor, content, runs of repeated windows) of the entries with any; ``rows`` (anchor, content, bytes) come sorted.

    Entries that are alone under their anchor are not indexed: nothing else can match them.
    """
    index = SuffixLevels(length)
    live: list[tuple[int, int, int, int]] = []  # anchor, content, first window's number, windows
    batch: list[tuple[int, int, bytes]] = []
    number = size = 0
    held: list[tuple[int, int, bytes]] = []  # entries of the anchor being read

    def settle() -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        nonlocal index, live
        if live and index.repeated:
            found = np.unique(np.concatenate(index.repeated))
            first = np.array([x[2] for x in live])
            owner = np.searchsorted(first, found, side="right") - 1
            for at in np.split(np.arange(len(found)), np.flatnonzero(np.diff(owner)) + 1):
                if len(at):
                    a, c, begin, _ = live[owner[at[0]]]
                    yield a, c, _runs(found[at] - begin)
        index, live = SuffixLevels(length), []

    def build() -> None:
        nonlocal batch, number, size
        if batch:
            windows = np.array([len(x[2]) - length + 1 for x in batch])
            index.add([x[2] for x in batch], windows, number)
            for (a, c, _), n in zip(batch, windows.tolist(), strict=True):
                live.append((a, c, number, n))
                number += n
        batch, size = [], 0

    last = None
    for row in rows:
        if last is not None and row[:2] == last[:2]:
            continue
        if last is None or row[0] != last[0]:
            if len(held) == 1:
                held = []  # alone under its anchor
            batch += held
            held = []
            if size > BATCH:
                build()
                yield from settle()
        last = row
        if len(held) == 1:
            batch += held
            size += len(held[0][2])
            held = []
            batch.append(row)
            size += len(row[2])
        elif batch and batch[-1][0] == row[0] or live and live[-1][0] == row[0]:
            batch.append(row)
            size += len(row[2])
        else:
            held = [row]
        if size > 2 * BATCH:  # an anchor with very many entries: they meet through the levels
            build()
    build()
    yield from settle()


def _digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def repeats(df: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(digest binary, spans array<struct<start, end>>): the removed runs of each different text that has any, in bytes."""
    spark = attach(df.sparkSession)
    if length < ANCHOR:
        raise ValueError(f"length must be {ANCHOR} at least")
    texts = df.select(F.col(text).alias("text")).where(F.octet_length("text") >= length)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("suffix_dedup")
        for b in slices(batches):
            data = [_encoded(t) for t in b.column(0).to_pylist()]
            digest = [_digest(d) for d in data]
            for group in parts_of(data, length):  # a row for each text, or for each part of a long one
                s = Stretches(group, length)
                texts = np.unique(s.text)
                cut = np.append(np.searchsorted(s.text, texts), len(s.text))
                pack = lambda x, kind: pa.array([x[i:j].astype(kind).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([digest[i] for i in texts.tolist()], pa.binary()), pack(s.at, "<i8"), pack(s.windows, "<i4"), pack(s.anchor, "<i8"), pack(s.content, "<i8")], names=["digest", "at", "windows", "anchor", "content"])

    found = checkpointed(texts.mapInArrow(stretches, "digest binary, at binary, windows binary, anchor binary, content binary"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(c.to_pylist()), np.int64)) for c in b.columns], names=["anchor", "content"])

    shared = checkpointed(found.select("anchor", "content").mapInArrow(pairs, "anchor long, content long").groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high")).where("n > 1").select("anchor", F.expr("low <> high").alias("differ")))
    any_ = spark.sparkContext.broadcast(filter_of(shared.select("anchor")))
    differ = spark.sparkContext.broadcast(filter_of(shared.where("differ").select("anchor")))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            digest = b.column(0).to_pylist()
            at, windows, anchor, content = (np.frombuffer(b"".join(b.column(i).to_pylist()), kind) for i, kind in ((1, "<i8"), (2, "<i4"), (3, "<i8"), (4, "<i8")))
            own = np.repeat(np.arange(len(digest)), [len(x.as_buffer()) // 8 for x in b.column(1)])
            keep = in_filter(any_.value, anchor.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([digest[i] for i in own[keep].tolist()], pa.binary()), *[pa.array(x[keep]) for x in (at, windows, anchor, content)]], names=["digest", "at", "windows", "anchor", "content"])

    occur = found.mapInArrow(places, "digest binary, at long, windows int, anchor long, content long").groupBy("digest", "at", "windows", "anchor", "content").agg(F.count("*").alias("n"))
    occur = checkpointed(occur)
    whole = occur.groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.max("windows").alias("windows")).where("n > 1").select("anchor", "content", F.lit(0).alias("low"), (F.col("windows") - 1).alias("high"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        groups = (g for b in slices(batches) for g in parts_of([_encoded(t) for t in b.column(0).to_pylist()], length))
        for group in groups:
            s = Stretches(group, length)
            out: list[list] = [[], [], []]
            for i in np.flatnonzero(in_filter(differ.value, s.anchor.view(np.uint64))).tolist():
                key = int(s.anchor[i]), int(s.content[i])
                if key not in sent:
                    if len(sent) >= 500_000:
                        sent.clear()  # only saves sending an entry twice
                    sent.add(key)
                    for o, x in zip(out, (*key, s.bytes(i)), strict=True):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "content", "bytes"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(entries, "anchor long, content long, bytes binary").repartition(parts, "anchor").sortWithinPartitions("anchor", "content")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in slices(batches, 2048) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple[int, int, int, int]] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["anchor", "content", "low", "high"])

        for a, c, runs in index_entries(rows, length):
            out += [(a, c, *r) for r in runs]
            if len(out) >= 10_000:
                yield made()
                out.clear()
        yield made()

    partly = dealt.mapInArrow(match, "anchor long, content long, low int, high int")
    covered = occur.select("digest", "at", "anchor", "content").join(whole.unionByName(partly), ["anchor", "content"])
    spans = covered.select("digest", (F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high") + length).alias("end")).distinct()
    spans = spans.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))  # of one text
    return spans


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that touch or overlap made one."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def dedup(df: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans and kept (binary: the bytes that stay) in place of ``text``.

    A null text is an empty one; texts under ``length`` bytes stay whole. Matches are found between and inside documents,
    on the texts as they come; repeated rows are documents of their own, so their texts repeat. Columns that already have
    these names are replaced.
    """
    spark = attach(df.sparkSession)
    spans = checkpointed(repeats(df, text, length))
    some = spark.sparkContext.broadcast(filter_of(spans.select(F.crc32("digest"))))
    made = ("n_bytes", "n_removed", "n_spans", "kept")
    kept = [f"_c{i}" for i, c in enumerate(df.columns) if c.lower() not in (*made, text.lower())]
    rows = hidden(df).select(F.coalesce(F.col(place(df, text)), F.lit("")).alias("_text"), *kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [_digest(_encoded(t)) for t in b.column(0).to_pylist()]
            hit = in_filter(some.value, np.array([zlib.crc32(d) for d in found], np.uint64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary()), pa.array(hit)], names=[*b.schema.names, "_digest", "_some"])

    rows = rows.mapInArrow(digests, f"{fields}, _digest binary, _some boolean")
    clean = rows.where("NOT _some").select(*kept, "_text", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    hurt = rows.where("_some").join(spans.withColumnRenamed("digest", "_digest"), "_digest", "left").select(*kept, "_text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = b.num_columns
            size, gone, runs, left = [], [], [], []
            for t, s in zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist(), strict=True):
                data = _encoded(t)
                s = joined([(x["start"], x["end"]) for x in s or ()])
                size.append(len(data))
                gone.append(sum(y - x for x, y in s))
                runs.append(len(s))
                ends = [0, *[y for _, y in s]]
                left.append(b"".join(data[x:y] for x, y in zip(ends, [*[x for x, _ in s], len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 2], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(left, pa.binary())], names=[*b.schema.names[: n - 2], *made])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema.fields[:-2])
    done = clean.union(hurt).mapInArrow(cut, ", ".join(x for x in (own, "n_bytes long, n_removed long, n_spans long, kept binary") if x))
    return done.select(*[F.col(k).alias(df.columns[int(k[2:])]) for k in kept], *made)
