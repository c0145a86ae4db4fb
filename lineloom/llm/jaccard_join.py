"""Links between documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

A document's set holds the 64-bit hashes of its distinct n-grams. The join works on one document of each distinct set:

1. Seeds. Documents that share the smallest hash under one of a few permutations are compared with the first of them.
   The links found join most near copies into groups, in a number of comparisons that grows with the documents.
2. Tiles. Under any one order of all hashes, linked sets share a hash among the first n - ceil(t n) + 1 of each. The
   order puts hashes that very many documents have last (by a sketch of fixed size). Every such hash is the key of a
   tile; a hash whose documents are all of one group already is passed over, and so is one whose documents are exactly
   those of another tile. Inside a tile sizes are banded, as linked sets differ in size by the threshold at most. A
   tile's rows carry bitmap signatures, the parities of hashed positions: the
   bits in which two signatures differ bound from below the elements in which the sets differ, and so bound their
   overlap from above. Pairs of different groups that the bound leaves are candidates.
3. Candidates are decided by intersecting their sorted hash arrays.

Groups are connected components. No pair within a known group is made, and no link between different groups is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm._common import attach, checkpointed, discard, forget, slices, stored, working
from lineloom.llm.graph import components, filter_of, in_filter

WIDTH, PERCENT = 5, 80
#: Permutations for seeds.
SEEDS = 8
#: Counters of the sketch of frequent hashes, as a power of two, and how many times the mean count is frequent.
SKETCH_BITS, FREQUENT = 20, 4
_CHUNKS = 16
#: Bytes of prefixes that a bucket of hashes holds, about.
BUCKET_BYTES = 2 << 20
#: Documents of a tile that is not cut, and the most tiles that are.
TILE_ROWS, MOST_LARGE = 4096, 100_000
#: Bytes of sets that a block of documents has where pairs are decided, about.
TILE_BYTES = 48 << 20
#: Words whose hashes a worker keeps.
CACHE = 200_000
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE:
            self.clear()
        self[word] = h
        return h


_hashes = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text's words, A-Z in lower case; fewer words than ``width`` make one."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = mixed(total + h[j : j + n] + _MULTIPLY[j % 5]) if j % 2 else (total ^ h[j : j + n]) * _MULTIPLY[j % 5]
    total = mixed(total)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def prefix(found: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """The first n - ceil(t n) + 1 hashes of a set, frequent ones last and else by value."""
    need = len(found) - -(-percent * len(found) // 100) + 1
    late = in_filter(frequent, found)
    if not late.any():
        return found[:need]
    early = found[~late]
    return early[:need] if len(early) >= need else np.concatenate((early, found[late][: need - len(early)]))


def signature(found: np.ndarray) -> bytes:
    """Parities of the hashes that fall on each of so many positions: a power of two not below twice the set's size, at least 64."""
    bits = max(64, 1 << int(2 * len(found) - 1).bit_length())
    odd = np.bincount((mixed(found) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> int:
    """A signature as an integer of ``size`` bytes, a longer one folded onto itself."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = (int.from_bytes(bits[:half], "little") ^ int.from_bytes(bits[half:], "little")).to_bytes(half, "little")
    return int.from_bytes(bits, "little")


def least_overlap(total, percent: int):
    """Smallest intersection of linked sets with ``total`` elements between them (counted twice where shared)."""
    return -(-percent * total // (100 + percent))


def tile_pairs(ids: list[int], sizes: list[int], groups: list[int], bits: list[bytes], percent: int, blocks: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (smaller id first) of a tile that may be linked: of different groups, and of different blocks if there are any, and in one band of sizes."""
    order = sorted(range(len(ids)), key=sizes.__getitem__)
    ids, sizes, groups, bits, blocks = ([x[i] for i in order] for x in (ids, sizes, groups, bits, blocks or range(len(ids))))
    n, low = len(ids), 0
    small = n <= 24
    width = np.array([len(x) for x in bits])
    place = np.zeros(n, np.int64)
    rows: dict[int, np.ndarray] = {}  # signatures of each width, those of twice the width folded
    if not small:
        size, group, key, part = np.array(sizes), np.array(groups), np.array(ids), np.array(blocks)
        for w in np.unique(width).tolist():
            of = np.flatnonzero(width == w)
            place[of] = np.arange(len(of))
            rows[w] = np.frombuffer(b"".join(bits[i] for i in of), np.uint64).reshape(len(of), -1)
    for i in range(1, n):
        while 100 * sizes[low] < percent * sizes[i]:  # the band of i: sizes that a link allows
            low += 1
        if small:
            for j in range(low, i):
                if groups[i] != groups[j] and ids[i] != ids[j] and blocks[i] != blocks[j]:
                    w = min(len(bits[i]), len(bits[j]))
                    apart = (folded(bits[i], w) ^ folded(bits[j], w)).bit_count()
                    if (sizes[i] + sizes[j] - apart) // 2 >= least_overlap(sizes[i] + sizes[j], percent):
                        yield (ids[i], ids[j]) if ids[i] < ids[j] else (ids[j], ids[i])
            continue
        band = low + np.flatnonzero((group[low:i] != group[i]) & (key[low:i] != key[i]) & (part[low:i] != part[i]))
        for w in np.unique(width[band]).tolist():  # not above the width of i, as sizes ascend
            mine = np.frombuffer(folded(bits[i], w).to_bytes(w, "little"), np.uint64)
            alike = band[width[band] == w]
            for at in range(0, len(alike), 4096):
                j = alike[at : at + 4096]
                total = size[j] + size[i]
                apart = np.bitwise_count(rows[w][place[j]] ^ mine).sum(1, dtype=np.int64)
                for k in key[j[(total - apart) // 2 >= least_overlap(total, percent)]].tolist():
                    yield (k, ids[i]) if k < ids[i] else (ids[i], k)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def describe(df: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(id, n, set_hash, seeds) of every row of ``df`` (id, text), and the filter of frequent hashes."""
    odd = mixed(np.arange(1, SEEDS + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("jaccard_join", _hashes.clear)
        count = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in slices(batches):
            sizes, hashes, seeds, all_ = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, width)
                sizes.append(len(s))
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()))
                seeds.append(_signed((s[None, :] * odd[:, None]).min(1)) if len(s) else None)
                all_.append(s)
            count += np.bincount((np.concatenate(all_) & np.uint64(len(count) - 1)).astype(np.int64), minlength=len(count)).astype(np.uint32)
            yield row(b.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(seeds, pa.list_(pa.int64())), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary()))
        parts = [c.tobytes() for c in count.astype("<u4").reshape(_CHUNKS, -1)]
        yield row(pa.nulls(_CHUNKS, pa.int64()), pa.nulls(_CHUNKS, pa.int64()), pa.nulls(_CHUNKS, pa.binary()), pa.nulls(_CHUNKS, pa.list_(pa.int64())), pa.array(range(_CHUNKS), pa.int32()), pa.array(parts, pa.binary()))

    def row(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), names=["id", "n", "set_hash", "seeds", "chunk", "counts"])

    both = checkpointed(df.mapInArrow(run, "id long, n long, set_hash binary, seeds array<long>, chunk int, counts binary"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[c] = sums.get(c, np.uint64(0)) + np.frombuffer(x.as_buffer(), "<u4").astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([np.minimum(s, 0xFFFFFFFF).astype("<u4").tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])

    # Sketches are as many as tasks: about the root of their number is summed at once, and then those sums.
    root = math.ceil(both.rdd.getNumPartitions() ** 0.5)
    sketches = both.where("chunk IS NOT NULL").select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(root)).alias("part"))
    sums = sketches.repartition(_CHUNKS * root, "chunk", "part").select("chunk", "counts").mapInArrow(add, "chunk int, counts binary")
    sketch = sums.repartition(_CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary").collect()  # 2**SKETCH_BITS counters
    count = np.zeros((_CHUNKS, (1 << SKETCH_BITS) // _CHUNKS), np.uint64)
    for r in sketch:
        count[r["chunk"]] = np.frombuffer(r["counts"], "<u4")
    count = count.ravel()
    frequent = np.packbits(count > FREQUENT * count.mean() + 64, bitorder="little").view(np.uint64)
    return both.where("n IS NOT NULL").select("id", "n", "set_hash", "seeds"), frequent


def sets_of(df: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, hashes binary) of the rows of ``df`` (id, text) whose id is in ``ids``, and by chance of some others."""
    wanted = df.sparkSession.sparkContext.broadcast(filter_of(ids.select(F.xxhash64("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("jaccard_join", _hashes.clear)
        for b in slices(batches):
            keep = np.flatnonzero(in_filter(wanted.value, b.column(2).to_numpy().view(np.uint64)))
            b = b.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, width).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "hashes"])

    return df.where("id IS NOT NULL").select("id", "text", F.xxhash64("id").alias("k")).mapInArrow(run, "id long, hashes binary")


def linked(pairs: DataFrame, df: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose sets are similar enough."""
    sets = sets_of(df, pairs.select(F.explode(F.array("a", "b")).alias("id")), width)
    one, other = (sets.select(F.col("id").alias(c), F.col("hashes").alias(f"{c}_set")) for c in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                keep.append(similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            b = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"])

    met = pairs.join(one, "a").join(other, "b").select("a", "b", "a_set", "b_set")
    return met.mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays of distinct hashes are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def linked_in_tiles(pairs: DataFrame, df: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of ``pairs`` that connect what they connect all together.

    The pairs are cut into the components of their graph, and large ones into pairs of blocks, so that a document's set
    travels once or a few times, not once for each pair. In a tile, pairs that are connected already are passed over.
    """
    label = checkpointed(components(pairs))
    blocks = label.join(sizes, "id").groupBy("component").agg(F.ceil(F.sum("n") * 8 / TILE_BYTES).alias("k"))
    met = pairs.join(label.withColumnRenamed("id", "a"), "a").join(blocks, "component")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("k"))
    met = checkpointed(met.select("a", "b", "component", F.least(block("a"), block("b")).alias("x"), F.greatest(block("a"), block("b")).alias("y")))
    tile = ["component", "x", "y"]
    other = [f"{c}_of" for c in tile]
    need = met.select(*[F.col(c).alias(o) for c, o in zip(tile, other, strict=True)], F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = sets_of(df, label.select("id"), width).join(need, "id")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, list[np.ndarray]] = {}
        for i, x in zip(right.column("id").to_pylist(), right.column("hashes").combine_chunks(), strict=True):
            found.setdefault(i, []).append(np.frombuffer(x.as_buffer(), np.uint64))
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while (up := parent.get(i, i)) != i:
                parent[i] = i = parent.get(up, up)
            return i

        out: list[tuple[int, int]] = []
        for a, b in sorted(zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True)):
            if root(a) != root(b) and any(similar(x, y, percent) for x in found.get(a, ()) for y in found.get(b, ())):
                parent[root(b)] = root(a)
                out.append((a, b))
        return pa.table([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return met.groupBy(*tile).cogroup(sets.select("id", "hashes", *other).groupBy(*other)).applyInArrow(solve, "a long, b long")


def _tally(x: np.ndarray) -> np.ndarray:
    """Rows (hash, id, group) as (hash, smallest group, largest, documents, two marks of the set of documents)."""
    mark = mixed(np.ascontiguousarray(x[:, 1]).view(np.uint64))
    other = mixed(mark ^ _MULTIPLY[0])
    return np.stack([x[:, 0], x[:, 2], x[:, 2], np.ones(len(x), np.int64), _signed(mark), _signed(other)], axis=1)


def _tallied(x: np.ndarray) -> np.ndarray:
    """Tallies with those of one hash made one, by hash."""
    if not len(x):
        return x
    x = x[np.argsort(np.ascontiguousarray(x[:, 0]).view(np.uint64), kind="stable")]
    first = np.flatnonzero(np.concatenate(([True], x[1:, 0] != x[:-1, 0])))
    over = lambda f, i: f.reduceat(np.ascontiguousarray(x[:, i]), first)
    return np.stack([x[first, 0], over(np.minimum, 1), over(np.maximum, 2), over(np.add, 3), over(np.add, 4), over(np.bitwise_xor, 5)], axis=1)


def _tiles(df: DataFrame, groups: DataFrame, frequent: np.ndarray, width: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) between documents of different groups. ``groups``: (id, group, set_hash) of the documents that take part.

    Each step's shuffles are deleted before the next one writes its own, and so are the prefixes, once the pairs are known.
    """
    spark = df.sparkSession
    late = spark.sparkContext.broadcast(frequent)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("jaccard_join", _hashes.clear)
        for b in slices(batches):
            found = [shingles(t, width) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([prefix(s, percent, late.value).tobytes() if len(s) else b"" for s in found], pa.binary()), pa.array([signature(s) if len(s) else b"" for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "prefix", "bits"])

    # The prefixes, a fifth of the hashes, go through the join with the groups; texts don't.
    rows = df.where("id IS NOT NULL").mapInArrow(prefixes, "id long, n long, prefix binary, bits binary").where("n > 0")
    rows = stored(rows.join(groups, "id"), "prefixes")
    forget(spark)

    # Hashes with the ids and groups of their documents go to buckets as packed arrays, by their highest bits.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("prefix"))).collect()[0][0] or 0
    bits_ = max(int(np.ceil(np.log2(max(parts, size / BUCKET_BYTES)))), 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        weight = 0

        def flush() -> pa.RecordBatch:
            x = np.concatenate(held) if held else np.zeros((0, 3), np.int64)
            held.clear()
            x = x[np.argsort(x[:, 0].view(np.uint64), kind="stable")]
            first = np.flatnonzero(np.concatenate(([True], x[1:, 0] != x[:-1, 0]))) if len(x) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(x)))
            one = x[first[n == 1]]
            own = one[:, 1] == one[:, 2]
            # what a task has of one hash leaves it as one row
            tables = one[own][:, :2], one[~own], _tallied(_tally(x[np.repeat(n > 1, n)]))
            marks = [(t[:, 0].view(np.uint64) >> np.uint64(64 - bits_)).astype(np.int64) for t in tables]
            buckets = np.unique(np.concatenate(marks))
            columns = [pa.array(buckets)]
            for t, m in zip(tables, marks, strict=True):
                cut = np.searchsorted(m, np.append(buckets, 1 << 62))
                columns.append(pa.array([t[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "alone", "grouped", "many"])

        for b in slices(batches, 1024):
            size = [len(x.as_buffer()) // 8 for x in b.column(2)]
            h = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
            held.append(np.stack([h, np.repeat(b.column(0).to_numpy(), size), np.repeat(b.column(1).to_numpy(), size)], axis=1))
            weight += len(h)
            if weight > 250_000:
                yield flush()
                weight = 0
        yield flush()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            x = _tallied(np.concatenate(held)) if held else np.zeros((0, 6), np.int64)
            held.clear()
            x = x[x[:, 1] != x[:, 2]]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in (0, 3, 4, 5)], names=["h", "n", "mark", "other"])

        for b in slices(batches, 64):
            for bucket, alone, grouped, many in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now:
                    yield close()
                    now = bucket
                alone = np.frombuffer(alone, np.int64).reshape(-1, 2)
                held += [_tally(np.concatenate((alone, alone[:, 1:]), axis=1)), _tally(np.frombuffer(grouped, np.int64).reshape(-1, 3)), np.frombuffer(many, np.int64).reshape(-1, 6)]
        yield close()

    dealt = rows.select("id", "group", "prefix").mapInArrow(deal, "bucket long, alone binary, grouped binary, many binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    tiles_ = dealt.mapInArrow(shared, "h long, n long, mark long, other long")
    # Hashes with the same documents make the same tile: one of them is enough.
    tiles_ = checkpointed(tiles_.groupBy("n", "mark", "other").agg(F.min("h").alias("h")).select("h", "n"))
    forget(spark)
    open_ = spark.sparkContext.broadcast(filter_of(tiles_.select("h")))
    # Large tiles are cut into pairs of blocks. The limit grows so that there are MOST_LARGE of them at most.
    limit = max(TILE_ROWS, size // 8 // MOST_LARGE)
    large = spark.sparkContext.broadcast({r["h"]: -(-r["n"] // limit) for r in tiles_.where(F.col("n") > limit).collect()})

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "x", "y", "id", "n", "group", "bits", "block"]
        for b in slices(batches):
            out: list[list] = [[] for _ in names]
            for i, n, p, bits, g in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                p = np.frombuffer(p, np.uint64)
                p = _signed(p[in_filter(open_.value, p)]).tolist()
                made = []
                for h in p:
                    k = large.value.get(h, 1)
                    own = hash(i) % k
                    made += [(h, min(own, j), max(own, j), i, n, g, bits, own) for j in range(k)]
                for o, x in zip(out, zip(*made), strict=False):
                    o += x
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=names)

    tiled = rows.select("id", "n", "prefix", "bits", "group").mapInArrow(tiles, "h long, x int, y int, id long, n long, group long, bits binary, block int")
    tiled = tiled.repartition(parts, "h", "x", "y").sortWithinPartitions("h", "x", "y")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, [[] for _ in range(5)]
        made: set[tuple[int, int]] = set()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([p[x] for p in made], pa.int64()) for x in (0, 1)], names=["a", "b"])
            made.clear()
            return out

        for b in slices(batches, 4096):
            for h, x, y, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (h, x, y) != now:
                    if len(tile[0]) > 1:
                        made.update(tile_pairs(*tile[:4], percent, tile[4] if now[1] < now[2] else None))
                    now, tile = (h, x, y), [[] for _ in range(5)]
                for column, x in zip(tile, rest, strict=True):
                    column.append(x)
            if len(made) > 100_000:
                yield flush()
        if len(tile[0]) > 1:
            made.update(tile_pairs(*tile[:4], percent, tile[4] if now[1] < now[2] else None))
        yield flush()

    pairs = checkpointed(tiled.mapInArrow(solve, "a long, b long").distinct())
    discard(rows)
    forget(spark)
    return pairs


def join(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, n_links_found): one row for each row of ``df``.

    component_id is the smallest id that links lead to, the row's own included. A null, empty or blank text has an
    empty set and no link. Rows that share an id are one document for links. A row with a null id gets a null component.
    n_links_found counts links that were used to find the components, equal sets included; it is no total of all links.
    """
    attach(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    known, frequent = describe(docs, width)
    one = known.where("n > 0 AND id IS NOT NULL")
    heads = checkpointed(one.groupBy("set_hash").agg(F.min("id").alias("id"), F.first("seeds").alias("seeds")))
    copies = one.join(heads.select("set_hash", F.col("id").alias("head")), "set_hash").select(F.col("head").alias("a"), F.col("id").alias("b"))

    stars = heads.select("id", F.posexplode("seeds").alias("i", "seed"))
    first = stars.groupBy("i", "seed").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").drop("z")
    pairs = checkpointed(stars.join(first, ["i", "seed"]).where("id <> a").select("a", F.col("id").alias("b")).distinct())
    near = checkpointed(linked(pairs, docs, width, percent))
    forget(df.sparkSession)

    groups = heads.select("id").join(components(near), "id", "left").select("id", F.coalesce("component", "id").alias("group"))
    candidates = _tiles(docs, checkpointed(groups), frequent, width, percent)
    links = near.union(linked_in_tiles(candidates, docs, one.groupBy("id").agg(F.max("n").alias("n")), width, percent)).union(copies)
    links = checkpointed(links)
    forget(df.sparkSession)
    label = components(links)
    count = links.where("a <> b").select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    out = known.join(label, "id", "left").join(count, "id", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links_found"))
