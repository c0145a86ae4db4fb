"""The trie of conversations: a node for each distinct sequence of first turns.

Turns are carried as references to texts, with their digests; texts themselves move once, and only where they are compared.
References are range-sorted by conversation and place. In each partition numpy scans give every turn its depth and the
polynomial fingerprint of the prefix that it ends; a conversation that goes on over several partitions is put together
from its parts' lengths and sums, as P(a + b) = P(a) + B^|a| P(b). So no conversation must fit one task.

Turns of equal depth and fingerprint are a group. Where a group has turns from different rows, their roles and texts are
compared with those of its representative, the one of the smallest conversation; what differs is split off, with all
that follows it, and the check is repeated until nothing does. Equal fingerprints and equal last turns mean equal
fingerprints of the parents, so by induction along the depth a verified group has one sequence of turns.

Sums over subtrees are rolled up by doubling: a node's sum over its descendants nearer than 2^k goes to its ancestor 2^k
turns up, which takes as many rounds as the greatest depth has binary digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm._common import attach, checkpointed

#: Moduli and bases of the two halves of a fingerprint. Products of two residues fit 64 bits.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (911_382_323, 972_663_749)
#: Characters of ids that are joined before they are sent on.
CHUNK = 1 << 16
_NODE = ["depth", "f", "s"]
_LEAST = -(1 << 63)
_NOTHING = hashlib.sha256(b"").hexdigest()


def digest(role: Column, text: Column) -> Column:
    """128 bits of a digest of a turn's role and text, which aren't null."""
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.unhex(F.substring(whole, 1, 32))


def read(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``turns``, ``texts`` and ``members`` of a table of turns, as ``trie`` takes them. A reference is a row's conversation
    and turn. Rows without a conversation are left out, a null role or text is empty. Other columns are ignored."""
    rows = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("at"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.where("conv IS NOT NULL").withColumns({"digest": digest(F.col("role"), F.col("text")), "ref": F.struct("conv", F.coalesce("at", F.lit(_LEAST)).alias("at"))})
    turns = rows.select("conv", "at", "digest", F.length("text").cast("long").alias("chars"), "ref")
    return turns, rows.select("ref", "digest", "role", "text"), turns.select("conv").distinct()


def rebuilt(turns: DataFrame, members: DataFrame, block: int, length: Column, most: int) -> DataFrame:
    """``turns`` in which each conversation c begins with the first turns of conversation c - c % ``block`` instead of its own:
    ``length`` of them, an expression over ``conv`` that is ``most`` at most. Its own turns behind as many follow."""
    placed = scanned(turns).drop("at").withColumnRenamed("depth", "at").select("conv", "at", "digest", "chars", "ref")
    own = placed.where(F.col("at") > length)
    heads = placed.where((F.col("conv") % block == 0) & (F.col("at") <= most)).withColumnRenamed("conv", "_base")
    wanted = members.select("conv", length.cast("long").alias("_h"), (F.col("conv") - F.col("conv") % block).alias("_base"))
    return own.unionByName(heads.join(wanted, "_base").where("at <= _h").select("conv", "at", "digest", "chars", "ref"))


def powers(base: int, n: int, prime: int) -> np.ndarray:
    """base^0 .. base^(n - 1), by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, base % prime
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step) % np.uint64(prime)
        have, step = have + more, step * step % prime
    return out


def scan(conv: np.ndarray, digests: np.ndarray, primes: tuple[int, int] = PRIMES) -> tuple[np.ndarray, list[np.ndarray]]:
    """Depth of each row in its conversation (conversations lie one after another), and the prefix sums of
    digest * base^place under both moduli. ``digests`` are rows of 32-bit words."""
    n = len(conv)
    first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1]))) if n else np.zeros(0, int)
    size = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, size)
    sums = []
    for i, (p, b) in enumerate(zip(primes, BASES, strict=True)):
        power = powers(b, int(size.max(initial=0)), p)[place]
        # a word of 0 would leave the prefix as it was
        total = np.cumsum((digests[:, i].astype(np.uint64) % np.uint64(p - 1) + np.uint64(1)) * power % np.uint64(p), dtype=np.uint64)
        before = np.concatenate((np.zeros(1, np.uint64), total))[first]
        sums.append((total - np.repeat(before, size)) % np.uint64(p))
    return place + 1, sums


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1)


def _parts(batches: Iterator[pa.RecordBatch], primes: tuple[int, int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    """Batches of one sorted partition with depths and sums inside the partition: what a batch cuts is carried on."""
    last, depth, sums = None, 0, [0, 0]
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column(0).to_numpy()
        d, s = scan(conv, _words(b.column(2)), primes)
        goes_on = conv == last
        if goes_on.any():
            for i, (p, base) in enumerate(zip(primes, BASES, strict=True)):
                s[i] = np.where(goes_on, (sums[i] + s[i] * np.uint64(pow(base, depth, p))) % np.uint64(p), s[i]).astype(np.uint64)
            d = np.where(goes_on, d + depth, d)
        last, depth, sums = conv[-1], int(d[-1]), [x[-1] for x in s]
        yield b, d, s


def scanned(rows: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """Add depth (from 1 in each conversation), f and up (fingerprints of the prefix that the row ends, and of that before it),
    and whether the row is its conversation's last.

    ``rows`` (conv, at, digest, ..) are sorted by conversation, place (null first) and digest.
    """
    attach(rows.sparkSession)
    names, schema = rows.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.repartitionByRange("conv", "at", "digest").sortWithinPartitions("conv", "at", "digest")
    placed = checkpointed(placed.withColumn("_p", F.spark_partition_id()))  # the parts keep their numbers, whatever reads them

    def edges(batches):
        """The parts that a partition has of its first and its last conversation: length and sums."""
        head, tail = None, None
        for b, d, s in _parts(batches, primes):
            conv, p = b.column(0).to_numpy(), b.column(len(names))[0].as_py()
            n = int((conv == (conv[0] if head is None else head[0])).sum())
            if n:
                head = (int(conv[0]), int(d[n - 1]), int(s[0][n - 1]), int(s[1][n - 1]))
            tail = (int(conv[-1]), int(d[-1]), int(s[0][-1]), int(s[1][-1]))
        if head is not None:
            yield pa.RecordBatch.from_pylist([{"p": p, "conv": c, "size": n, "a": x, "b": y} for c, n, x, y in (head, tail)])

    found = placed.mapInArrow(edges, "p long, conv long, size long, a long, b long").collect()  # two rows a partition
    ends: dict[int, list] = {}
    for r in found:
        ends.setdefault(r["p"], []).append((r["conv"], r["size"], r["a"], r["b"]))
    before, goes_on, at = {}, {}, None
    order = sorted(ends)
    for p, after in zip(order, [*order[1:], None], strict=False):  # without rows there is nothing
        head, tail = ends[p]
        n, *sums = before[p] = at[1:] if at and at[0] == head[0] else (0, 0, 0)
        whole = [(x + y * pow(base, n, prime)) % prime for x, y, base, prime in zip(sums, head[2:], BASES, primes, strict=True)]
        at = (head[0], n + head[1], *whole) if head[0] == tail[0] else tail
        goes_on[p] = after is not None and ends[after][0][0] == tail[0]

    def finish(batches):
        head = held = last = None
        for b, d, s in _parts(batches, primes):
            conv, p = b.column(0).to_numpy(), b.column(len(names))[0].as_py()
            size, *sums = before[p]
            if head is None:
                head, last = conv[0], (conv[0], sums[0] << 31 | sums[1])
            own = conv == head
            f = [np.where(own, (np.uint64(c) + x * np.uint64(pow(base, size, prime))) % np.uint64(prime), x).astype(np.int64) for c, x, base, prime in zip(sums, s, BASES, primes, strict=True)]
            f = f[0] << 31 | f[1]
            earlier = np.append(last[0], conv[:-1])
            up = np.where(earlier == conv, np.append(last[1], f[:-1]), 0)
            last = (conv[-1], f[-1])
            if held is not None:
                yield _ending(held, held.column(0)[-1].as_py() != conv[0])
            held = pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(np.where(own, d + size, d)), pa.array(f), pa.array(up), pa.array(np.append(conv[1:] != conv[:-1], True))], names=[*names, "depth", "f", "up", "last"])
        if held is not None:
            yield _ending(held, not goes_on[p])

    return placed.mapInArrow(finish, f"{schema}, depth long, f long, up long, last boolean")


def _ending(b: pa.RecordBatch, ends: bool) -> pa.RecordBatch:
    """A batch whose last row is its conversation's last, or not."""
    if ends:
        return b
    last = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).copy()
    last[-1] = False
    return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(last)], names=b.schema.names)


def verified(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` (conv, depth, f, up, s, sup, digest, ref, ..) with s and sup such that rows of equal (depth, f, s) end the same sequence of turns.

    Only rows of groups with different references need their texts. A group nearly always has one kind of turn, so what is
    ordered by group is small; the texts of a large group are combined before they are shuffled.
    """
    while True:
        cells = rows.groupBy(*_NODE, "digest", "ref").agg(F.min("conv").alias("first"))
        several = cells.groupBy(*_NODE).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        suspects = checkpointed(cells.join(several, _NODE, "left_semi"))
        one = texts.join(suspects.select("ref", F.col("digest")).distinct(), ["ref", "digest"]).groupBy("ref", "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
        kinds = suspects.join(one, ["ref", "digest"]).groupBy(*_NODE, "role", "text").agg(F.min("first").alias("first"), F.min("digest").alias("digest"))
        place = F.row_number().over(Window.partitionBy(*_NODE).orderBy("first"))
        split = checkpointed(kinds.select(*_NODE, "digest", place.alias("_n")).where("_n > 1").drop("_n"))
        if split.isEmpty():
            return rows
        hits = rows.join(split, [*_NODE, "digest"]).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "digest"))).alias("_hits"))
        until = lambda old, d: F.coalesce(F.when(F.exists("_hits", lambda h: h["depth"] <= d), F.xxhash64(old, F.filter("_hits", lambda h: h["depth"] <= d))), old)
        joined = rows.join(hits, "conv", "left")
        rows = checkpointed(joined.withColumns({"s": until(F.col("s"), F.col("depth")), "sup": until(F.col("sup"), F.col("depth") - 1)}).select(*rows.columns))


def trie(turns: DataFrame, texts: DataFrame, members: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """Nodes of the trie: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` (conv, at, digest, chars, ref) are ordered by ``at`` in each conversation, null first, then by digest; ``ref`` and ``digest``
    name a row of ``texts`` (ref, digest, role, text). ``members`` (conv) has every conversation once, those without a turn too,
    which belong to the root only. A node is named by its smallest member and its depth. Without members there is no
    node, not even the root. Rows of ``texts`` that repeat count once.
    """
    rows = scanned(turns.select("conv", "at", "digest", "chars", "ref"), primes)
    rows = checkpointed(rows.select("conv", "depth", "f", "up", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("sup"), "digest", "chars", "ref", "last"))
    rows = verified(rows, texts)
    nodes = rows.groupBy(*_NODE, "up", "sup").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    zero = F.lit(0).cast("long")
    root = members.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(*[zero.alias(c) for c in (*_NODE, "up", "sup")], "conv_id", "n_convs", zero.alias("chars"))
    nodes = checkpointed(nodes.unionByName(root))
    above = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("f"), F.col("sup").alias("s"))
    nodes = nodes.join(above.agg(F.count("*").alias("n_children")), _NODE, "left").fillna(0, ["n_children"])
    nodes = checkpointed(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}))
    sums = _rolled_up(nodes, rows)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("up"), F.col("s").alias("sup"), F.col("conv_id").alias("parent_conv_id"))
    done = nodes.join(sums, _NODE).join(parents, ["depth", "up", "sup"], "left").join(_ends(rows, members), _NODE, "left")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))


def _rolled_up(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) over each node's subtree.

    In round k a node has the sums over its descendants nearer than 2^k, itself included. They are added to its ancestor
    2^k turns up, which is found under the node's own smallest member, so no key of that join is frequent.
    """
    most = nodes.agg(F.max("depth")).first()[0] or 0
    alive = nodes.where("depth > 0").select(*_NODE, "conv_id", F.col("up").alias("af"), F.col("sup").alias("as"), "leaves", "saved")
    total, step = nodes.select(*_NODE, "leaves", "saved"), 1
    while step <= most:
        received = alive.groupBy((F.col("depth") - step).alias("depth"), F.col("af").alias("f"), F.col("as").alias("s")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        received = checkpointed(received)
        total = total.unionByName(received)
        step *= 2
        if step <= most:
            more = received.where(F.col("depth") >= step).select(*_NODE, F.col("leaves").alias("_l"), F.col("saved").alias("_s"))
            found = rows.select(F.col("conv").alias("conv_id"), (F.col("depth") + step).alias("depth"), F.col("f").alias("_f"), F.col("s").alias("_a"))
            grown = alive.where(F.col("depth") >= step).join(more, _NODE, "left").join(found, ["conv_id", "depth"], "left").fillna(0, ["_l", "_s", "_f", "_a"])
            alive = checkpointed(grown.select(*_NODE, "conv_id", F.col("_f").alias("af"), F.col("_a").alias("as"), (F.col("leaves") + F.col("_l")).alias("leaves"), (F.col("saved") + F.col("_s")).alias("saved")))
    return total.groupBy(*_NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _ends(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(node, ends_sha256): the conversations that end at each node, those without a turn at the root.

    Ids are joined to chunks before they are shuffled by node, and a node's chunks are hashed one after the other.
    """
    last = rows.where("last").select(*_NODE, "conv")
    zero = F.lit(0).cast("long")
    turnless = members.join(last.select("conv"), "conv", "left_anti").select(*[zero.alias(c) for c in _NODE], "conv")
    ids = last.unionByName(turnless).repartitionByRange(*_NODE, "conv").sortWithinPartitions(*_NODE, "conv")

    def chunks(batches):
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy() for i in range(3)])
            conv, text = b.column(3).to_numpy(), b.column(3).cast(pa.string()).to_pylist()
            cut = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))) | (np.arange(b.num_rows) % (CHUNK // 16) == 0))
            joined = [",".join(text[i:j]) for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(text)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(k[cut]) for k in key], pa.array(conv[cut]), pa.array(joined)], names=[*_NODE, "first", "ids"])

    def hashed(batches):
        node, sha = None, None
        for b in batches:
            out = []
            for *key, _, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key == node:
                    sha.update(b"," + ids.encode())
                else:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ids.encode())
            yield _hashes(out)
        if node is not None:
            yield _hashes([(*node, sha.hexdigest())])

    joined = ids.mapInArrow(chunks, "depth long, f long, s long, first long, ids string")
    return joined.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(hashed, "depth long, f long, s long, ends_sha256 string")


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*_NODE, "ends_sha256"])
