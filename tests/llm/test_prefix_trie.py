import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.llm import prefix_trie
from lineloom.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import both

SCHEMA = "conv_id long, turn long, role string, text string, depth string, f string, conv string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "old", "old", "old") for r in rows], SCHEMA)


def sha(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def conversations(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            out[conv].append((turn is not None, turn or 0, sha(role, text), role, text))
    return {c: [t[3:] for t in sorted(v)] for c, v in out.items()}


def rebuild(convs):
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    return {c: convs.get(c - c % 100, [])[: h(c)] + turns[h(c) :] for c, turns in convs.items()}


def nodes(convs):
    """All nodes by inserting every prefix of every conversation."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((m[0], len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def built(df, **options):
    turns, texts, members = prefix_trie.read(df)
    return got(prefix_trie.trie(turns, texts, members, **options))


def some(n=60, seed=0, words=2, longest=9):
    """Conversations with many common beginnings."""
    rng = np.random.default_rng(seed)
    return [(c, t, ["user", "assistant", None][int(rng.integers(0, 40)) % 3 if rng.random() < 0.1 else t % 2], [None, "", "é", "ab", "日本🙂"][int(rng.integers(0, words + 1))]) for c in range(n) for t in range(int(rng.integers(1, longest)))]


#: Repeated rows, equal turns, null turns, ids and texts.
ODD = [(None, 0, "user", "x"), (7, None, "user", "x"), (7, None, "user", "x"), (7, 0, None, None), (8, None, "user", "x"), (8, None, "user", "x"), (-3, 5, "user", "x"), (-3, 5, "assistant", "y"), (-3, 4, "userx", ""), (9, 1, "user", "x" * 300_000), (10, 3, "user", "x" * 300_000)]


def test_query_equals_sql_and_brute_force(spark, small):
    ours, theirs = both(spark, small, QUERIES["op13_prefix_trie"], ORACLE_SQL["op13_prefix_trie"])
    assert ours == theirs
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_prefix_trie"](spark, small)) == nodes(rebuild(conversations(rows)))


def test_rebuilt_conversations(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(c), t, "user", f"{c % 3} {t}") for c in [*range(0, 40), *range(100, 130), *range(205, 230), 300, 301, 302] for t in range(int(rng.integers(1, 8)))] + [(400, 0, "user", "short"), *[(c, t, "user", "long") for c in range(401, 412) for t in range(7)]]
    table(spark, rows).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    want = rebuild(conversations(rows))
    assert any(not t for t in want.values())  # some have no turn left
    assert got(QUERIES["op13_prefix_trie"](spark, str(tmp_path))) == nodes(want)


@pytest.mark.parametrize("rows", [some(), some(200, 1, 1, 4), ODD, some(20, 3) + ODD, [(1, 0, "a", "b")], []])
def test_equals_brute_force(spark, rows):
    assert built(table(spark, rows)) == nodes(conversations(rows))


@pytest.mark.parametrize("primes", [(5, 7), (3, 2)])
def test_collisions_are_split(spark, primes):
    rows = some(40, 5, 4, 6)
    assert built(table(spark, rows), primes=primes) == nodes(conversations(rows))


def test_conversations_longer_than_partitions(spark):
    rows = [(1, t, "user", "same" if t % 7 else str(t)) for t in range(700)] + [(2, t, "user", "same" if t % 7 else str(t)) for t in range(650)] + [(3, 0, "user", "0")] + some(30, 6)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        assert built(table(spark, rows)) == nodes(conversations(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_batches_are_carried_on(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 3)
    try:
        rows = some(30, 8)
        assert built(table(spark, rows)) == nodes(conversations(rows))
    finally:
        spark.conf.set(key, before)


def test_fingerprints_are_polynomials():
    rng = np.random.default_rng(2)
    conv, words = np.array([1, 1, 1, 4, 9, 9]), rng.integers(0, 1 << 32, (6, 4)).astype(np.uint32)
    depth, sums = prefix_trie.scan(conv, words)
    assert depth.tolist() == [1, 2, 3, 1, 1, 2]
    for i, (p, b) in enumerate(zip(prefix_trie.PRIMES, prefix_trie.BASES, strict=True)):
        want, total = [], 0
        for j, d in enumerate(depth.tolist()):
            total = (0 if d == 1 else total) + (int(words[j, i]) % (p - 1) + 1) * pow(b, d - 1, p)
            want.append(total % p)
        assert sums[i].tolist() == want


def test_many_copies_of_one_conversation(spark):
    rows = [(c, t, "user", "abc"[t]) for c in range(3000) for t in range(3)] + some(20, 9)[:50]
    rows = [(c + 10_000, *r) for c, *r in some(20, 9)] + rows[:9000]
    assert built(table(spark, rows)) == nodes(conversations(rows))


def test_texts_move_only_where_rows_differ(spark):
    turns, texts, members = prefix_trie.read(table(spark, some(30, 7)))
    asked = texts.withColumn("text", F.when(F.col("ref.conv") == 999, F.raise_error(F.lit("read"))).otherwise(F.col("text")))
    assert got(prefix_trie.trie(turns, asked, members))
