import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lineloom.llm import mixing
from lineloom.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import both


def water(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = dict(zip(names, (weights[i % 3] for i in range(len(names))), strict=True))
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        over = [s for s in open_ if left * w[s] / sum(w[x] for x in open_) > most * sizes[s] * (1 + 1e-12)]
        if not over:
            return out | {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        s = min(over, key=lambda s: most * sizes[s] / w[s])
        out[s] = most * sizes[s]
        left -= out[s]
        open_.remove(s)
    return out


def test_query_equals_sql(spark, small):
    ours, theirs = both(spark, small, QUERIES["op2_mix_sources"], ORACLE_SQL["op2_mix_sources"])
    assert ours == theirs


def test_targets_and_taken(spark):
    docs = [(i, " ".join(["w"] * (1 + i * 7 % 40)), s) for i in range(600) for s in [None if i % 50 == 0 else f"s{i % 7}" if i % 3 else "big"]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.plan(df).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(r["text"].split()) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = water(sizes)
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and target[s] <= 3 * sizes[s]
        assert abs(taken[s] - target[s]) <= 40  # the longest document
    assert sum(taken.values()) == sum(sizes.values())  # the budget
    assert {r["source_size"] for r in rows} == set(sizes.values())
    again = mixing.plan(df.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_queue_order_is_by_hash_and_buckets_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (i % 9), "a") for i in range(300)], "doc_id long, text string, source string")
    one = {r["doc_id"]: r["finish_time"] for r in mixing.plan(df).collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    assert one == {r["doc_id"]: r["finish_time"] for r in mixing.plan(df).collect()}
    at, size = 0, sum(i % 9 for i in range(300))
    for i in sorted(range(300), key=lambda i: hashlib.md5(f"mix{i}".encode()).hexdigest()):
        at += i % 9
        assert one[i] == at / size


def test_mix_repeats_and_cuts(spark):
    df = spark.createDataFrame([(i, f" a{i}  b\nc d ", s) for i in range(40) for s in ["x" if i < 5 else "y" if i < 12 else "z"]], "doc_id long, text string, source string")
    plan = {r["doc_id"]: r for r in mixing.plan(df).collect()}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    got = defaultdict(int)
    for r in mixed.collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert f" a{r['doc_id']}  b\nc d ".startswith(r["text"])
    assert got == {i: r["taken"] for i, r in plan.items() if r["taken"]}
    assert sum(got.values()) == 160


def by_heap(docs, weights=(5, 2, 1), most=3):
    """Words taken of each (key, words, source) by merging the queues one document at a time."""
    sizes, queues = defaultdict(int), defaultdict(list)
    for k, n, s in docs:
        sizes[s] += n
        queues[s].append((hashlib.md5(f"mix{k}".encode()).hexdigest(), k, n))
    target, heap, out, left = water(sizes, weights, most), [], defaultdict(int), sum(sizes.values())
    for s, q in queues.items():
        at = 0
        for p in range(most):
            for _, k, n in sorted(q):
                at += n
                if n:
                    heap.append((at / target[s], s is None, s or "", p, at, k, n))
    for *_, k, n in sorted(heap):
        out[k] += min(n, left)
        left -= min(n, left)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_taken_equals_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    docs = [(i, rng.choice([0, 1, 3, 50, 400]), rng.choice(["a", "b", "b", "c", None, "zzz"])) for i in range(200)]
    want = by_heap(docs)
    got = mixing.plan(spark.createDataFrame([(i, "w " * n, s) for i, n, s in docs], "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {i: want[i] for i, _, _ in docs}


def test_query_is_range_sorted(spark, small):
    assert "rangepartitioning" in QUERIES["op2_mix_sources"](spark, small)._jdf.queryExecution().toString().lower()


def test_sorted_over_the_whole_result(spark, documents):
    assert "rangepartitioning" in mixing.mix(documents)._jdf.queryExecution().toString().lower()


def test_odd_rows(odd, clashing, empty):
    for df in (odd, clashing):
        rows = mixing.plan(df).collect()
        assert len(rows) == df.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
        assert [r["size"] for r in rows if not r["text"]] == [0, 0]
        assert mixing.mix(df).columns == df.columns and mixing.mix(df).count() > 0
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_only_blank_texts(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.plan(df).collect()] == [(0, 0.0), (0, 0.0)]


def test_no_python_in_the_plan(documents):
    for df in (mixing.plan(documents), mixing.mix(documents)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert F is not None
