import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.llm import hard_negatives
from lineloom.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import both

SCHEMA = "vec_id long, embedding array<float>, label int, score double, list string, id string"
#: Rows that take no part, and rows that repeat or share an id.
ODD = [(100, None, 1), (200, [], 1), (300, [1.0, float("nan")] + [0.0] * 6, 1), (400, [float("inf")] + [0.0] * 7, 1), (450, [None] * 8, 1), (None, [1.0] * 8, 1), (500, [1.0] * 8, None), (600, [0.0] * 8, 2),
       (700, [1.0, 2.0], 1), (701, [2.0, 1.0], 1), (702, [1.0, 1.0], 2), (800, [0.25] * 8, 1), (900, [0.25] * 8, 1), (900, [0.25] * 8, 1), (900, [0.5] * 8, 2), (901, [0.125] * 8, 2), (901, [0.125] * 8, 2)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 0.5, "old", "old") for i, v, label in rows], SCHEMA)


def vectors(n, d=8, seed=0, clusters=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, d)) if clusters else None
    x = middle[rng.integers(0, clusters, n)] + 0.02 * rng.normal(size=(n, d)) if clusters else rng.normal(size=(n, d))
    return [(1000 + i, [float(np.float32(c)) for c in v], int(rng.integers(0, 3))) for i, v in enumerate(x)]


def expected(rows, positives=5, negatives=3, step=50):
    ok = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, label) in enumerate(ok):
        if i % step:
            continue
        score = [(-sum(p * q for p, q in zip(v, w, strict=True)), j, k) for k, (j, w, _) in enumerate(ok) if k != a and len(w) == len(v)]
        alike = sorted(s for s in score if ok[s[2]][2] == label)[:positives]
        unlike = sorted(s for s in score if ok[s[2]][2] != label)
        for p, j, _ in alike:
            hit = [(s, n) for s, n, _ in unlike if 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(hit)]
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.collect())


def test_query_equals_sql(spark, small):
    ours, theirs = both(spark, small, QUERIES["op12_hard_negatives"], ORACLE_SQL["op12_hard_negatives"])
    assert ours == theirs and len(ours) > 20


@pytest.mark.parametrize("n,clusters,room", [(60, 0, 32_768), (2500, 0, 200), (2500, 12, 100)])
def test_equals_brute_force(spark, monkeypatch, n, clusters, room):
    monkeypatch.setattr(hard_negatives, "ROWS", room)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 20)
    copies = [(5000 + i, [0.5] * 8, i % 2) for i in range(700)]  # many copies of one vector
    rows = vectors(n, clusters=clusters) + ODD + copies
    assert got(hard_negatives.mine(table(spark, rows))) == expected(rows)


@pytest.mark.parametrize("rows", [[], ODD[:7], [(50, [1.0, 1.0], 1)], [(50, [1.0, 1.0], 1), (51, [1.0, 1.0], 1), (52, [1.0, 0.8], 2), (53, [1.0, 0.8], 2), (54, [-1.0, -0.8], 2)], [(50, [-1.0], 1), (51, [1.0], 1), (52, [-1.0], 2), (53, [1.0], 2)]])
def test_few_rows(spark, rows):
    assert got(hard_negatives.mine(table(spark, rows))) == expected(rows)


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(3)
    middle = 300 * rng.normal(size=(40, 16))
    x = np.floor(middle[rng.integers(0, 40, 4000)] + 4 * rng.normal(size=(4000, 16)))
    c = hard_negatives.centroids(x[:1000], 40)
    near = hard_negatives.nearest(x, c)
    radius = np.array([np.sqrt(((x[near == i] - c[i]) ** 2).sum(1)).max(initial=-1) for i in range(40)])
    index = hard_negatives.Index(c, radius, np.zeros(40), np.ones(40), x[:1000], np.zeros(1000))
    least, most = index.bounds(x[:50])
    score = x[:50] @ x.T
    for i in range(40):
        if (near == i).any():
            assert (score[:, near == i] <= most[:, i : i + 1]).all() and (score[:, near == i] >= least[:, i : i + 1]).all()
    kth = np.sort(score, axis=1)[:, -6]
    assert ((most >= kth[:, None]).sum(1) < 20).all()  # most lists are never visited


def test_anchors_are_sent_to_few_tiles(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 100)
    sent = []
    index = hard_negatives._index
    monkeypatch.setattr(hard_negatives, "_index", lambda *a: sent.append(index(*a)) or sent[-1])
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(60, 64))
    rows = [(i, [float(np.float32(v)) for v in middle[i % 60] + 0.02 * rng.normal(size=64)], i // 60 % 3) for i in range(6000)]
    assert got(hard_negatives.mine(table(spark, rows), step=500)) == expected(rows, step=500)
    i, tiles = sent[0], int((sent[0].tile + sent[0].parts).max())
    anchors = np.floor(256 * np.array([v for n, v, _ in rows if n % 500 == 0]))
    labels = [label for n, _, label in rows if n % 500 == 0]
    needed = []
    for a, label, least, most in zip(anchors, labels, *i.bounds(anchors), strict=True):
        lists = np.flatnonzero(hard_negatives._seeded(i, label, a, np.array([], np.int64), 5, 50, 95).needs(least, most))
        needed.append(len({t for j in lists for t in range(i.tile[j], i.tile[j] + i.parts[j])}))
    assert tiles > 40 and max(needed) < tiles / 4


def test_large_list_fills_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 100)
    seen = []
    index = hard_negatives._index
    monkeypatch.setattr(hard_negatives, "_index", lambda *a: seen.append(index(*a)) or seen[-1])
    rows = vectors(500) + [(5000 + i, [0.5] * 8, i % 2) for i in range(2000)]
    assert got(hard_negatives.mine(table(spark, rows), step=100)) == expected(rows, step=100)
    assert seen[0].parts.max() >= 20


def test_label_may_be_an_expression(spark):
    rows = vectors(300)
    shifted = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    df = hard_negatives.mine(table(spark, rows), label=F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    assert got(df) == expected(shifted)
