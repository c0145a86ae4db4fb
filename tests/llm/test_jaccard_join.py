import random
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from lineloom.llm import graph, jaccard_join as jj


def sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    ids, found = [r[0] for r in rows], sets([r[1] for r in rows])
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(found[i] & found[j])
            if both and 100 * both >= 80 * len(found[i] | found[j]):
                a, b = sorted((root(ids[i]), root(ids[j])))
                up[b] = a
    return {i: root(i) for i in ids}, {i: len(s) for i, s in zip(ids, found, strict=True)}


def near_copies(n, seed):
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdefghij", k=4))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        if rows and random.random() < 0.6:
            w = random.choice(rows)[1].split()
            for _ in range(random.randint(0, 1 + len(w) // 40)):
                w[random.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(random.randint(1, 150))] + (passage if random.random() < 0.5 else [])
        rows.append((i, " ".join(w)))
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,seeds,frequent", [(1, 8, 4), (2, 1, 4), (3, 1, 0.0001)])
def test_components_equal_brute_force(spark, monkeypatch, seed, seeds, frequent):
    monkeypatch.setattr(jj, "SEEDS", seeds)  # with few seeds most links are left to the tiles
    monkeypatch.setattr(jj, "FREQUENT", frequent)
    monkeypatch.setattr(jj, "TILE_BYTES", 3000)
    if seed > 1:
        monkeypatch.setattr(jj, "TILE_ROWS", 7)
    rows = near_copies(260, seed) + [(1000 + i, t) for i, t in enumerate(["A B c d", "a b C d", "a b c d e", "", "one"])]
    component, size = brute(rows)
    got = jj.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == component
    assert {r["doc_id"]: r["n_shingles"] for r in got} == size


def test_large_group_of_near_copies(spark):
    random.seed(8)
    base = [str(random.randrange(10**6)) for _ in range(300)]
    rows = []
    for i in range(700):
        w = list(base)
        w[random.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = jj.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_tile_pairs_lose_nothing():
    random.seed(9)
    for n in (5, 20, 90):
        base = np.array(random.sample(range(10**9), 400), np.uint64)
        found = [np.unique(np.concatenate((np.array(random.sample(list(base), random.randint(100, 400)), np.uint64), np.array(random.sample(range(10**9), random.randint(0, 60)), np.uint64)))) for _ in range(n)]
        found += [f[: random.randint(2, len(f))] for f in found]
        m = len(found)
        got = set(jj.tile_pairs(list(range(m)), [len(f) for f in found], list(range(m)), [jj.signature(f) for f in found], 80))
        want = {(i, j) for i in range(m) for j in range(i + 1, m) if jj.similar(found[i], found[j], 80)}
        assert want <= got and len(got) < m * m / 2


def test_prefixes_of_similar_sets_meet():
    random.seed(10)
    frequent = np.zeros(1 << 14, np.uint64)
    for _ in range(300):
        n = random.randint(1, 60)
        x = np.unique(np.array(random.sample(range(10**9), n), np.uint64))
        y = np.unique(np.concatenate((x[random.randint(0, n // 8) :], np.array(random.sample(range(10**9), random.randint(0, n // 8)), np.uint64))))
        if jj.similar(x, y, 80):
            assert set(jj.prefix(x, 80, frequent).tolist()) & set(jj.prefix(y, 80, frequent).tolist())


def test_odd_rows(odd, clashing, empty):
    for df in (odd, clashing):
        rows = jj.join(df).collect()
        assert len(rows) == df.count()
        by = defaultdict(set)
        for r in rows:
            by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
        assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[7] == {(1, 7)} and by[8] == {(1, 8)}
        assert {c for _, c in by[4]} == {4} and {c for _, c in by[None]} == {None}
    assert jj.join(empty).count() == 0


def test_components_of_a_graph(spark):
    random.seed(11)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2000, 2200)] + [(5, 5), (None, 3)]
    up = {i: i for p in links if None not in p for i in p}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up if i != 5 or any(5 in p and p[0] != p[1] for p in links)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filter_has_every_key(spark):
    keys = [random.randrange(-(2**63), 2**63) for _ in range(500)]
    words = graph.filter_of(spark.createDataFrame([(k,) for k in keys], "k long"))
    assert graph.in_filter(words, np.array(keys, np.int64).view(np.uint64)).all()
    other = np.array([random.randrange(2**63) for _ in range(5000)], np.uint64)
    assert graph.in_filter(words, other).mean() < 0.05


def test_query_equals_sql(spark, small):
    from lineloom.llm.registry import ORACLE_SQL, QUERIES
    from tests.oracle import both

    ours, theirs = both(spark, small, QUERIES["op8_similar_documents"], ORACLE_SQL["op8_similar_documents"])
    assert ours == theirs and any(r[0] != r[1] for r in ours)


def test_shuffles_go_before_the_next_step(spark, monkeypatch):
    """What the tiles have shuffled and stored is deleted once their pairs are known, but for the shuffles of the last step."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName().split("_")[1] for f in (manager.getAllFiles().apply(i) for i in range(manager.getAllFiles().size())) if f.getName().startswith("shuffle_")}
    left, folders, make = [], [], jj._tiles
    kept = jj.stored

    def tiles(*args):
        jj.forget(spark)
        time.sleep(2)
        before = files()
        pairs = make(*args)
        time.sleep(2)
        left.append(files() - before)
        return pairs

    def keep(df, name):
        out = kept(df, name)
        folders.append(Path(out.inputFiles()[0].removeprefix("file://")).parent)
        return out

    monkeypatch.setattr(jj, "_tiles", tiles)
    monkeypatch.setattr(jj, "stored", keep)
    words = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(words[i : i + 30])) for i in range(60)]
    got = jj.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and {r["component_id"] for r in got} == {0}
    assert len(left[0]) <= 3 and len(folders) == 1 and not folders[0].exists()
