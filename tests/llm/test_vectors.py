import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.llm import ann, exact_search
from lineloom.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import both

SCHEMA = "vec_id long, embedding array<float>, label int, score double, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.5, "old") for i, v in rows], SCHEMA)


def vectors(n, d=8, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=d)]) for i in range(n)]


ODD = [(100, None), (200, []), (300, [1.0, float("nan")] + [0.0] * 6), (400, [float("inf")] + [0.0] * 7), (500, [None] * 8), (600, [0.0] * 8), (700, [1.0, 2.0]), (None, [1.0] * 8), (800, [0.25] * 8), (900, [0.25] * 8), (900, [0.25] * 8)]


def whole(rows, zeros):
    return [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zeros or any(v))]


def expected(rows, step, k, score, zeros):
    """{query id: [(id, score)]} by comparing every query row with every other row of its length; queries that share an id one after the other."""
    ok, out = whole(rows, zeros), defaultdict(list)
    for a, (q, v) in enumerate(ok):
        if q % step == 0:
            out[q].append([(i, s) for s, i in sorted((score(v, x), i) for b, (i, x) in enumerate(ok) if b != a and len(x) == len(v))][:k])
    return {q: f[0] if len(f) == 1 else sorted(sum(f, [])) for q, f in out.items() if any(f)}


def nearest(rows, step, k):
    return expected(rows, step, k, lambda v, x: float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), False)


def products(rows, step, k):
    found = expected(rows, step, k, lambda v, x: -sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, x, strict=True)), True)
    several = {i for i, n in Counter(i for i, _ in whole(rows, True)).items() if n > 1}
    return {q: sorted((i, -s) for i, s in f) if q in several else [(i, -s) for i, s in f] for q, f in found.items()}


def by_query(df):
    """{query id: [(id, score)]} by rank; where queries share an id, all that they have found, sorted."""
    out = defaultdict(list)
    for r in df.collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    done = {}
    for q, f in out.items():
        if sum(r == 1 for r, *_ in f) == 1:
            assert sorted(r for r, *_ in f) == list(range(1, len(f) + 1))
            done[q] = [(i, s) for _, i, s in sorted(f)]
        else:
            done[q] = sorted((i, s) for _, i, s in f)
    return done


def same(got, want):
    assert got == want


def test_products_equal_sql(spark, small):
    ours, theirs = both(spark, small, QUERIES["op5_top_products"], ORACLE_SQL["op5_top_products"])
    assert ours == theirs


@pytest.mark.parametrize("n,tile", [(40, 4096), (3000, 300)])
def test_products_equal_brute_force(spark, monkeypatch, n, tile):
    monkeypatch.setattr(exact_search, "ROWS", tile)
    monkeypatch.setattr(exact_search, "QUERIES", 20)
    rows = [(40_001 + i, v) for i, v in vectors(n)] + ODD + [(20_000 + i, [0.5] * 8) for i in range(300)]  # many copies of one vector
    same(by_query(exact_search.search(table(spark, rows))), products(rows, 50, 5))


def test_bounds_drop_groups_and_nothing_else():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 100
    x = centres[rng.integers(0, 12, 2000)] + rng.normal(size=(2000, 16))
    near = np.argmin(((x[:, None] - centres[None]) ** 2).sum(2), axis=1)
    of = lambda f: np.array([f(x[near == g], centres[g]) for g in range(12)])
    away, angle = of(lambda v, c: np.sqrt(((v - c) ** 2).sum(1)).max()), of(lambda v, c: exact_search._angles(v, np.broadcast_to(c, v.shape)).max())
    norm, least = of(lambda v, c: np.sqrt((v * v).sum(1)).max()), of(lambda v, c: np.sqrt((v * v).sum(1)).min())
    closest = [np.sort(np.sqrt(((x[near == g] - centres[g]) ** 2).sum(1)))[:6] for g in range(12)]
    groups = exact_search.Groups(np.arange(12), centres, np.bincount(near, minlength=12), away, angle, norm, least)
    need = exact_search.necessary(groups, groups, closest, 5)
    assert not need.all()
    for g in range(12):
        for q in x[near == g][:20]:
            assert need[g][near[np.argsort(-(x @ q))[:5]]].all()


@pytest.mark.parametrize("clusters,most", [(200, 0.25), (0, 1.0)])
def test_groups_are_dropped_at_default_parameters(spark, monkeypatch, clusters, most):
    """On clusters a query meets few rows, on random directions no bound of this kind can leave any out."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8000, 64))
    if clusters:
        x = rng.normal(size=(clusters, 64))[rng.integers(0, clusters, 8000)] + 0.02 * x
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    seen = []
    necessary = exact_search.necessary
    monkeypatch.setattr(exact_search, "necessary", lambda q, x, *a: seen.append((q.n, x.n, necessary(q, x, *a))) or seen[-1][2])
    got = by_query(exact_search.search(table(spark, rows)))
    whole = np.floor(256 * np.array([v for _, v in rows]))
    for q in list(got)[:40]:
        score = (whole @ whole[q]).astype(np.int64)
        score[q] = -(1 << 60)
        assert [i for i, _ in got[q]] == np.lexsort((np.arange(8000), -score))[:5].tolist()
    (q_n, x_n, need), = seen
    assert len(got) == 160 and (q_n[:, None] * x_n * need).sum() / (q_n.sum() * x_n.sum()) <= most


def test_large_values_are_exact():
    q, x = np.array([[2.0**30, -3.0]]), np.array([[2.0**30, 5.0], [1.0, 1.0]])
    assert exact_search.products(q, x).tolist() == [[2**60 - 15, 2**30 - 3]]


def test_nearest_are_exact_where_few(spark):
    rows = [(i + 1, v) for i, v in vectors(120)] + ODD
    same(by_query(ann.search(table(spark, rows))), nearest(rows, 100, 10))


def test_recall(spark, small):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    got, hit = by_query(ann.search(e)), 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hit += len(set(best.tolist()) & {i for i, _ in found})
        assert all(abs(s - d[ids == i][0]) < 1e-12 for i, s in found)
    assert len(got) == (ids % 100 == 0).sum() and hit >= 0.9 * 10 * len(got)


def test_copies_of_one_vector_take_the_smallest_ids(spark):
    rows = vectors(400) + [(10_000 + i, [0.5] * 8) for i in range(500)]
    got = by_query(ann.search(table(spark, rows)))
    assert [i for i, _ in got[10_100]] == list(range(10_000, 10_010))


def test_encoding_gets_better_with_a_wider_beam():
    x = np.array([v for _, v in vectors(600, 16)])
    books = ann.train(x, 4, 16)
    error = []
    for beam in (1, 8):
        codes, norm = books.encode(x, beam)
        approx = sum(books.words[m][codes[:, m]] for m in range(4))
        assert np.allclose((approx**2).sum(1), norm)
        error.append(((x - approx) ** 2).sum())
    assert error[1] < error[0]


def test_empty(spark):
    for rows in ([], [(100, None)]):
        assert ann.search(table(spark, rows)).count() == 0
        assert exact_search.search(table(spark, rows)).count() == 0
    assert exact_search.search(table(spark, [(1, [1.0])])).count() == 0
    assert by_query(exact_search.search(table(spark, [(50, [1.0]), (51, [-0.001])]))) == {50: [(51, -256)]}
    assert F is not None


def test_rows_that_share_an_id_or_length(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.5, 0.5]), (51, [1.0, 1.0]), (100, [3.0]), (101, [2.0]), (100, [3.0]), (52, [1.0, 0.0]), (52, [1.0, 0.0])]
    same(by_query(exact_search.search(table(spark, rows))), products(rows, 50, 5))
    same(by_query(ann.search(table(spark, rows), step=50)), nearest(rows, 50, 10))
    assert exact_search.search(table(spark, [(50, [1.0]), (50, [2.0]), (51, [3.0])])).count() == 4


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(200)]
    got = by_query(exact_search.search(table(spark, rows)))
    assert [i for i, _ in got[50]] == [0, 2, 4, 6, 8] and [i for i, _ in got[0]] == [2, 4, 6, 8, 10]
    assert [i for i, _ in by_query(ann.search(table(spark, rows)))[100]] == list(range(0, 20, 2))


def test_nearest_query_equals_brute_force(spark, small):
    got = by_query(QUERIES["op4_nearest"](spark, small))
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want = nearest(rows, 100, 10)
    assert set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    exact = {(q, i): s for q, f in nearest(rows, 100, len(rows)).items() for i, s in f}
    assert all(abs(exact[q, i] - s) < 1e-9 for q, f in got.items() for i, s in f)


@pytest.mark.parametrize("n,d,step", [(20_000, 64, 400), (50_000, 64, 1000), (6_000, 256, 100)])
def test_recall_as_tables_and_vectors_grow(spark, tmp_path, n, d, step):
    """Random directions are the hardest case: all rows are about as far."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = np.random.default_rng(d + n).normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    values = pa.ListArray.from_arrays(np.arange(0, n * d + 1, d, dtype=np.int32), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": values}), tmp_path / "e.parquet", row_group_size=5000)
    got = by_query(ann.search(spark.read.parquet(str(tmp_path / "e.parquet")), step=step))
    assert len(got) == n // step
    hit = 0
    for q, found in got.items():
        away = ((x.astype(float) - x[q]) ** 2).sum(1)
        away[q] = np.inf
        hit += len(set(np.argsort(away)[:10].tolist()) & {i for i, _ in found})
        assert np.allclose([s for _, s in found], np.sqrt(away[[i for i, _ in found]]))
    assert hit >= 0.9 * 10 * len(got)


def test_shortlist_is_measured(spark):
    rng = np.random.default_rng(4)
    tight = [(i, [float(np.float32(v)) for v in rng.normal(size=8)]) for i in range(1500)]
    rows = ann.usable(table(spark, tight), zeros=False)
    queries, fine, coarse = ann.numbered(rows.where("id % 20 = 0")), ann._fit(rows, books=8, words=64), ann._fit(rows, books=1, words=2)
    short = [ann.shortlist(rows, ann.index(rows, b), queries, b, 10, 1500) for b in (fine, coarse)]
    assert short[0] < 200 < short[1] <= 1500  # the worse the codes, the longer


def kinds(kind, n, d):
    rng = np.random.default_rng(11)
    if kind == "equally near":  # distances take few values, ids tell the rest apart
        return rng.integers(0, 2, (n, d)).astype(np.float32)
    return (rng.normal(size=(n, d)) * np.exp(3 * rng.normal(size=(n, 1)))).astype(np.float32)  # a few are very long


@pytest.mark.parametrize("kind", ["equally near", "of all lengths"])
def test_recall_on_other_rows(spark, kind):
    n, step = 6000, 25
    x = kinds(kind, n, 64)
    got, hit = by_query(ann.search(table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), step=step)), 0
    for q, found in got.items():
        away = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(1))
        away[q] = np.inf
        hit += len(set(np.lexsort((np.arange(n), away))[:10].tolist()) & {i for i, _ in found})
    assert len(got) == n // step and hit >= 0.96 * 10 * len(got)


def test_few_long_vectors_do_not_make_shortlists_long(spark):
    rows = ann.usable(table(spark, [(i, v.tolist()) for i, v in enumerate(kinds("of all lengths", 3000, 32))]), zeros=False)
    assert ann.shortlist(rows, ann.index(rows, b := ann._fit(rows)), ann.numbered(rows.where("id % 20 = 0")), b, 10, 3000) < 150
