import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.llm import suffix_dedup as sd


def brute(texts, length=200):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def made(seed):
    random.seed(seed)
    base = [bytes(random.choice(b"abcdefgh ") for _ in range(random.randint(150, 900))) for _ in range(6)]
    out = []
    for _ in range(14):
        t = b""
        for _ in range(random.randint(1, 4)):
            b = random.choice(base)
            i = random.randint(0, len(b))
            t += b[i : random.randint(i, len(b))] + bytes(random.choice(b"xyz") for _ in range(random.randint(0, 5)))
        out.append(t)
    return [*out, b"a" * 700, b"ab" * 300, b"\x00" * 450, b"q" * 199, b"", out[0], out[0]]


def local(texts, length=200):
    found = [sd.Stretches(g, length) for g in sd.parts_of(texts, length)]
    assert sum(s.windows.sum() for s in found) == sum(max(0, len(t) - length + 1) for t in texts)
    count = Counter((a, c) for s in found for a, c in zip(s.anchor.tolist(), s.content.tolist(), strict=True))
    rows = sorted({(int(a), int(c), s.bytes(i)) for s in found for i, (a, c) in enumerate(zip(s.anchor, s.content, strict=True))})
    part = {(a, c): r for a, c, r in sd.index_entries(iter(rows), length)}
    out = [np.zeros(len(t), bool) for t in texts]
    for t, at, n, a, c in ((*x,) for s in found for x in zip(s.text, s.at, s.windows, s.anchor.tolist(), s.content.tolist(), strict=True)):
        for low, high in [(0, n - 1)] if count[a, c] > 1 else part.get((a, c), []):
            out[t][at + low : at + high + length] = True
    return out


@pytest.mark.parametrize("batch,piece", [(1 << 20, 1 << 20), (2000, 1 << 20), (300, 1024)])
def test_index_equals_brute_force(monkeypatch, batch, piece):
    monkeypatch.setattr(sd, "BATCH", batch)
    monkeypatch.setattr(sd, "PIECE", piece)
    for seed in range(5):
        texts = made(seed)
        for x, y in zip(brute(texts), local(texts), strict=True):
            assert (x == y).all()


def test_levels_stay_logarithmic():
    random.seed(1)
    index, number = sd.SuffixLevels(100), 0
    text = bytes(random.choice(b"abcd") for _ in range(40_000))
    for at in range(0, 39_000, 1000):
        index.add([text[at : at + 1000]], np.array([901]), number)
        number += 901
    assert len(index.levels) <= 7 and not any(len(r) for r in index.repeated)
    for level in index.levels:
        keys = [bytes(k) for k in level.keys(np.arange(len(level.at)))]
        assert keys == sorted(keys)


def test_frame_equals_brute_force(spark):
    texts = [t.replace(b"\x00", b"n").decode() for t in made(9)] + ["é" * 250, "x" + "é" * 200, None]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    raw = [(t or "").encode() for t in texts]
    gone = brute(raw)
    for r in sd.dedup(df).collect():
        t, g = raw[r["doc_id"]], gone[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"]) == (len(t), g.sum())
        assert r["n_spans"] == (np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum()
        assert bytes(r["kept"]) == bytes(np.frombuffer(t, np.uint8)[~g])


def test_odd_rows(odd, clashing, empty):
    for df in (odd, clashing):
        rows = sd.dedup(df).withColumn("sha", F.sha2("kept", 256)).collect()
        assert len(rows) == df.count()
        long_ = next(r for r in rows if r["doc_id"] == 7)
        assert (long_["n_bytes"], long_["n_removed"], long_["n_spans"], long_["sha"]) == (300_000, 300_000, 1, hashlib.sha256(b"").hexdigest())
        assert all(r["n_removed"] == 0 for r in rows if r["n_bytes"] < 200)
    assert sd.dedup(empty).count() == 0


def test_periodic_texts_take_bounded_memory():
    import tracemalloc

    tracemalloc.start()
    n = 0
    for group in sd.parts_of([b"a" * (6 << 20)], 200):
        n += int(sd.Stretches(group, 200).windows.sum())
    assert n == (6 << 20) - 199 and tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_query_equals_brute_force(spark, small):
    import hashlib

    from lineloom.llm.registry import QUERIES

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op3_repeated_bytes"](spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    gone = dict(zip(docs, brute(list(docs.values())), strict=True))
    for r in rows:
        g = gone[r["doc_id"]]
        kept = np.frombuffer(docs[r["doc_id"]], np.uint8)[~g].tobytes()
        starts = int((g & ~np.concatenate(([False], g[:-1]))).sum()) if len(g) else 0
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(g), int(g.sum()), starts, hashlib.sha256(kept).hexdigest())
