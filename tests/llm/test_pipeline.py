from collections import Counter, defaultdict

import corpus_pipeline
from lineloom.llm import bpe, mixing, pii
from lineloom.llm.registry import vocabulary_path
from tests.llm.test_jaccard_join import brute


def stages(spark, docs, sf_dir):
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf_dir).cache())
    return out


def test_stages_against_brute_force(spark, small, documents):
    out = stages(spark, documents, small)
    assert all(x.columns == documents.columns for x in out[:-1])
    rows = [x.collect() for x in out]
    assert {r["doc_id"] for r in rows[1]} == {r["doc_id"] for r in rows[0] if any(c.isalpha() for c in r["text"] or "")}
    component, _ = brute([(r["doc_id"], r["text"]) for r in rows[1]])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(set(component.values()))
    for a, b in zip(sorted(rows[2]), sorted(rows[3]), strict=True):
        assert b["text"] == pii.redacted(a["text"], pii.spans(a["text"])) and pii.detect(b["text"]) == [] and b["n_chars"] == len(b["text"])
    taken = {r["doc_id"]: r["taken"] for r in mixing.plan(out[3]).collect()}
    words = defaultdict(int)
    for r in rows[4]:
        words[r["doc_id"]] += len(r["text"].split())
    assert words == {k: v for k, v in taken.items() if v}
    v = bpe.vocabulary(vocabulary_path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], len(v.encode(r["text"])) // 4) for r in rows[4])
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows[5]) == want and all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in rows[5])
    ran = corpus_pipeline.run(spark, small).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in ran) == want


def test_odd_rows(spark, small, odd, empty):
    rows = [x.count() for x in stages(spark, odd, small)]
    assert rows[0] == 11 and rows[-1] > 0
    assert [x.count() for x in stages(spark, empty, small)] == [0] * 6


def test_the_rest_does_not_need_the_subpackage():
    import re
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for p in (root / "lineloom").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"lineloom\.llm|corpus_pipeline", p.read_text())
