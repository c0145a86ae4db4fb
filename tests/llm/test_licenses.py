import re

import pytest
from pyspark.sql import functions as F

from lineloom.llm import license_scan
from lineloom.llm.license_rules import RULES, Rule
from lineloom.llm.registry import QUERIES

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def base_of(text):
    """(words, places, first, last, labels) of the base phrases, word by word."""
    words = words_of(text)
    at = sorted((i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({label for _, label in at}))


def kept_of(found):
    """Suppression by comparing each detection with all others."""
    over = lambda b, a: b["first"] <= a["first"] and b["last"] >= a["last"] and b["level"] <= a["level"] and ((b["first"], b["last"]) != (a["first"], a["last"]) or b["rule"] < a["rule"])
    return [a for a in found if not any(over(b, a) for b in found)]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def kept_labels(spark, texts):
    return [r["l"] for r in license_scan.scan(rows(spark, texts)).orderBy("doc_id").select(license_scan.labels(F.col("kept")).alias("l")).collect()]


def test_query_equals_brute_force(spark, small, documents):
    got = {r["doc_id"]: r for r in QUERIES["op11_license_scan"](spark, small).collect()}
    want = documents.select("doc_id", "text").collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == base_of(r["text"])
        assert set(g["base_labels"].split(",")) <= set(g["labels"].split(",")) | {""}
        assert 0 <= g["score"] <= 1 and (g["score"] > 0) >= bool(g["n_base"])


def test_base_phrases_in_odd_places(spark, tmp_path):
    texts = ["CC BY", "cc-by CC\tby", "ccby cc byte", "cc é by", "GENERAL\x00PUBLIC~License general public license", "all rights reserved" * 2, "all rights reserved all rights reserved.", "éall rights reserved", "all rights reserved", None, "", " .. ", "cc " * 5 + "by"]
    rows(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_license_scan"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got] == [base_of(t) for t in texts]


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0,licensed"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0,licensed"),
        ("GNU Lesser General Public License v2.1 or (at your option) any later version", "lgpl-2.1-or-later"),
        ("See https://www.apache.org/licenses/LICENSE-2.0 for it", "apache-2.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the", "mit"),
        ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0-only"),
        ("https://creativecommons.org/licenses/by-sa/3.0/", "cc-by-sa-3.0"),
        ("Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
        ("Copyright (c) 2019 A. Person. Released under the BSD 3-Clause License", "bsd-3-clause,copyright"),
        ("mit Freunden und ohne Lizenz", ""),
        ("The open terms of the public library", ""),
    ],
)
def test_labels(spark, text, labels):
    assert kept_labels(spark, [text]) == [labels]


def test_rules_are_sound():
    assert len(RULES) > 250 and [r.level for r in RULES] == sorted(r.level for r in RULES)
    for r in RULES:
        assert r.keyword in r.needed() and re.compile(r.pattern())
    with pytest.raises(ValueError):
        from lineloom.llm.license_rules import _ordered

        _ordered([Rule(1, "x", "maybe", "a (maybe)? b")])


def test_gate_loses_no_match(spark):
    texts = ["all rights reserved x cc by y mozilla public license 2.0 z public domain", "nothing here"]
    ungated = [r._replace(keyword="") for r in RULES]
    numbered = ["".join(f" {w}:{i} " for i, w in enumerate(words_of(t))) for t in texts]
    want = [sorted((r.label, *[int(n) for n in (re.findall(r":(\d+) ", m)[0], re.findall(r":(\d+) ", m)[-1])]) for r in ungated for m in re.findall(r.pattern(), n)) for n in numbered]
    got = license_scan.scan(rows(spark, texts)).orderBy("doc_id").collect()
    assert [sorted((d["label"], d["first"], d["last"]) for d in r["found"]) for r in got] == want


@pytest.mark.parametrize("reach", [license_scan.REACH, (1, 2), ()])
def test_suppression_equals_brute_force(spark, monkeypatch, reach):
    monkeypatch.setattr(license_scan, "REACH", reach)
    rules = [Rule(2, "x", "a", "a _ b"), Rule(1, "y", "a", "a"), Rule(3, "z", "b", "b (a | b)? (a | b)? (a | b)?"), Rule(3, "v", "b", "b b"), Rule(3, "w", "b", "b b"), Rule(4, "u", "c", "_ ? _ ? c")]
    texts = [" ".join("abc"[(i * i * k + i // 3 + k) % 3] for i in range(n)) for k, n in enumerate([1, 2, 3, 5, 8, 30, 90, 200])]
    done = license_scan.scan(rows(spark, texts), rules=rules).collect()
    assert any(len(r["kept"]) < len(r["found"]) for r in done)
    for r in done:
        assert [(d["first"], d["last"], d["rule"]) for d in r["found"]] == sorted(((d["first"], d["last"], d["rule"]) for d in r["found"]), key=lambda d: (d[0], -d[1], d[2]))
        assert list(r["kept"]) == kept_of(r["found"])


def test_odd_rows(spark, odd, clashing, empty):
    got = license_scan.scan(odd)
    assert got.columns == [*odd.columns, "n_words", "found", "kept"] and got.count() == odd.count()
    assert [r["n_words"] for r in got.where("text IS NULL OR trim(text) = ''").collect()] == [0, 0, 0][: odd.where("text IS NULL OR trim(text) = ''").count()]
    again = license_scan.scan(clashing.withColumn("found", F.lit("old")).withColumn("_plain", F.lit("old")))
    assert again.select("n_words", "found", "kept").collect() == got.select("n_words", "found", "kept").collect()
    assert {r["_plain"] for r in again.collect()} == {"old"}
    assert license_scan.scan(empty).collect() == []


def test_text_full_of_licenses(spark):
    r = license_scan.scan(rows(spark, ["all rights reserved. licensed under the apache license, version 2.0 " * 3000])).selectExpr("n_words", "size(found) AS f", "size(kept) AS k").first()
    assert (r["n_words"], r["f"], r["k"]) == (33_000, 15_000, 9_000)


def test_plan_is_native(spark, small):
    plan = QUERIES["op11_license_scan"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange|Pandas", plan)
