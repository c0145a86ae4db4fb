import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lineloom.operators import automaton, numbering
from lineloom.sources import elements, readers

STATES = ["out", "in", "quote"]
MOVES = {"open": {"out": "in"}, "close": {"in": "out", "quote": "out"}, "mark": {"in": "quote", "quote": "in"}, "reset": {"in": "out", "quote": "out", "out": "out"}, "none": {}}


def machine(spark, rows, start="out"):
    df = spark.createDataFrame(rows, "doc long, pos int, event string")
    return automaton.run(df, ["doc"], "pos", STATES, [(F.col("event") == e, m) for e, m in MOVES.items()], start)


@pytest.mark.parametrize("n,seed", [(1, 0), (2, 1), (3, 2), (70, 3), (300, 4)])
def test_states_equal_one_step_after_the_other(spark, n, seed):
    r = random.Random(seed)
    rows = [(d, i, r.choice([*MOVES, "other", None])) for d in range(6) for i in range(r.randint(1, n))]
    want, state = {}, {}
    for d, i, e in rows:
        state[d] = MOVES.get(e, {}).get(state.get(d, "out"), state.get(d, "out"))
        want[d, i] = state[d]
    r.shuffle(rows)
    assert {(x["doc"], x["pos"]): x["state"] for x in machine(spark, rows).collect()} == want


def test_machine_without_events(spark):
    assert machine(spark, []).collect() == []
    assert [x["state"] for x in machine(spark, [(1, 1, "none"), (1, 2, None)], "in").collect()] == ["in", "in"]
    with pytest.raises(ValueError):
        automaton.transitions(STATES, [(F.lit(True), {"in": "nowhere"})])


def test_events_have_depths(spark):
    df = spark.createDataFrame([(1, '<!DOCTYPE html><a><B x="1">t<br>u</b><!-- <c> -->v</a><img/>'), (2, None), (3, ""), (4, "only text")], "k long, html string")
    got = [(r["k"], r["kind"], r["name"], r["content"], r["depth"]) for r in elements.events(df, ["k"], "html").orderBy("k", "pos").collect()]
    assert got == [
        (1, "start", "a", "<a>", 1), (1, "start", "b", '<B x="1">', 2), (1, "text", "", "t", 2), (1, "empty", "br", "<br>", 3), (1, "text", "", "u", 2), (1, "end", "b", "</b>", 2),
        (1, "text", "", "v", 1), (1, "end", "a", "</a>", 1), (1, "empty", "img", "<img/>", 1), (4, "text", "", "only text", 0),
    ]


def texts(spark, xml, names):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xml)], "k long, xml string")
    return [(r["k"], r["name"], r["level"], r["content"]) for r in elements.element_texts(df, ["k"], "xml", names).orderBy("k", "pos").collect()]


def test_nested_elements_repeat_their_text(spark):
    xml = "<d>x<div3>a <p>b<i>c</i></p> d<div3>e<p/><p>f &amp; g</p></div3>h</div3><p>i</p></d>"
    assert texts(spark, [xml, None, "", "<d/>", "<p></p><p>open"], ["p", "div3"]) == [
        (0, "div3", 1, "a bc def & gh"), (0, "p", 2, "bc"), (0, "div3", 2, "ef & g"), (0, "p", 3, ""), (0, "p", 3, "f & g"), (0, "p", 1, "i"), (4, "p", 1, ""), (4, "p", 1, "open"),
    ]


def test_nested_elements_equal_a_parser(spark):
    r = random.Random(5)

    def grow(depth):
        name = r.choice(["p", "div3", "note", "i"])
        inside = "".join(r.choice([f"w{r.randint(0, 99)} ", grow(depth + 1) if depth < 6 else "leaf"]) for _ in range(r.randint(0, 4)))
        return f"<{name}>{inside}</{name}>"

    xml = [f"<text>{''.join(grow(0) for _ in range(4))}</text>" for _ in range(12)]
    want = [(i, e.tag, " ".join("".join(e.itertext()).split())) for i, x in enumerate(xml) for e in ET.fromstring(x).iter() if e.tag in ("p", "div3")]
    assert [(k, n, c) for k, n, _, c in texts(spark, xml, ["p", "div3"])] == want


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_numbers_over_ranges(spark, ranges):
    r = random.Random(ranges)
    rows = [(r.choice(["a", "b", None]) if i % 3 else "hot", r.choice([None, r.randint(-50, 50)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x int, i int")
    key = lambda v: (v is not None, v if v is not None else 0)
    order = sorted(rows, key=lambda t: (key(t[1]), t[2]))
    got = {(t["g"], t["x"], t["i"]): t["n"] for t in numbering.numbered(df, ["x", "i"], "n", ranges=ranges).collect()}
    assert got == {t: n for n, t in enumerate(order, 1)}
    got = {(t["g"], t["x"], t["i"]): t["n"] for t in numbering.numbered(df, ["x", "i"], "n", by=["g"], ranges=ranges).collect()}
    assert got == {t: n for g in {t[0] for t in rows} for n, t in enumerate([t for t in order if t[0] == g], 1)}


def test_numbers_of_few_rows(spark):
    df = spark.createDataFrame([], "x int")
    assert numbering.numbered(df, ["x"]).collect() == [] and numbering.numbered(df, ["x"], ranges=8).collect() == []
    same = spark.createDataFrame([(1,)] * 5, "x int")
    assert sorted(r["row_no"] for r in numbering.numbered(same, ["x"], ranges=8).collect()) == [1, 2, 3, 4, 5]


def test_a_large_group_is_numbered_in_many_ranges(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.col("id").alias("x"))
    cuts = numbering._cuts(df, ["g", "x"], 16)
    sizes = [r["count"] for r in df.groupBy(numbering._range(F.struct("g", "x"), cuts, "struct<g:string,x:bigint>")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 400


@pytest.mark.parametrize("split", ["64", "1000", "128m"])
def test_lines_of_split_files(spark, tmp_path, split):
    (tmp_path / "a.tsv").write_bytes(b"h1\th2\r\n" + b"".join(b"%d\tx%d%s" % (i, i * i, b"\r\n" if i % 2 else b"\n") for i in range(200)))
    (tmp_path / "b.tsv").write_bytes("id\tname\n7\té\n\n \nx\t\tmore\n9".encode())
    (tmp_path / "c.tsv").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = readers.tsv(spark, str(tmp_path), "id int, name string", skip=1, file="file").withColumn("file", F.regexp_extract("file", "([a-z])[.]tsv", 1))
        got = sorted(tuple(r) for r in rows.collect())
        assert split != "64" or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([("a", i + 1, i, f"x{i * i}") for i in range(200)] + [("b", 1, 7, "é"), ("b", 4, None, ""), ("b", 5, 9, None)], key=lambda t: (t[0], t[1]))
