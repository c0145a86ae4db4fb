import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.operators import grouping, intervals, lookup, reshape, runs
from lineloom.plans import crossref, search
from lineloom.sources import notes, readers, writers


@pytest.mark.parametrize("rows", [1, 7, 200_000])
def test_overlap_equals_nested_loop(spark, rows):
    random.seed(1)
    make = lambda: [(i, random.randint(1, 12), random.randint(1, 9), random.randint(1, 12), random.randint(1, 9)) for i in range(150)]  # noqa: E731  many end before they start
    left, right = make(), make()
    a = spark.createDataFrame(left, "l int, a int, b int, c int, d int")
    b = spark.createDataFrame(right, "r int, e int, f int, g int, h int")
    got = intervals.overlap_join(a, b, "l", "r", "abcd", "efgh", rows=rows).select("l", "r").collect()
    want = {(x[0], y[0]) for x in left for y in right if x[1:3] <= y[3:5] and x[3:5] >= y[1:3]}
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    plan = intervals.overlap_join(a, b, "l", "r", "abcd", "efgh")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_alternate_equals_recurrence(spark):
    random.seed(3)
    rows = [(line, random.choice([-2, -1, 1, 2, 3])) for line in range(1, 80) for _ in range(random.randint(0, 4))]
    shown, state = [], set()
    for line in range(1, 80):
        now = [k for n, k in rows if n == line]
        drawn = {k for k in now if k not in state}
        shown += [(line, k, k in drawn) for k in now]
        state = drawn
    df = spark.createDataFrame([(1, *r) for r in rows], "p int, line int, k int")
    assert sorted(tuple(r) for r in runs.alternate(df, ["p"], "line", "k").select("line", "k", "shown").collect()) == sorted(shown)


def test_on_change_skips_blanks(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "", "a", None, "b", "b", "a"])], "p int, i int, v string")
    assert [r["shown"] for r in runs.on_change(df, ["p"], ["i"], "v").orderBy("i").collect()] == ["a", None, None, None, "b", None, "a"]


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate([False, None, True, False, True])], "p int, i int, b boolean")
    assert [r["paragraph"] for r in runs.paragraphs(df, ["p"], ["i"], "b").orderBy("i").collect()] == [1, 1, 2, 2, 3]


def test_ends_from_successor(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 1), (2, 1, 18, 1, 25), (3, 3, 1, 3, 1), (4, 3, 7, None, None)], "n int, sc int, sv int, ec int, ev int")
    sizes = spark.createDataFrame([(2, 23)], "major int, size int")
    run = lambda **how: [(r["ec"], r["ev"]) for r in intervals.end_from_successor(df, [], "n", ("sc", "sv"), ("ec", "ev"), **how).orderBy("n").collect()]
    assert run(last="if_open") == [(1, 17), (1, 25), (3, 6), (28, 20)]
    assert run(override="always", sizes=sizes) == [(1, 17), (2, 23), (3, 6), (28, 20)]
    assert run(override="always", last="always") == [(1, 17), (2, 50), (3, 6), (28, 20)]


def test_in_range_has_gaps(spark):
    got = spark.range(24, 29).select(intervals.in_range(F.col("id"), [(1, 25, "a"), (27, 40, "b")]).alias("x")).collect()
    assert [r["x"] for r in got] == ["a", "a", None, "b", "b"]


def test_first_wins_keeps_blanks(spark):
    df = spark.createDataFrame([("", 1), ("", 2), ("k", 3), ("k", 4), (None, 5)], "k string, i int")
    assert sorted(r["i"] for r in grouping.first_wins(df, "k", ["i"]).collect()) == [1, 2, 3, 5]


def test_enumeration_leaves_gaps(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (1, 3, "c")], "h int, pos int, t string")
    assert [(r["pos"], r["number"]) for r in grouping.enumerated(df, ["h"], ["pos"], "t").orderBy("pos").collect()] == [(1, 1), (3, 3)]


def test_renumber_is_natural(spark):
    df = spark.createDataFrame([(1, x) for x in ("10", "2", "2a", "*")], "h int, n string")
    assert {r["n"]: r["display_number"] for r in grouping.renumbered(df, ["h"], "n").collect()} == {"*": 1, "2": 2, "2a": 3, "10": 4}


def test_grouped_structs(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, n int, t string")
    assert [r["t"] for r in grouping.grouped(df, ["k"], ["n"], ["n", "t"]).collect()[0]["items"]] == ["a", "b"]


def test_range_rows_backwards_is_empty(spark):
    df = spark.createDataFrame([(3, 5), (5, 3)], "a int, b int")
    assert [r["v"] for r in reshape.range_rows(df, "a", "b", "v").collect()] == [3, 4, 5]


def test_nested_map_takes_repeats(spark):
    df = spark.createDataFrame([("m", "1", "x"), ("m", "1", "y"), ("m", "2", "z")], "o string, i string, v string")
    assert reshape.nested_map(df, "o", "i", "v").collect()[0]["map"] == {"1": "y", "2": "z"}


def test_layered_lookup(spark):
    df = spark.createDataFrame([("a", 1), ("q", 2), ("q", 9)], "id string, place int")
    notes = spark.createDataFrame([("a", 5, "by id"), ("b", 2, "by place")], "k string, p int, t string")
    got = lookup.first_of(df, [(notes, "id", "k"), (notes, "place", "p")], "t", F.lit("none"), "t").collect()
    assert sorted(r["t"] for r in got) == ["by id", "by place", "none"]


def test_verse_lines(spark):
    df = spark.createDataFrame([("1:2 text here",), ("no colon",), ("1:x text",), ("1:+3 t",), ("1:4",), ("even in c:5 x",)], "line string")
    assert sorted((r["verse"], r["text"]) for r in readers.verse_lines(df).collect()) == [(2, "text here"), (3, "t"), (5, "x")]


def test_chapter_files_round_trip(spark, tmp_path):
    for chapter, text in ((1, "1:1 In the\n1:2 beginning"), (12, "12:1 last")):
        d = tmp_path / "in" / "luke" / f"{chapter:02d}"
        d.mkdir(parents=True)
        (d / f"luke_{chapter:02d}.txt").write_text(text)
    df = readers.chapter_files(spark, str(tmp_path / "in"))
    assert sorted((r["book"], r["chapter"], r["line_no"]) for r in df.collect()) == [("luke", 1, 1), ("luke", 1, 2), ("luke", 12, 1)]
    verses = readers.verse_lines(df)
    writers.write_chapters(verses, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert sorted(r["value"] for r in back.collect()) == ["12:1 last", "1:1 In the", "1:2 beginning"]


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"luke": {"1:1": "I.1", "1:2": "V.2"}}')
    m = notes.read_with_rejects(spark, str(tmp_path / "m.json"), T.StructType.fromDDL("luke map<string,string>"))[0]
    assert sorted((r["key"], r["value"]) for r in readers.map_rows(m, "luke").collect()) == [("1:1", "I.1"), ("1:2", "V.2")]
    assert readers.map_rows(m, "luke", whole_keys=True).count() == 0
    assert [x.count() for x in notes.read_with_rejects(spark, str(tmp_path / "absent.json"), T.StructType.fromDDL("luke map<string,string>"))] == [0, 0]
    (tmp_path / "c.txt").write_text("Mt\tMk\n1\t2\n3\t\n1,4\t5\n")
    rows = readers.tsv(spark, str(tmp_path / "c.txt"), "mt int, mk int", skip=1).orderBy("rowid").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 2), (2, 3, None), (3, None, 5)]
    (tmp_path / "h.xml").write_text('<body><div2 n="IV" type="Homily"><p>one</p><p>two</p></div2><div2 n="V" type="Homily"><p>three</p></div2></body>')
    x = readers.xml_rows(spark, str(tmp_path / "h.xml"), "div2")
    assert sorted(r["_n"] for r in x.collect()) == ["IV", "V"]
    doc = spark.read.text(str(tmp_path / "h.xml"), wholetext=True).withColumnRenamed("value", "xml")
    assert [r["content"] for r in readers.element_texts(doc, "xml", "//p").orderBy("pos").collect()] == ["one", "two", "three"]
    assert [r["file"] for r in readers.listed_files(spark, str(tmp_path), ends=".txt").collect()] == ["c.txt"]


def test_map_json_takes_repeated_keys(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3)], "k string, v int")
    assert writers.map_json(df, "k", "v").collect()[0]["json"] == '{"a":3,"b":1}'


def test_search_order_and_limit(spark):
    df = spark.createDataFrame([(2, "x The b\nnothing\nthe"), (1, "a THE c")], "id int, text string")
    got = search.search(df, "the", ["id"], most=2).collect()
    assert [(r["id"], r["ref"], r["snippet"]) for r in got] == [(1, "a", "<mark>THE</mark> c"), (2, "x", "<mark>The</mark> b")]
    assert search.search(df, "", ["id"]).count() == 0


def test_tooltip(spark):
    df = spark.createDataFrame([(["a", "b"], "I.1"), ([], "II.3")], "p array<string>, k string")
    assert [r["t"] for r in df.select(crossref.tooltip(F.col("p"), F.col("k")).alias("t")).collect()] == ["a; b", "Canon II.3"]


def test_stream_sessions_equal_batch(spark, tmp_path):
    from lineloom.streaming.sessions import event_stream, sessions

    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    q = sessions(event_stream(spark, str(tmp_path / "in"), schema), watermark="1 hour").writeStream.outputMode("complete").format("memory").queryName("s").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("s").count() == sessions(df).count()


def test_element_texts_are_whole(spark):
    from pyspark.errors import PySparkException

    from lineloom.sources import readers

    xml = "<d><p>one <i>two</i> three</p><q/><p><i>only</i></p><p a='1'/></d>"
    df = spark.createDataFrame([(1, xml), (2, None), (3, "<d/>")], "k int, xml string")
    assert [(r["k"], r["pos"], r["content"]) for r in readers.element_texts(df, "xml", "/d/p").collect()] == [(1, 0, "one two three"), (1, 1, "only"), (1, 2, "")]
    with pytest.raises(PySparkException):
        readers.element_texts(spark.createDataFrame([("<d><p>a</p><e><p>b</p></e></d>",)], "xml string"), "xml", "/d/p").collect()
    with pytest.raises(ValueError):
        readers.element_texts(df, "xml", "/d/p[1]")


def test_unknown_books_are_the_default(spark):
    from lineloom.plans import crossref

    book, chapter = crossref.route(F.col("p"))
    df = spark.createDataFrame([("/nosuchbook/7",), ("/john/x",), ("",)], "p string")
    assert [tuple(r) for r in df.select(book, chapter).collect()] == [("matthew", 7), ("john", 1), ("matthew", 1)]


def test_overlap_of_hot_majors(spark):
    """Most intervals lie in one major, at one minor or over all of them: no task gets much more than the others."""
    r = random.Random(3)

    def interval(i):
        at = (7, r.randint(0, 10_000)) if i % 3 else (7, 500)
        return (i, *at, at[0], at[1] + r.randint(-1, 2)) if i % 50 else (i, r.randint(0, 9), 0, 9, r.randint(0, 9))

    left, right = [interval(i) for i in range(3000)], [interval(i) for i in range(900)]
    a = spark.createDataFrame(left, "l int, a int, b int, c int, d int")
    b = spark.createDataFrame(right, "r int, e int, f int, g int, h int")
    want = sorted((x[0], y[0]) for x in left for y in right if x[1:3] <= y[3:5] and x[3:5] >= y[1:3])
    got = intervals.overlap_join(a, b, "l", "r", "abcd", "efgh", rows=100)
    assert sorted((x["l"], x["r"]) for x in got.select("l", "r").collect()) == want

    ends = a.select(F.col("a").cast("long") * (1 << 32) + F.col("b")).toDF("at")
    cuts = intervals._cuts(ends, 100)
    assert len(cuts) > 10  # one major alone is cut into bands
    banded = intervals._banded(intervals._positions(a, "abcd", "_l"), "_l", cuts)
    sizes = {x["b"]: x["n"] for x in banded.groupBy(F.col("_l_at").alias("b")).agg(F.count("*").alias("n")).collect()}
    blocks = {b: -(-n // 100) for b, n in sizes.items() if n > 100}
    dealt = intervals._dealt(banded, "_l", "l", blocks, {}).groupBy("_l_at", "_l_own").count().select("count").collect()
    assert max(x[0] for x in dealt) < 4 * sorted(x[0] for x in dealt)[len(dealt) // 2] < max(sizes.values())


def test_overlap_needs_all_four_numbers(spark):
    a = spark.createDataFrame([(1, 1, 1, None, 5), (2, 1, -5, 1, 5), (3, -2, 0, -1, 3)], "l int, a int, b int, c int, d int")
    b = spark.createDataFrame([(1, 1, 1, 1, 1), (2, -1, 3, -1, 9), (3, None, 0, 9, 9)], "r int, e int, f int, g int, h int")
    assert sorted((x["l"], x["r"]) for x in intervals.overlap_join(a, b, "l", "r", "abcd", "efgh", rows=1).select("l", "r").collect()) == [(2, 1), (3, 2)]


def test_rows_of_one_interval_are_matched_once(spark):
    """Many rows share few intervals, some of them turned around or without an end: lists of what each interval overlaps meet its rows."""
    left = [(i, i % 3 if i % 11 else None, i % 4, i % 5, i % 3 + i % 2, i % 7 or None) for i in range(6000)]
    right = [(i, i % 3, i % 5, i % 2, i % 3 + i % 3 - 1, i % 4) for i in range(60)]
    a, b = spark.createDataFrame(left, "l int, k int, a int, b int, c int, d int"), spark.createDataFrame(right, "r int, k int, e int, f int, g int, h int")
    got = intervals.overlap_join(a, b, "l", "r", "abcd", "efgh", ["k"])
    assert "explode(_held" in got._jdf.queryExecution().toString() and sorted(got.columns) == sorted("lkabcdrefgh")
    want = [(x[0], y[0]) for x in left for y in right if x[1] == y[1] and None not in x and x[2:4] <= y[4:6] and x[4:6] >= y[2:4]]
    assert sorted((x["l"], x["r"]) for x in got.collect()) == sorted(want)
