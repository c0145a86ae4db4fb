import random
import time

import pytest
from pyspark.sql import functions as F

from lineloom.functions import editions, markup
from tests.test_functions import one


@pytest.mark.parametrize(
    "text, want",
    [
        ("Homilies of St. John Chrysostom,\n\non the\nThe text.\non the way", "The text.\non the way"),
        ("The text.\non the", "The text.\non the"),
        ("on the\n—\n.", "on the\n—\n."),
        ("", ""),
        (None, None),
    ],
)
def test_header_lines(spark, text, want):
    assert one(spark, text, editions.header_lines_removed) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Matt. IV. 1, 2. Then", "Then"),
        ("Matthew 4:1. Then", "Then"),
        (", 5. Then", "Then"),
        ("<p>\u00a0Matthew iv. 1-3</p>", "<p></p>"),
        ("<p> Matt. 4. 1 Then</p>", "<p>Then</p>"),
        ("Then Matt. 4. 1", "Then Matt. 4. 1"),
        (None, None),
    ],
)
def test_leading_references(spark, text, want):
    assert one(spark, text, lambda c: editions.leading_reference_removed(c, ["Matt.", "Matthew"])) == want


def test_blocks_are_cut_without_looking_back(spark):
    """The same blocks as a split behind every end tag; looking back at each character took most of the time."""
    rng = random.Random(7)
    texts = ["".join(rng.choice(["<p>", "</p>", "</P>", "</h3>", "</blockquote>", "<", "</", "<i>", "a", " ", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(2000)] + [None]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    split = F.filter(F.split("s", "(?i)(?<=</p>|</h3>|</blockquote>)"), lambda b: b != "")
    assert df.where(~editions.blocks(F.col("s")).eqNullSafe(split)).count() == 0
    rules = editions.titles_removed(editions.headers_removed(F.col("s"), F.lit("john")), F.lit("II"))
    plan = df.select(rules.alias("y"))._jdf.queryExecution().executedPlan().toString()
    assert "(?<=" not in plan and "(?=[Hh])" in plan


def test_titles(spark):
    rows = [
        ('<p><span>Homily II.</span></p><p> "q" </p>Homily II. a Homily  II. b Homily III.', "II", False),
        ("Homily I. begins", "I", True),
        ('<p>"q"</p>Homily I.', None, False),
        (None, "I", False),
    ]
    df = spark.createDataFrame(rows, "s string, n string, spare boolean")
    got = [r["y"] for r in df.select(editions.titles_removed(F.col("s"), F.col("n"), F.col("spare")).alias("y")).collect()]
    assert got == [" a  b Homily III.", "Homily I. begins", "Homily I.", None]


def test_headers_by_book(spark):
    text = "Homilies of St. John Chrysostom, on the gospel according to st. matthew. Text st. john. archbishop of constantinople,"
    parts = "<p>Homilies of\nSt. John Chrysostom,</p>\n<p><i>on the</i></p><p>—</p><p>Gospel according to <b>St. Matthew</b>.</p><p>On the third day</p>"
    rows = [(text, "matthew"), (text, "luke"), (text, None), (None, "john"), ("st. john. Text", "john"), (parts, "matthew"), ("<p>st. johnny</p>", "john"), ("<p>on the</p>", "john"), ("", "john"), ("On the way", "john")]
    df = spark.createDataFrame(rows, "s string, b string")
    got = [r["y"] for r in df.select(editions.headers_removed(F.col("s"), F.col("b")).alias("y")).collect()]
    rest = text.removeprefix("Homilies of St. John Chrysostom, ")  # another book's words stay
    assert got == ["Text st. john. archbishop of constantinople,", rest, rest, None, "Text", "<p>On the third day</p>", "<p>st. johnny</p>", "<p>on the</p>", "", "On the way"]
    preface = [r["y"] for r in spark.createDataFrame([("<p>Preface.</p><p>They that are</p>", True), ("<p>Preface. They</p>", True), ("<p>Preface.</p>", False)], "s string, p boolean").select(editions.headers_removed(F.col("s"), F.lit("john"), F.col("p")).alias("y")).collect()]
    assert preface == ["<p>They that are</p>", "<p>They</p>", "<p>Preface.</p>"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("<A NAME=\"C3\"></A></SPAN><sup>16</sup></h3> <p>a</p>", "<p>a</p>"),
        ("<h3>SERMON IV.</h3><p>a</p><h3>Other</h3>", "<p>a</p><h3>Other</h3>"),
        ("<p>a</p><p> </p><p class=\"x\">From the Syriac MS.</p><p>From the hills</p>", "<p>a</p><p>From the hills</p>"),
        ("<blockquote><p>From Mai</blockquote><blockquote>And it came</blockquote>", "<blockquote>And it came</blockquote>"),
        ("<p>cc. 2:21-24.</p><p>c. 2:21.</p><p>c. 2:21 is read</p>", "<p>c. 2:21 is read</p>"),
        ("<p>From S. Cyril's Commentary on Luke</p><p>a Sermon of S. Cyril, b</p><p>c</p>", "<p>c</p>"),
        ("a [From Mai and Cramer] b [from  him] c [Fromage]", "a  b  c [Fromage]"),
        ("<p>SERMON II. He <i>said</i> <b>so</b></p>", "<p>He <em>said</em> <strong>so</strong></p>"),
        ('a<A NAME="1"></A>1. <sup>x</sup> note <i>b</i><A NAME="q"></A>c<A NAME="2"></A>2. d<p>e</p>', 'a<A NAME="q"></A>c<p>e</p>'),
        ("<script>x\ny</script><style>z</style> a", "a"),
        ("", ""),
        (None, None),
    ],
)
def test_sermons(spark, text, want):
    assert one(spark, text, editions.sermon_cleaned) == want


def test_long_texts_have_no_deep_patterns(spark):
    long = "word " * 60_000
    assert one(spark, f"<p>{long}</p>", editions.sermon_cleaned) == f"<p>{long}</p>"
    assert one(spark, f'{long}<a name="1"></a>1. {long}', editions.sermon_cleaned) == long.rstrip()
    assert one(spark, " " * 100_000 + "st. john. a", lambda c: editions.headers_removed(c, F.lit("john"))) == " " * 100_000 + "a"


def test_sermons_take_time_in_proportion_to_their_length(spark):
    """White space inside a text was read again from each of its characters."""
    began = time.time()
    assert one(spark, "a" + " " * 400_000 + "b \n", editions.sermon_cleaned) == "a" + " " * 400_000 + "b"
    assert time.time() - began < 30


def test_remarks_behind_tags(spark):
    """What makes a remark may stand behind or between tags."""
    texts = ["<p><i>From</i> Mai</p>", "<p>\u00a0[<b>F</b>rom Aubert</p>", "<p>a Ser<i>mon</i> of S. Cyril</p>", "<p><i></i>\u00a0</p>", "<p>c<i>c</i>. 1:2.</p>", "<H3>x, sermon iv</H3>", "<p>x, sermon iv</p>", "<p>Word from Mai</p>", "<div>From Mai</div>"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string")
    assert [r["y"] for r in df.orderBy("i").select(editions.is_remark(F.col("s")).alias("y")).collect()] == [True] * 6 + [False] * 3


def test_divisions_and_slices(spark):
    xml = '<div2 type="Homily" n="II">b</div2><div2 type="Homily" title="Hebrews">x</div2><div2 type="Homily">c</div2>'
    by_numeral = lambda n: one(spark, xml, lambda c: editions.division_by_numeral(c, F.lit(n)))
    by_ordinal = lambda n: one(spark, xml, lambda c: editions.division_by_ordinal(c, F.lit(n), "Homily", "Hebrews"))
    assert by_numeral("II").endswith(">b</div2>") and by_numeral("I") is None
    assert by_ordinal(2) == '<div2 type="Homily">c</div2>' and by_ordinal(3) is None and by_ordinal(0) is None
    for text, want in [("a #1 b <hr> #2", "#1 b <hr> "), ("a #1 b <hr>", "#1 b "), ("a #1 b", "#1 b"), ("a", None), ("", None), (None, None)]:
        assert one(spark, text, lambda c: editions.slice_ladder(c, "#1", ["#2", "<hr>"])) == want


def test_notes(spark):
    assert one(spark, '<note><p>[<span lang="EL">x</span> a]</p></note>', editions.note_text) == "[Greek: x] a"
    assert one(spark, "[a] b", editions.note_text) == "[a] b" and one(spark, "[", editions.note_text) == "[" and one(spark, "[]", editions.note_text) == "" and one(spark, None, editions.note_text) is None
    assert one(spark, '<i>a</i> <note/>b<note n="1"><i>c</i></note> <scripRef>d</scripRef>', editions.selective_text) == "<em>a</em> b d"
    page = '<A NAME="1"></A>1. a <I>b</I> c<p>d <A NAME="11"></A>11. e'
    assert one(spark, page, lambda c: editions.note_by_number(c, F.lit(1))) == "a b c"
    assert one(spark, page, lambda c: editions.note_by_number(c, F.lit(2))) is None
    pages = spark.createDataFrame([("f", '<A HREF="#1"><SUP>1</SUP></A><A NAME="1"><SUP>1</SUP></A> x <A NAME="1"><SUP>1</SUP></A> y <A NAME="2"><SUP>2</SUP></A> z<A HREF="#3"><SUP>4</SUP></A>'), ("g", ""), ("h", None)], "file string, html string")
    assert [tuple(r) for r in editions.marked_notes(pages, "file", "html").collect()] == [("f", "f_note_1", 1, "x")]


@pytest.mark.parametrize("text, want", [("2:21-24. And when", (2, 21, 24, "And when")), ("2:21. And\nx", (2, 21, 21, "And")), ("And 2:21.", None), ("", None), (None, None)])
def test_verse_quote(spark, text, want):
    got = one(spark, text, editions.verse_quote)
    assert (tuple(got) if got else got) == want
