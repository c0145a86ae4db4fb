from pyspark.sql import functions as F

from lineloom.functions import numerals
from lineloom.plans import pages

HOMILY = """<div2 type="Homily" n="II" title="Matt. II. 1">
<p>Homilies of St. John Chrysostom,</p> <p>archbishop of constantinople,</p><p>on the</p><p>gospel according to st. matthew.</p>
<p><span class="c10">Homily II.</span></p><p>"Now when Jesus was born."</p>
<p class="k">Matt. ii. 1, 2.</p><p>Need we <scripRef passage="x">Matt. 1</scripRef>much<note n="1" id="a"><p>A <i>note</i>, on the gospel according to st. matthew.</p></note> watchfulness <note n="9">gone</note>, much
prayer<note n="2">see "b"</note>.It is <b>hard</b> to under-<pb n="4"/>stand</p><div3><p>  </p><p>Homily II. ends [1.]<note n="3">c</note>Amen</p></div3></div2>"""
SERMON = """<html><a href="cyril_on_luke_02.htm">next</a><a name="SERMON XII"></a><h3>SERMON XII. <sup>1</sup></h3><p align="center">[From the Syriac]</p>
<blockquote>And <i>it</i> came<a href="#4"><sup>d</sup></a>.</blockquote><p>cc. 4:31-35.</p><p>He spake <a HREF="#2"><SUP>2</SUP></a>, and<a href="#77"><sup>e</sup></a> went</p><A NAME="4"></A>4. <sup>d</sup> defined here<a name="SERMON XIII"></a><h3>SERMON XIII.</h3><p>other</p>"""


def served(spark, requests):
    keys = "author string, book string, number int"
    raw = spark.createDataFrame([("chrysostom", "matthew", 2, HOMILY), ("cyril", "luke", 12, SERMON), ("chrysostom", "matthew", 3, HOMILY)], f"{keys}, raw string")
    roman = numerals.to_roman(F.col("number"))
    from lineloom.functions.editions import division_by_numeral

    homily = pages.homily_body(division_by_numeral(F.col("raw"), roman), F.col("book"), roman, ["Matt.", "Matthew"], F.lit(False))
    texts = raw.withColumn("body", F.when(F.col("author") == "cyril", pages.sermon_body(F.col("raw"), roman, '<a href="cyril_on_luke_')).otherwise(homily))
    notes = spark.createDataFrame(
        [("chrysostom", "matthew", 2, "1", 1, "First, of Homily II."), ("chrysostom", "matthew", 2, "2", 2, 'a "b"'), ("chrysostom", "matthew", 2, "3", 3, "c"), ("cyril", "luke", 12, "4", 1, "Greek: <x>"), ("cyril", "luke", 12, "5", 2, "second")],
        f"{keys}, original string, display int, content string",
    )
    coverage = spark.createDataFrame([("cyril", "luke", 12, 4, 31, 5, 2)], f"{keys}, start_major int, start_minor int, end_major int, end_minor int")
    asked = spark.createDataFrame(requests, "author string, book string, number string")
    known = {"chrysostom": ("matthew", "john"), "cyril": ("luke",)}
    return {(r["author"], r["book"], r["number"]): (r["status"], r["reference"], r["html"]) for r in pages.served(asked, texts, notes, coverage, known, "cyril").collect()}


def test_pages_as_served(spark):
    got = served(spark, [("chrysostom", "matthew", "2"), ("cyril", "luke", "12"), ("chrysostom", "matthew", "3"), ("chrysostom", "luke", "2"), ("basil", "luke", "2"), ("cyril", "luke", "twelve"), ("cyril", "luke", None), (None, "luke", "2")])
    note = '<sup class="note" data-note="{}">{}</sup>'
    assert got["chrysostom", "matthew", "2"] == (
        200,
        None,
        '<div class="text"><p>Need we much' + note.format("First, of Homily II.", 1) + " watchfulness, much prayer." + note.format("a &quot;b&quot;", 2) + " It is hard to understand</p><p>ends [1.]" + note.format("c", 3)
        + ' Amen</p><div class="notes"><ol><li id="fn-1">First, of Homily II.</li><li id="fn-2">a &quot;b&quot;</li><li id="fn-3">c</li></ol></div></div>',
    )
    assert got["cyril", "luke", "12"] == (
        200,
        "Luke 4:31-5:2",
        '<div class="text"><p class="reference">Luke 4:31-5:2</p><blockquote>And <em>it</em> came.' + note.format("Greek: &lt;x&gt;", 1) + "</blockquote><p>He spake," + note.format("second", 2) + " and" + note.format("Footnote 77", 3)
        + ' went</p><div class="notes"><ol><li id="fn-1">Greek: &lt;x&gt;</li><li id="fn-2">second</li></ol></div></div>',
    )
    assert {k: v for k, v in got.items() if v[0] != 200} == {
        ("chrysostom", "matthew", "3"): (404, None, None), ("chrysostom", "luke", "2"): (404, None, None), ("basil", "luke", "2"): (404, None, None), ("cyril", "luke", "twelve"): (400, None, None),
        ("cyril", "luke", None): (400, None, None), (None, "luke", "2"): (404, None, None),
    }


def test_rules_cannot_change_notes(spark):
    """A note may hold what every rule looks for."""
    worst = 'Homily II. <p>Matt. II. 1</p> st. matthew. [From Mai] <i>x</i> "q" .a'
    df = spark.createDataFrame([(1, "a<note n='1'>x</note> b")], "k int, s string")
    marked = df.select("k", pages.notes_set_aside(F.col("s"), "<note n='([^']+)'>[^<]*</note>").alias("s"))
    notes = spark.createDataFrame([(1, "1", 1, worst)], "k int, original string, display int, content string")
    assert pages.notes_put_back(marked, ["k"], "s", notes).first()["s"] == 'a<sup class="note" data-note="' + worst.replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;") + '">1</sup> b'


def test_keys_are_looked_up(spark):
    asked = spark.createDataFrame([("I.1",), ("I.2",), (None,)], "key string")
    known = spark.createDataFrame([("I.1", "a"), ("II.1", "b")], "key string, value string")
    assert {r["key"]: (r["status"], r["value"]) for r in pages.looked_up(asked, known, "key", ["value"]).collect()} == {"I.1": (200, "a"), "I.2": (404, None), None: (404, None)}
