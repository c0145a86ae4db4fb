import random

import pytest
from pyspark.sql import functions as F

from lineloom.functions import markup, numerals, refs


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).collect()[0]["y"]


def roman(n):
    out = ""
    for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= v:
            out, n = out + s, n - v
    return out


def test_roman_both_ways(spark):
    rows = spark.range(-2, 4200).select("id", numerals.to_roman(F.col("id")).alias("r")).select("id", "r", numerals.from_roman(F.col("r")).alias("n"), numerals.from_roman(F.col("r"), True).alias("s")).collect()
    for r in rows:
        assert r["r"] == roman(r["id"]) and r["n"] == max(r["id"], 0)
        assert r["s"] == (r["id"] if r["id"] > 0 else None)


@pytest.mark.parametrize("s,n,strict", [("XiV", 14, 14), ("IQ", 1, None), ("", 0, None), ("MCMXCIV", 1994, 1994), (None, None, None)])
def test_roman_odd(spark, s, n, strict):
    assert one(spark, s, numerals.from_roman) == n
    assert one(spark, s, lambda c: numerals.from_roman(c, True)) == strict


@pytest.mark.parametrize(
    "ref,want",
    [
        ("1.2", (1, 2, 1, 2)),
        ("1.2B", (1, 2, 1, 2)),
        ("1.2-5", (1, 2, 1, 5)),
        ("1.36-2.46", (1, 36, 2, 46)),
        ("3.16A-4.1C", (3, 16, 4, 1)),
        ("1.2-3-9", (1, 2, 1, 3)),
        ("18.10 (-11, in note)", None),
        ("3.16B-E", None),
        ("17.34-35 (+36, in note)", None),
        ("23.17 (in note)", None),
        ("19.24C (=19.25 X) -27", None),
        ("1.2.3", None),
        ("12", None),
        ("1.2-", None),
        (" 1.2", None),
        ("", None),
        (None, None),
    ],
)
def test_ranges(spark, ref, want):
    got = one(spark, ref, refs.parse_range)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("s,want", [("1.35-37", (1, 35, 37)), ("4.54; 5.1", (4, 54, 54)), ("1.28,29", (1, 28, 29)), ("13", (13, 1, 1)), ("Preface", None), ("4.54-5.1", (4, 54, 1))])
def test_passages(spark, s, want):
    got = one(spark, s, refs.parse_passage)
    assert (tuple(got) if got else None) == want


def test_passages_are_read_as_pattern_by_pattern(spark):
    """The pattern that reads all forms against one pattern for each."""
    import re

    dash, comma, point, chapter = r"\s*(\d+)\.(\d+)\s*-\s*(?:\d+\.)?(\d+)", r"\s*(\d+)\.(\d+)\s*,.*?(\d+)\s*$", r"\s*(\d+)\.(\d+)", r"\s*(\d+)\s*$"

    def read(s):
        if (m := re.match(dash, s, re.A)) or ";" not in s and (m := re.match(comma, s, re.A)):
            return tuple(map(int, m.groups()))
        if m := re.match(point, s, re.A):
            return int(m[1]), int(m[2]), int(m[2])
        return (int(m[1]), 1, 1) if (m := re.match(chapter, s, re.A)) else None

    rng = random.Random(3)
    texts = ["".join(rng.choice(["1", "27", ".", ".", "-", ",", ";", " ", "x", "\n"]) for _ in range(rng.randint(1, 11))) for _ in range(4000)] + ["1.2 - 3.", "1.2, 3;", "1.2,3\n4", " 1.2 , 3 - 45 "]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", refs.parse_passage(F.col("x")).alias("y"))
    assert [(r["x"], tuple(r["y"]) if r["y"] else None) for r in df.collect()] == [(x, read(x)) for x in texts]


def test_parsers_match_each_group_once(spark):
    """Wide expressions of patterns grow beyond what the JVM compiles."""
    df = spark.createDataFrame([("1.2",)], "x string")
    plan = df.select(refs.parse_passage(F.col("x")).alias("p"), refs.parse_colon_range(F.col("x")).alias("r"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract(") + plan.count("RLIKE") + plan.count("regexp_replace") <= 7


def test_labels_and_keys(spark):
    assert one(spark, "3.16B-4", refs.start_key) == "3:16"
    assert one(spark, "18.10 (-11", refs.start_key) == "18:10 ("
    assert one(spark, "4: 1 - 5:2", lambda c: refs.range_label(*[refs.parse_colon_range(c)[f] for f in ("sc", "sv", "ec", "ev")])) == "4:1-5:2"
    assert one(spark, 7, refs.padded, "int") == "07" and one(spark, 119, refs.padded, "int") == "119"
    assert one(spark, "a-b-c", refs.split_key) is None
    assert one(spark, "Matt 1, 5, 9 ", refs.last_in_list) == "9"


@pytest.mark.parametrize("most", range(1, 14))
def test_cut_bytes(spark, most):
    for s in ("aé日🙂b", "abc", "日本語日本", ""):
        raw = s.encode()
        want = s if len(raw) <= most else raw[:most].decode(errors="ignore") + "..."
        assert one(spark, s, lambda c: markup.cut_bytes(c, most)) == want


def test_highlight_quotes_every_character(spark):
    term = "a.b*[c]\\E$1(^|?+{}"
    assert one(spark, f"x {term.upper()} y", lambda c: markup.highlight(c, term)) == f"x <mark>{term.upper()}</mark> y"
    assert one(spark, "x", lambda c: markup.highlight(c, "")) == "x"


def test_markup_rules(spark):
    assert one(spark, "a<pb n='1'/>b", lambda c: markup.rewrite(c, markup.PAGE_BREAKS)) == "ab"
    assert one(spark, "end. <pb/> Next", lambda c: markup.rewrite(c, markup.PAGE_BREAKS)) == "end. Next"
    assert one(spark, "a  b,c> <d", lambda c: markup.rewrite(c, markup.TIDY_SPACE)) == "a b, c><d"
    assert one(spark, "word <sup>1</sup>, next", lambda c: markup.rewrite(c, markup.MARK_AFTER_PUNCTUATION)) == "word,<sup>1</sup> next"
    assert one(spark, "<p>a</p> <p> </p><p class='x'>b</p>", markup.paragraphs) == "<p>a</p><p>b</p>"
    assert one(spark, "<div><p>a<b>c</b></p></div>", lambda c: markup.strip_tags(c, ["p"])) == "<p>ac</p>"
    assert one(spark, "Matt. V. 3, 4. Blessed", markup.leading_reference_removed) == "Blessed"
    assert one(spark, "a  \t b", markup.normalise_space) == "a b"
    assert one(spark, "a--b — c", lambda c: markup.rewrite(c, markup.HYPHENS)) == "ab c"
    assert one(spark, "x[From the MS]y<script>1</script>", lambda c: markup.rewrite(c, markup.CLEAN_DOCUMENT)) == "xy"
    assert one(spark, "one two one three", lambda c: markup.between(c, "one", "three", 2)) == "one "
    assert one(spark, "one", lambda c: markup.between(c, "two", "x")) is None


def test_natural_number(spark):
    assert one(spark, "n. 12b", numerals.natural_number) == 12 and one(spark, "*", numerals.natural_number) == 0


def test_replace_with_makes_the_text_once(spark):
    df = spark.createDataFrame([(1, "a<n 1>b<n 2>"), (2, "c"), (3, ""), (4, "<n 3>")], "id int, t string").withColumn("t", F.concat("t", F.lit("MADE")))
    out = markup.replace_with(df, ["id"], "t", "<n ([0-9])>", ["no"], lambda found: found.withColumn("replacement", F.concat("no", F.lit("/"), F.col("ordinal").cast("string"))))
    assert {r["id"]: r["t"] for r in out.collect()} == {1: "a1/1b2/2MADE", 2: "cMADE", 3: "MADE", 4: "3/1MADE"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MADE") == 1


def test_replace_with_joins_a_table(spark):
    df = spark.createDataFrame([(1, "a<n 7>b<n 8>c<n 7>"), (2, "none"), (3, "<n 9>")], "id int, t string")
    known = spark.createDataFrame([("7", "seven"), ("9", "nine")], "no string, word string")
    write = lambda m: m.join(known, "no", "left").withColumn("replacement", F.concat(F.lit("["), F.col("ordinal").cast("string"), F.lit(":"), "word", F.lit("]")))
    got = {r["id"]: r["t"] for r in markup.replace_with(df, ["id"], "t", "<n ([0-9])>", ["no"], write).collect()}
    assert got == {1: "a[1:seven]bc[3:seven]", 2: "none", 3: "[1:nine]"}


def test_random_references(spark):
    random.seed(2)
    rows = [(f"{random.randint(1, 30)}.{random.randint(1, 50)}{random.choice(['', 'A', 'BC'])}" + random.choice(["", f"-{random.randint(1, 50)}", f"-{random.randint(1, 30)}.{random.randint(1, 50)}A", "-x", " b"]),) for _ in range(400)]

    def brute(ref):
        def number(s):
            return int(s) if s.isdigit() else None

        parts = ref.split("-")
        a = parts[0].rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ").split(".")
        if len(a) != 2:
            return None
        sc, sv = map(number, a)
        ec, ev = sc, sv
        if len(parts) > 1:
            b = parts[1].rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ").split(".")
            ec, ev = (number(b[0]), number(b[1])) if len(b) == 2 else (sc, number(b[0]))
        return None if None in (sc, sv, ec, ev) else (sc, sv, ec, ev)

    for r in spark.createDataFrame(rows, "x string").select("x", refs.parse_range(F.col("x")).alias("y")).collect():
        assert (tuple(r["y"]) if r["y"] else None) == brute(r["x"]), r["x"]
