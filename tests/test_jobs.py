import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.plans import canons
from lineloom.sources import notes, published

BOOKS = {"MAT": "matthew", "MRK": "mark"}


def test_readers_keep_the_old_rows_until_the_new_are_whole(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(LookupError):
        published.published(spark, root, "table")
    published.replace_table(spark.range(3), root)
    old = published.manifest(spark, root)
    assert [t["rows"] for t in old["tables"]] == [3]
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        published.replace_table(broken, root)
    assert published.manifest(spark, root) == old and published.published(spark, root, "table").count() == 3
    open_reader = published.published(spark, root, "table")
    published.replace_table(published.published(spark, root, "table").selectExpr("id + 10 AS id"), root)  # made from what it replaces
    assert sorted(r["id"] for r in published.published(spark, root, "table").collect()) == [10, 11, 12]
    assert open_reader.count() == 3  # the last run stays for readers that have begun
    assert len(list((tmp_path / "t" / "runs").iterdir())) == 2  # the failed run is gone


def test_a_failing_step_publishes_none_of_its_run(spark, tmp_path):
    root = str(tmp_path / "t")
    one = [("a", "parquet", lambda _: spark.range(2)), ("b", "json", lambda t: t["a"].selectExpr("id * 2 AS twice"))]
    published.publish(spark, root, one)
    with pytest.raises(ZeroDivisionError):
        published.publish(spark, root, [("a", "parquet", lambda _: spark.range(9)), ("b", "json", lambda t: 1 // 0)])
    assert published.published(spark, root, "a").count() == 2
    assert sorted(r["twice"] for r in published.published(spark, root, "b", "twice long").collect()) == [0, 2]


def test_canons_as_one_job(spark, tmp_path):
    for canon, rows in {1: "MAT\tMRK\n1\t1\n1\t2\n\t3\n", 2: "h\n2\n", 13: "x\n"}.items():
        (tmp_path / f"canon={canon}").mkdir()
        (tmp_path / f"canon={canon}" / "part.txt").write_text(rows)
    sections = spark.createDataFrame([("matthew", 1, "1.1"), ("matthew", 2, "1.17B-2.3"), ("mark", 1, "1.1-3"), ("mark", 2, "1.1"), ("mark", 3, "unknown"), ("mark", 4, "9.9")], "book string, section int, reference string")
    root = str(tmp_path / "out")
    for _ in range(2):  # a second run replaces the first
        done = canons.run(spark, root, canons.read_canons(spark, str(tmp_path / "canon=*"), BOOKS), sections, BOOKS)
        assert {t["name"]: t["rows"] for t in done["tables"]} == {"entries": 6, "canons": 6, "canon_lookup": 4, "verse_to_canon": 2, "counts": 1}
    read = lambda name, key: {r[key]: json.loads(r["json"]) for r in published.published(spark, root, name).collect()}
    assert read("canon_lookup", "key") == {"I.1": {"mark": "1.1-3", "matthew": "1.1"}, "I.2": {"mark": "1.1", "matthew": "1.1"}, "I.3": {"mark": "unknown"}, "II.1": {"matthew": "1.17B-2.3"}}
    assert read("verse_to_canon", "book") == {"matthew": {"1:1": "I.2", "1:17": "II.1"}, "mark": {"1:1": "I.2"}}
    assert {(r["key"], r["sc"], r["ev"]) for r in published.published(spark, root, "entries").where("book = 'matthew'").collect()} == {("I.1", 1, 1), ("I.2", 1, 1), ("II.1", 1, 3)}
    assert json.loads(published.published(spark, root, "counts").first()["json"])["total"] == 6


def test_notes_of_all_shapes(spark, tmp_path):
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "a.json").write_text(json.dumps({"1": [{"homily": 1, "original_number": "7", "display_number": 1, "content": "a", "id": "x"}, {"original_number": "8", "display_number": 2}, "text"], "2": [], "3": {"no": "list"}}))
    (tmp_path / "lists" / "b.json").write_text("not json")
    (tmp_path / "lists" / "c.json").write_text("{ }")
    (tmp_path / "pages.json").write_text(json.dumps({"4": {"roman_numeral": "IV", "footnotes": [{"original_number": 3, "display_number": 1, "content": ""}]}, "5": {"roman_numeral": "V"}, "6": 6}))
    (tmp_path / "named.json").write_text(json.dumps({f"k{n}": {"file": "cyril_on_luke_02_sermons", "number": n, "text": f"t{n}"} for n in (11, 2)} | {"k": {"file": "x", "number": 1}}))
    sources = {"l": (str(tmp_path / "lists"), "lists"), "p": (str(tmp_path / "pages.json"), "pages"), "n": (str(tmp_path / "named.json"), "named"), "gone": (str(tmp_path / "gone"), "pages")}
    good, bad = notes.load(spark, sources, r"luke_(\d+)_")
    assert sorted(map(tuple, good.collect())) == [("l", "1", "7", 1, "a"), ("n", "02", "11", 2, "t11"), ("n", "02", "2", 1, "t2"), ("p", "4", "3", 1, "")]
    assert sorted((r["source"], r["page"] or "", r["reason"]) for r in bad.collect()) == [
        ("gone", "", "no such path"), ("l", "", "no object"), ("l", "1", "no number or text"), ("l", "1", "no number or text"), ("l", "3", "not of this shape"), ("n", "k", "no number or text"),
        ("p", "5", "not of this shape"), ("p", "6", "not of this shape"),
    ]
    assert {tuple(r) for r in notes.summary(good, bad).collect()} == {("l", 1, 1, 4), ("p", 1, 1, 2), ("n", 1, 2, 1), ("gone", 0, 0, 1)}
    assert [x.count() for x in notes.load(spark, {})] == [0, 0]


def test_a_note_does_not_carry_its_file_or_entry(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"a": [{"original_number": "1", "content": "x"}, {"original_number": "2", "content": "y"}], "b": null}')
    good, bad = notes.load(spark, {"l": (str(tmp_path / "n.json"), "lists")})
    plan = good._jdf.queryExecution().executedPlan().toString()
    carried = [re.search(r"explode.*?\), (?:\[(.*?)\], )?(?:true|false)", x).group(1) or "" for x in plan.splitlines() if "Generate explode" in x]
    assert carried and not any(c.split("#")[0].strip() in ("value", "entry") for x in carried for c in x.split(","))
    assert good.count() == 2 and [(r["page"], r["reason"], r["record"][:1]) for r in bad.collect()] == [("b", "not of this shape", "{")]


def test_bad_records_are_a_second_output(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"a": 1}\n{"a": "no"}\nnothing\n{"a": 2}\n')
    rows, bad = notes.read_with_rejects(spark, str(tmp_path / "r.json"), T.StructType.fromDDL("a int"), multiLine="false")
    assert sorted(r["a"] for r in rows.collect()) == [1, 2] and sorted(r["record"] for r in bad.collect()) == ["nothing", '{"a": "no"}']
