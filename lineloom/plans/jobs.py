"""Queries over offline jobs: canons from files to published maps, and loaded notes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lineloom.plans import canons
from lineloom.plans.registry import query, table
from lineloom.sources import notes, published, scratch

_BOOKS = {"MAT": "matthew", "MRK": "mark", "LUK": "luke", "JHN": "john"}
_ROMANS = "['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII']"
_MAP = "'{' || string_agg('\"' || {k} || '\":\"' || {v} || '\"', ',' ORDER BY {k} COLLATE \"C\") || '}'"


@query(
    f"""WITH s AS (SELECT ['matthew', 'mark', 'luke', 'john'][p_partkey % 4 + 1] AS book, p_partkey // 4 AS section, p_size % 28 + 1 AS a, p_partkey % 30 + 1 AS b FROM part),
r AS (SELECT *, CASE WHEN b % 11 = 0 THEN 'none' ELSE a || '.' || b || CASE WHEN b % 3 = 0 THEN 'B' ELSE '' END || CASE WHEN b % 2 = 0 THEN '-' || (b + 3) || 'A' ELSE '' END END AS reference FROM s),
c AS (SELECT c_custkey % 13 + 1 AS canon, row_number() OVER (PARTITION BY c_custkey % 13 ORDER BY c_custkey) AS rowid, unnest(range(4)) AS i, c_custkey AS k FROM customer),
e AS (SELECT canon, rowid, {_ROMANS}[canon] || '.' || rowid AS key, ['matthew', 'mark', 'luke', 'john'][i + 1] AS book, (k + i) % 50 AS section FROM c WHERE (canon + i) % 3 > 0),
j AS (SELECT e.*, reference, CASE WHEN b % 11 > 0 THEN a || ':' || b END AS verse FROM e JOIN r USING (book, section)),
v AS (SELECT book, verse, arg_max(key, (canon, rowid)) AS key FROM j WHERE verse IS NOT NULL GROUP BY ALL),
n AS (SELECT canon, count(*) AS n FROM j GROUP BY canon)
SELECT 'lookup' AS sink, key AS name, {_MAP.replace('{k}', 'book').replace('{v}', 'reference')} AS json FROM j GROUP BY key
UNION ALL SELECT 'verses', book, {_MAP.replace('{k}', 'verse').replace('{v}', 'key')} FROM v GROUP BY book
UNION ALL SELECT 'canon', canon::VARCHAR, count(*) || ' ' || sum(section) || ' ' || max(reference COLLATE "C") FROM j GROUP BY canon
UNION ALL SELECT 'counts', 'all', '{{"groups":' || count(*) || ',"total":' || sum(n) || ',"items":[' || string_agg('{{"name":"' || canon || '","rows":' || n || '}}', ',' ORDER BY canon::VARCHAR COLLATE "C") || ']}}' FROM n"""
)
def canon_pipeline(spark, sf_dir):
    """Q7: S8, S9, E1, J1, F1, F3, A4, K1, K2, K5, K7, U7. Customers as rows of 13 files, parts as sections; run twice, read as published."""
    k = F.col("c_custkey")
    canon = (k % 13 + 1).cast("int")
    cells = [F.when((canon + i) % 3 > 0, ((k + i) % 50).cast("string")).otherwise("") for i in range(4)]
    files = table(spark, sf_dir, "customer").select(canon.alias("canon"), k, F.concat_ws("\t", *cells).alias("value"))
    heads = files.select("canon").distinct().select("canon", F.lit(None).cast("long").alias("c_custkey"), F.lit("\t".join(_BOOKS)).alias("value"))
    path, root = scratch.folder(spark, "canons"), scratch.folder(spark, "published")
    files.unionByName(heads).repartition("canon").sortWithinPartitions("canon", "c_custkey").select("canon", "value").write.partitionBy("canon").text(path)
    p, a, b = F.col("p_partkey"), F.col("p_size") % 28 + 1, F.col("p_partkey") % 30 + 1
    text = F.concat(a.cast("string"), F.lit("."), b.cast("string"), F.when(b % 3 == 0, "B").otherwise(""), F.when(b % 2 == 0, F.concat(F.lit("-"), (b + 3).cast("string"), F.lit("A"))).otherwise(""))
    book = F.get(F.array(*map(F.lit, _BOOKS.values())), (p % 4).cast("int"))
    sections = table(spark, sf_dir, "part").select(book.alias("book"), F.floor(p / 4).cast("int").alias("section"), F.when(b % 11 == 0, "none").otherwise(text).alias("reference"))
    read = canons.read_canons(spark, f"{path}/*", _BOOKS)
    canons.run(spark, root, read.where("canon < 3"), sections, _BOOKS)
    canons.run(spark, root, read, sections, _BOOKS)  # takes the place of the first
    out = lambda name, schema: published.published(spark, root, name, schema)
    rows = out("canons", "canon int, rowid long, book string, section int, reference string").groupBy("canon").agg(F.concat_ws(" ", F.count("*").cast("string"), F.sum("section").cast("string"), F.max("reference")).alias("json"))
    parts = [
        out("canon_lookup", "key string, json string").select(F.lit("lookup").alias("sink"), F.col("key").alias("name"), "json"),
        out("verse_to_canon", "book string, json string").select(F.lit("verses").alias("sink"), F.col("book").alias("name"), "json"),
        rows.select(F.lit("canon").alias("sink"), F.col("canon").cast("string").alias("name"), "json"),
        out("counts", "json string").select(F.lit("counts").alias("sink"), F.lit("all").alias("name"), "json"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier),
good AS (
  SELECT 'lists' AS source, s_nationkey::VARCHAR AS page, s_suppkey::VARCHAR AS original, i AS display, s_name AS content FROM s WHERE s_suppkey % 5 > 0
  UNION ALL SELECT 'pages', s_nationkey::VARCHAR, s_suppkey::VARCHAR, i, s_name || ' "q"' FROM s WHERE s_nationkey % 4 > 0
  UNION ALL SELECT 'named', s_nationkey::VARCHAR, s_suppkey::VARCHAR, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), s_name FROM s),
bad AS (
  SELECT 'lists' AS source, s_nationkey::VARCHAR AS page, 'no number or text' AS reason FROM s WHERE s_suppkey % 5 = 0
  UNION ALL SELECT DISTINCT 'pages', s_nationkey::VARCHAR, 'not of this shape' FROM s WHERE s_nationkey % 4 = 0
  UNION ALL SELECT 'gone', NULL, 'no such path')
SELECT source, page, original, display::INT AS display, content, NULL AS reason FROM good UNION ALL SELECT source, page, NULL, NULL, NULL, reason FROM bad"""
)
def note_loader(spark, sf_dir):
    """Suppliers as notes in three shapes, some without a text, some under another shape, and a path that doesn't exist."""
    s, page = table(spark, sf_dir, "supplier"), F.col("s_nationkey").cast("string")
    order = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("i")
    rows = s.select(page.alias("page"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), order)
    number = F.col("k").cast("string").alias("original_number")
    listed = rows.groupBy("page").agg(F.collect_list(F.struct(number, F.col("i").alias("display_number"), F.when(F.col("k") % 5 > 0, F.col("name")).alias("content"))).alias("v"))
    paged = rows.groupBy("page").agg(F.collect_list(F.struct(number, F.col("i").alias("display_number"), F.concat("name", F.lit(' "q"')).alias("content"))).alias("v"))
    inner = F.when(F.col("page").cast("int") % 4 > 0, F.to_json(F.struct(F.lit("X").alias("roman_numeral"), F.col("v").alias("footnotes")))).otherwise('["else"]')
    listed, paged = (df.withColumn("part", F.col("page")) for df in (listed, paged))  # one file for each nation, and for each 10,000 named notes
    named = rows.select(F.floor(F.col("k") / 10_000).alias("part"), F.concat(F.lit("note_"), F.col("k").cast("string")).alias("page"), F.to_json(F.struct(F.concat(F.lit("sermons_"), "page").alias("file"), F.col("k").alias("number"), F.col("name").alias("text"))).alias("v"))
    whole = lambda df, value: df.select(F.concat(F.lit('"'), "page", F.lit('":'), value).alias("e"), "part").groupBy("part").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("e")), ","), F.lit("}")).alias("value"))
    root = scratch.folder(spark, "notes")
    for name, df in (("lists", whole(listed, F.to_json("v"))), ("pages", whole(paged, inner)), ("named", whole(named, F.col("v")))):
        df.write.partitionBy("part").text(f"{root}/{name}")
    good, bad = notes.load(spark, {n: (f"{root}/{n}", n) for n in ("lists", "pages", "named")} | {"gone": (f"{root}/gone", "lists")}, r"_(\d+)$")
    none = F.lit(None)
    return good.withColumn("reason", none.cast("string")).unionByName(bad.select("source", "page", none.cast("string").alias("original"), none.cast("int").alias("display"), none.cast("string").alias("content"), "reason"))
