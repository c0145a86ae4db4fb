"""Queries over ordered events, nested elements, row numbers and files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lineloom.operators import automaton, numbering
from lineloom.plans.registry import CLEAN_SQL, LINES_SQL, SPACED_SQL, query, table
from lineloom.sources import elements, readers, scratch

_VOID = ", ".join(f"'{v}'" for v in elements.VOID)


@query(
    f"""WITH RECURSIVE x AS (SELECT page_id, unnest(regexp_extract_all({CLEAN_SQL}, '<[^>]+>|[^<]+')) AS content, generate_subscripts(regexp_extract_all({CLEAN_SQL}, '<[^>]+>|[^<]+'), 1) - 1 AS pos FROM pages),
n AS (SELECT *, content[1:1] = '<' AS tag, CASE WHEN content[1:1] = '<' THEN lower(regexp_extract(content, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) ELSE '' END AS name FROM x),
k AS (SELECT page_id, pos, name, content, CASE WHEN NOT tag THEN 'text' WHEN content[2:2] = '/' THEN 'end' WHEN name IN ({_VOID}) OR content[-2:] = '/>' THEN 'empty' ELSE 'start' END AS kind FROM n WHERE NOT tag OR name <> ''),
e AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i FROM k),
r AS (SELECT page_id, 0::BIGINT AS i, 'outside' AS state, 0 AS open, 0 AS depth FROM (SELECT DISTINCT page_id FROM e) UNION ALL
  SELECT e.page_id, e.i, CASE WHEN kind = 'start' AND name = 'article' AND state = 'outside' THEN 'inside' WHEN kind = 'end' AND name = 'article' THEN 'outside'
    WHEN kind = 'start' AND name = 'b' AND state = 'inside' THEN 'note' WHEN kind = 'start' AND name = 'p' AND state = 'note' THEN 'inside' ELSE state END,
    open + CASE kind WHEN 'start' THEN 1 WHEN 'end' THEN -1 ELSE 0 END, open + CASE WHEN kind IN ('start', 'empty') THEN 1 ELSE 0 END FROM r JOIN e ON e.page_id = r.page_id AND e.i = r.i + 1)
SELECT page_id, pos::INT AS pos, kind, name, content, depth::INT AS depth, state FROM e JOIN r USING (page_id, i)"""
)
def markup_events(spark, sf_dir):
    """Every event with its depth, and the state of a machine that tells an article's text and its bold notes, which end with the paragraph."""
    rows = elements.events(table(spark, sf_dir, "pages"), ["page_id"], "html")
    on = lambda kind, name: (F.col("kind") == kind) & (F.col("name") == name)
    rules = [
        (on("start", "article"), {"outside": "inside"}),
        (on("end", "article"), {"inside": "outside", "note": "outside"}),
        (on("start", "b"), {"inside": "note"}),
        (on("start", "p"), {"note": "inside"}),
    ]
    out = automaton.run(rows, ["page_id"], "pos", ["outside", "inside", "note"], rules, "outside")
    return out.select("page_id", "pos", "kind", "name", "content", "depth", "state")


_NESTED = ("nav", "ul", "li", "a", "article", "h1", "footer", "div")
_BODIES = "regexp_extract_all(h, '(?is)<{0}(?:\\s[^>]*)?>(.*?)</{0}>', 1)"
_EACH = " UNION ALL ".join(f"SELECT page_id, '{n}' AS name, unnest({_BODIES.format(n)}) AS x, generate_subscripts({_BODIES.format(n)}, 1) AS ordinal FROM c" for n in _NESTED)
_DECODED = "replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&quot;', '\"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(f"WITH c AS (SELECT page_id, {CLEAN_SQL} AS h FROM pages) SELECT page_id, name, ordinal::INT AS ordinal, {SPACED_SQL.format(_DECODED)} AS content FROM ({_EACH})")
def nested_elements(spark, sf_dir):
    """Elements inside each other, each with its whole text."""
    found = elements.element_texts(table(spark, sf_dir, "pages"), ["page_id"], "html", _NESTED)
    ordinal = F.row_number().over(Window.partitionBy("page_id", "name").orderBy("pos"))
    return found.select("page_id", "name", ordinal.alias("ordinal"), "content")


@query(f"SELECT doc_id, line_no::BIGINT AS line_no, row_number() OVER (ORDER BY doc_id, line_no) AS number, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS of_source FROM ({LINES_SQL.replace('SELECT doc_id', 'SELECT doc_id, source')})")
def running_counter(spark, sf_dir):
    """One counter over the lines of all documents, and one for each source."""
    rows = readers.lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("line")
    rows = numbering.numbered(rows, ["doc_id", "line_no"], "number", ranges=16)
    rows = numbering.numbered(rows, ["doc_id", "line_no"], "of_source", by=["source"], ranges=16)
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "number", "of_source")


@query(
    """WITH o AS (SELECT o_orderkey % 16 AS bucket, o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderkey % 16 ORDER BY o_orderkey) AS rowid FROM orders)
SELECT bucket::INT AS bucket, rowid, o_orderkey AS id, CASE WHEN o_custkey % 5 > 0 THEN o_custkey END::INT AS customer, o_orderstatus AS status, NULL::DOUBLE AS missing FROM o WHERE o_orderkey % 7 > 0"""
)
def tsv_rows(spark, sf_dir):
    """All orders as files with a header line and blank lines, read in splits; numbers that are none and fields that are missing are null."""
    customer = F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey").cast("string")).otherwise("n/a")
    line = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat_ws("\t", F.col("o_orderkey").cast("string"), customer, "o_orderstatus"))
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 16).alias("bucket"), "o_orderkey", line.alias("value"))
    heads = rows.select("bucket").distinct().select("bucket", F.lit(None).cast("long").alias("o_orderkey"), F.lit("id\tcustomer\tstatus").alias("value"))
    path = scratch.folder(spark, "tsv")
    rows.unionByName(heads).repartition("bucket").sortWithinPartitions("bucket", "o_orderkey").select("bucket", "value").write.partitionBy("bucket").text(path)
    read = readers.tsv(spark, f"{path}/*", "id long, customer int, status string, missing double", skip=1, file="file")
    bucket = F.regexp_extract("file", "bucket=([0-9]+)/", 1).cast("int")
    return read.select(bucket.alias("bucket"), "rowid", "id", "customer", "status", "missing")
