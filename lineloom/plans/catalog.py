"""Every operator applied to the driver's tables, each with the SQL that gives the same rows.

``QUERIES`` and ``ORACLE_SQL`` have the same keys but for queries that SQL can't express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.functions import editions, markup, numerals, refs
from lineloom.operators import grouping, intervals, lookup, reshape, runs
from lineloom.plans import crossref, jobs, search, served, structure  # noqa: F401
from lineloom.plans.registry import CLEAN_SQL as _CLEAN
from lineloom.plans.registry import LINES_SQL as _LINES
from lineloom.plans.registry import ORACLE_SQL, QUERIES, query, table  # noqa: F401
from lineloom.plans.registry import SPACED_SQL as _SPACED
from lineloom.sources import readers, writers

TERM = "the"


# --- lines and search ---------------------------------------------------------------------------------------------

@query(f"SELECT doc_id, line_no::BIGINT AS line_no, length(line)::BIGINT AS n_chars, line FROM ({_LINES})")
def line_explode(spark, sf_dir):
    """S1, E4"""
    out = readers.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n_chars"), "line")


_FOUND = f"SELECT doc_id, line_no, split_part(line, ' ', 1) AS ref, substr(line, strpos(line, ' ') + 1) AS t FROM ({_LINES}) WHERE contains(lower(line), '{TERM}') AND contains(line, ' ')"


@query(f"SELECT doc_id, line_no::BIGINT AS line_no, ref, CASE WHEN strlen(s) > 200 THEN left(s, list_max(list_filter(range(0, 201), lambda k: strlen(left(s, k)) <= 200))) || '...' ELSE s END AS snippet FROM (SELECT doc_id, line_no, ref, regexp_replace(t, '(?i){TERM}', '<mark>\\0</mark>', 'g') AS s FROM ({_FOUND}) ORDER BY doc_id, line_no LIMIT 20)")
def keyword_search_top20(spark, sf_dir):
    """Q1: P5, P2, T1, G1, G2"""
    out = search.search(table(spark, sf_dir, "documents"), TERM, ["doc_id"])
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "ref", "snippet")


@query(f"SELECT count(*) AS n, least(count(*), 20) AS shown, count(*) >= 20 AS first_only FROM ({_FOUND})")
def search_result_count(spark, sf_dir):
    """A14, T2"""
    return search.result_count(table(spark, sf_dir, "documents"), TERM)


@query("SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(source || ' <' || text || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;'), '(?i)th', '<mark>\\0</mark>', 'g') AS html FROM documents")
def search_highlight(spark, sf_dir):
    """G1, G3"""
    text = F.concat("source", F.lit(" <"), "text", F.lit(">"))
    return table(spark, sf_dir, "documents").select("doc_id", markup.highlight(markup.escape_html(text), "th").alias("html"))


@query(
    "SELECT item_id, CASE WHEN strlen(a) > 50 THEN left(a, 50) || '...' ELSE a END AS cut, strlen(text)::BIGINT AS n_bytes"
    " FROM (SELECT item_id, text, regexp_replace(text, '[^ -~]', '', 'g') AS a FROM benchmark)"
)
def search_truncate_bytes(spark, sf_dir):
    """G2 on ASCII text; tests hold cuts inside characters."""
    ascii_ = F.regexp_replace("text", "[^ -~]", "")
    return table(spark, sf_dir, "benchmark").select("item_id", markup.cut_bytes(ascii_, 50).alias("cut"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(
    "SELECT doc_id, count(*) AS n_lines, count(v)::BIGINT AS n_verses, coalesce(sum(v), 0)::BIGINT AS sum_verses, max(t) AS last_text FROM"
    " (SELECT doc_id, try_cast(regexp_extract(l, '^[^:]*:([^ ]*) (.*)$', 1) AS INT) AS v, regexp_extract(l, '^[^:]*:([^ ]*) (.*)$', 2) AS t FROM"
    f" (SELECT doc_id, CASE WHEN line_no % 3 = 0 THEN 'x:y' ELSE '1:' || line_no END || ' ' || line AS l FROM ({_LINES})) WHERE regexp_matches(l, '^[^:]*:([^ ]*) (.*)$')) WHERE v IS NOT NULL GROUP BY doc_id"
)
def verse_parse(spark, sf_dir):
    """Every third line has a reference that is no number."""
    rows = readers.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ref = F.when(F.col("line_no") % 3 == 0, "x:y").otherwise(F.concat(F.lit("1:"), F.col("line_no").cast("string")))
    parsed = readers.verse_lines(rows.withColumn("line", F.concat(ref, F.lit(" "), "line")))
    return parsed.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("verse").alias("n_verses"), F.sum("verse").cast("long").alias("sum_verses"), F.max("text").alias("last_text"))


# --- numerals, references, labels ---------------------------------------------------------------------------------

_ROMAN_SQL = (
    "repeat('M', n // 1000) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][(n // 100) % 10 + 1]"
    " || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][(n // 10) % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1]"
)
_VALUE_SQL = "CASE upper(substr(s, {0}::BIGINT, 1)) WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END"
_SYMBOLS_SQL = "list_sum(list_transform(regexp_extract_all(upper(s), 'CM|CD|XC|XL|IX|IV|[MDCLXVI]'), lambda x: map {'CM': 900, 'CD': 400, 'XC': 90, 'XL': 40, 'IX': 9, 'IV': 4, 'M': 1000, 'D': 500, 'C': 100, 'L': 50, 'X': 10, 'V': 5, 'I': 1}[x]))"
_SYMBOLS_SQL = f"coalesce({_SYMBOLS_SQL}, 0)::BIGINT"
_DECODE_SQL = f"coalesce(list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN ({_VALUE_SQL.format('i')}) < ({_VALUE_SQL.format('(i + 1)')}) THEN -({_VALUE_SQL.format('i')}) ELSE ({_VALUE_SQL.format('i')}) END)), 0)::BIGINT"


@query(f"SELECT o_orderkey, CASE WHEN n > 0 THEN {_ROMAN_SQL} ELSE '' END AS roman FROM (SELECT o_orderkey, o_orderkey % 4000 AS n FROM orders)")
def roman_encode(spark, sf_dir):
    """F7"""
    return table(spark, sf_dir, "orders").select("o_orderkey", numerals.to_roman(F.col("o_orderkey") % 4000).alias("roman"))


@query(f"SELECT s AS name, {_DECODE_SQL} AS lenient, CASE WHEN regexp_matches(upper(s), '^[IVXLCDM]+$') THEN {_DECODE_SQL} END AS strict, {_SYMBOLS_SQL} AS by_symbols FROM (SELECT c_name AS s FROM customer UNION ALL SELECT {_ROMAN_SQL} FROM (SELECT c_custkey % 4000 AS n FROM customer))")
def roman_decode(spark, sf_dir):
    """F8, T7"""
    c = table(spark, sf_dir, "customer")
    s = c.select(F.col("c_name").alias("name")).unionAll(c.select(numerals.to_roman(F.col("c_custkey") % 4000)))
    return s.select("name", numerals.from_roman(F.col("name")).cast("long").alias("lenient"), numerals.from_roman(F.col("name"), strict=True).cast("long").alias("strict"), numerals.from_roman_symbols(F.col("name")).cast("long").alias("by_symbols"))


_REF = "(l_orderkey % 28 + 1)::VARCHAR || '.' || l_linenumber || CASE l_linenumber % 3 WHEN 0 THEN 'B' ELSE '' END || CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-' || (l_linenumber + 2) WHEN 2 THEN '-' || (l_orderkey % 28 + 2) || '.' || l_linenumber || 'A' ELSE ' (in note)' END"


def _line_refs(spark, sf_dir):
    major, minor = (F.col("l_orderkey") % 28 + 1), F.col("l_linenumber")
    end = F.when(F.col("l_partkey") % 4 == 0, "").when(F.col("l_partkey") % 4 == 1, F.concat(F.lit("-"), (minor + 2).cast("string"))).when(F.col("l_partkey") % 4 == 2, F.concat(F.lit("-"), (major + 1).cast("string"), F.lit("."), minor.cast("string"), F.lit("A"))).otherwise(" (in note)")
    ref = F.concat(major.cast("string"), F.lit("."), minor.cast("string"), F.when(minor % 3 == 0, "B").otherwise(""), end)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ref.alias("ref"))


@query(
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, {_REF} AS ref FROM lineitem), p AS (
  SELECT *, string_split(regexp_replace(string_split(ref, '-')[1], '[A-Z]+$', ''), '.') AS a, string_split(regexp_replace(string_split(ref, '-')[2], '[A-Z]+$', ''), '.') AS b, len(string_split(ref, '-')) AS n FROM r
), v AS (
  SELECT *, CASE WHEN regexp_matches(a[1], '^[+-]?[0-9]+$') THEN a[1]::INT END AS sc, CASE WHEN regexp_matches(a[2], '^[+-]?[0-9]+$') THEN a[2]::INT END AS sv,
         CASE WHEN n < 2 THEN a[1] WHEN len(b) = 2 THEN b[1] ELSE a[1] END AS ect, CASE WHEN n < 2 THEN a[2] WHEN len(b) = 2 THEN b[2] ELSE b[1] END AS evt FROM p
), w AS (
  SELECT *, CASE WHEN regexp_matches(ect, '^[+-]?[0-9]+$') THEN ect::INT END AS ec, CASE WHEN regexp_matches(evt, '^[+-]?[0-9]+$') THEN evt::INT END AS ev FROM v
), g AS (SELECT *, len(a) = 2 AND sc IS NOT NULL AND sv IS NOT NULL AND ec IS NOT NULL AND ev IS NOT NULL AS ok FROM w)
SELECT l_orderkey, l_linenumber, ref, CASE WHEN ok THEN sc END AS sc, CASE WHEN ok THEN sv END AS sv, CASE WHEN ok THEN ec END AS ec, CASE WHEN ok THEN ev END AS ev,
       CASE WHEN len(a) = 2 THEN a[1] || ':' || a[2] END AS start_key,
       CASE WHEN ok THEN CASE WHEN sc <> ec THEN sc || ':' || sv || '-' || ec || ':' || ev WHEN sv <> ev THEN sc || ':' || sv || '-' || ev ELSE sc || ':' || sv END END AS label,
       CASE WHEN ok THEN sc || ':' || sv || '-' || ec || ':' || ev END AS raw_label, len(string_split(ref, '.')) = 2 AS one_chapter, CASE WHEN ok THEN CASE WHEN sc >= 100 THEN sc::VARCHAR ELSE lpad(sc::VARCHAR, 2, '0') END END AS padded
FROM g"""
)
def ref_parse(spark, sf_dir):
    """F1-F3, F9-F11"""
    r = _line_refs(spark, sf_dir).withColumn("r", refs.parse_range(F.col("ref")))
    four = [F.col(f"r.{c}") for c in ("sc", "sv", "ec", "ev")]
    label = F.when(F.col("r").isNotNull(), refs.range_label(*four))
    return r.select("l_orderkey", "l_linenumber", "ref", *four, refs.start_key(F.col("ref")).alias("start_key"), label.alias("label"), refs.raw_label(*four).alias("raw_label"), refs.one_chapter(F.col("ref")).alias("one_chapter"), refs.padded(F.col("r.sc")).alias("padded"))


@query(
    """SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^Brand#([1-2])([0-9])$') THEN regexp_extract(p_brand, '^Brand#([1-2])([0-9])$', 1)::INT
       WHEN regexp_matches(p_brand, '#(\\d)(\\d)') AND p_size > 20 THEN regexp_extract(p_brand, '#(\\d)(\\d)', 1)::INT ELSE 1 END AS chapter,
       CASE WHEN regexp_matches(p_brand, '^Brand#([1-2])([0-9])$') THEN regexp_extract(p_brand, '^Brand#([1-2])([0-9])$', 2)::INT
       WHEN regexp_matches(p_brand, '#(\\d)(\\d)') AND p_size > 20 THEN regexp_extract(p_brand, '#(\\d)(\\d)', 2)::INT ELSE 1 END AS first,
       CASE WHEN regexp_matches(p_brand, '^Brand#([1-2])([0-9])$') THEN regexp_extract(p_brand, '^Brand#([1-2])([0-9])$', 2)::INT
       WHEN regexp_matches(p_brand, '#(\\d)(\\d)') AND p_size > 20 THEN p_size ELSE 1 END AS last FROM part"""
)
def fallback_parse(spark, sf_dir):
    """the first pattern that matches, then a default of (1, 1, 1)."""
    s = F.concat("p_brand", F.when(F.col("p_size") > 20, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise("x"))
    first = r"^Brand#([1-2])([0-9])(?:x|-\d+)$"
    got = refs.first_match(s, [(first, (1, 2, None)), (r"#(\d)(\d)-(\d+)$", (1, 2, 3))], (1, 1, 1))
    return table(spark, sf_dir, "part").select("p_partkey", got.alias("g")).select("p_partkey", "g.chapter", "g.first", "g.last")


_PASSAGE = "CASE l_linenumber % 5 WHEN 0 THEN (l_orderkey % 21 + 1)::VARCHAR WHEN 1 THEN (l_orderkey % 21 + 1) || '.' || l_linenumber || '-' || (l_linenumber + 3) WHEN 2 THEN (l_orderkey % 21 + 1) || '.' || l_linenumber || '; ' || (l_orderkey % 21 + 2) || '.1' WHEN 3 THEN (l_orderkey % 21 + 1) || '.' || l_linenumber || ',' || (l_linenumber + 1) ELSE 'Preface' END"


@query(
    f"""SELECT l_orderkey, l_linenumber, passage, CASE k WHEN 4 THEN NULL ELSE c END::INT AS chapter, CASE k WHEN 4 THEN NULL WHEN 0 THEN 1 ELSE l_linenumber END::INT AS first,
       CASE k WHEN 4 THEN NULL WHEN 0 THEN 1 WHEN 1 THEN l_linenumber + 3 WHEN 3 THEN l_linenumber + 1 ELSE l_linenumber END::INT AS last,
       (c || ':' || l_linenumber || '-' || (c + 1) || ':' || l_linenumber) AS colon_label, (l_linenumber + 1)::VARCHAR AS last_part
       FROM (SELECT l_orderkey, l_linenumber, l_linenumber % 5 AS k, l_orderkey % 21 + 1 AS c, {_PASSAGE} AS passage FROM lineitem)"""
)
def passage_parse(spark, sf_dir):
    """F5, F6, F18"""
    d = table(spark, sf_dir, "lineitem")
    c, v = (F.col("l_orderkey") % 21 + 1), F.col("l_linenumber")
    t = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    passage = F.when(v % 5 == 0, t(c)).when(v % 5 == 1, t(c, ".", v, "-", v + 3)).when(v % 5 == 2, t(c, ".", v, "; ", c + 1, ".1")).when(v % 5 == 3, t(c, ".", v, ",", v + 1)).otherwise("Preface")
    colon = refs.parse_colon_range(t(c, ": ", v, " - ", c + 1, ":", v))
    d = d.select("l_orderkey", "l_linenumber", passage.alias("passage"), colon.alias("r"), refs.last_in_list(t(v, ", ", v + 1)).alias("last_part")).withColumn("p", refs.parse_passage(F.col("passage")))
    return d.select("l_orderkey", "l_linenumber", "passage", "p.chapter", "p.first", "p.last", refs.range_label(F.col("r.sc"), F.col("r.sv"), F.col("r.ec"), F.col("r.ev")).alias("colon_label"), "last_part")


@query("SELECT n_nationkey, 'au' || n_nationkey || '-' || lower(n_name) AS key, 'Au, Homily ' || n_nationkey || ' on ' || n_name || ' (1:' || n_nationkey || ')' AS sentence, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS ref, CASE WHEN NOT contains(n_name, '-') THEN lower(n_name) END AS book FROM nation")
def composite_keys(spark, sf_dir):
    """F13, F15, F16, P13"""
    n = table(spark, sf_dir, "nation")
    number = F.col("n_nationkey").cast("string")
    key = refs.composite_key(F.concat(F.lit("au"), number), F.lower("n_name"))
    sentence = markup.attribution(F.initcap(F.lit("au")), F.lit("Homily"), number, F.col("n_name"), F.concat(F.lit("1:"), number))
    ref = markup.blank_reference(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("Homily "), "n_name")).otherwise(F.col("n_name")))
    return n.select("n_nationkey", key.alias("key"), sentence.alias("sentence"), ref.alias("ref"), refs.split_key(key)["second"].alias("book"))


@query(
    """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN nullif(n_nationkey, 0) WHEN n_nationkey % 3 = 1 THEN CASE WHEN n_nationkey >= 5 THEN n_nationkey - 3 WHEN n_nationkey = 4 THEN 1 END ELSE n_nationkey END::INT AS number,
       CASE n_name WHEN 'FRANCE' THEN 'Fr' WHEN 'CHINA' THEN 'Cn' ELSE n_name END AS short, CASE WHEN n_nationkey BETWEEN 1 AND 7 THEN 1 END::INT AS bucket FROM nation"""
)
def node_numbers(spark, sf_dir):
    """F12, F17, P17, R8"""
    k = F.col("n_nationkey")
    r = numerals.to_roman(k)
    attribute, node_id, text = F.when(k % 3 == 0, r), F.when(k % 3 == 1, F.concat(F.lit("iii."), F.lower(r))).otherwise("x.y1"), F.concat(F.lit("HOMILY "), r, F.lit(". On"))
    text = F.when(k % 3 == 2, text).otherwise("none")
    bucket = refs.file_bucket(F.lit("sermons_01_11.htm"), k, 7)
    return table(spark, sf_dir, "nation").select("n_nationkey", refs.node_number(attribute, node_id, text).alias("number"), refs.abbreviation(F.col("n_name"), {"FRANCE": "Fr", "CHINA": "Cn"}).alias("short"), bucket.alias("bucket"))


@query(
    """SELECT c_custkey, 'ref' || CASE WHEN c_custkey % 2 = 0 THEN ' cross-ref' ELSE '' END || CASE WHEN c_acctbal < 0 THEN ' second' ELSE '' END AS css,
       'A, ' || CASE WHEN c_acctbal < 0 THEN 'Sermon ' ELSE 'Homily ' END || c_custkey || ' on ' || c_mktsegment || ' (' || CASE WHEN c_custkey % 2 = 0 THEN '2:2' ELSE '1:1' END || ')' AS tooltip FROM customer"""
)
def reference_boxes(spark, sf_dir):
    """F16, F19, R3"""
    k = F.col("c_custkey")
    box = markup.reference_box(F.when(F.col("c_acctbal") < 0, -k).otherwise(k), k % 2 == 0, F.lit("A"), F.col("c_mktsegment"), F.lit("1:1"), F.lit("2:2"))
    return table(spark, sf_dir, "customer").select("c_custkey", box.alias("b")).select("c_custkey", "b.css", "b.tooltip")


@query("SELECT n_nationkey, coalesce(string_agg(s_name, '|' ORDER BY s_suppkey), '') AS names, count(s_name) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey")
def list_or_empty(spark, sf_dir):
    """J3, J11"""
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    out = lookup.list_or_empty(table(spark, sf_dir, "nation"), s, "n_nationkey", "s_name", "s_suppkey", "names")
    return out.select("n_nationkey", F.array_join("names", "|").alias("names"), F.size("names").cast("long").alias("n"))


# --- unions, unpivots, precedence -------------------------------------------------------------------------------


@query("SELECT 1 AS tag, r_regionkey AS key, r_name AS name, NULL::INT AS parent, NULL::DOUBLE AS amount FROM region UNION ALL SELECT 2, n_nationkey, n_name, n_regionkey, NULL FROM nation UNION ALL SELECT 3, s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def padded_union(spark, sf_dir):
    """U1, U2"""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("parent"), F.col("s_acctbal").alias("amount"))
    return reshape.tagged_union({1: r, 2: n, 3: s}, "tag").select("tag", "key", "name", "parent", "amount")


@query(
    """WITH wide AS (SELECT l_orderkey, l_linenumber, l_partkey AS part, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS supplier FROM lineitem),
long AS (SELECT l_orderkey, l_linenumber, 'part' AS kind, part AS no FROM wide WHERE part IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, 'supplier', supplier FROM wide WHERE supplier IS NOT NULL),
names AS (SELECT 'part' AS kind, p_partkey AS no, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier)
SELECT l_orderkey, l_linenumber, kind, no, name FROM long JOIN names USING (kind, no)"""
)
def unpivot_lookup(spark, sf_dir):
    """E1, J1"""
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("supplier"))
    cells = reshape.long_form(wide, ["l_orderkey", "l_linenumber"], ["part", "supplier"], "kind", "no")
    parts = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("no"), F.col("p_name").alias("name"))
    suppliers = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("no"), F.col("s_name").alias("name"))
    return cells.join(parts.unionByName(suppliers), ["kind", "no"]).select("l_orderkey", "l_linenumber", "kind", "no", "name")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY user_id, event_type")
def last_wins(spark, sf_dir):
    """A4-A6"""
    out = grouping.last_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])
    return out.withColumn("value", F.round("value", 6))


_NOTE = "CASE WHEN doc_id % 10 = 0 THEN '' ELSE md5(text) END"


@query(f"SELECT doc_id, note, source FROM (SELECT *, row_number() OVER (PARTITION BY note ORDER BY doc_id) AS n FROM (SELECT doc_id, {_NOTE} AS note, source FROM documents)) WHERE n = 1 OR note = ''")
def first_wins_dedup(spark, sf_dir):
    """One row of each text; empty keys are never deduplicated."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.md5(F.col("text").cast("binary"))).alias("note"), "source")
    return grouping.first_wins(d, "note", ["doc_id"])


@query(
    "SELECT k, source_no, name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source_no, name) AS n FROM (SELECT c_nationkey AS k, c_name AS name, 0 AS source_no FROM customer WHERE c_acctbal > 9000"
    " UNION ALL SELECT s_nationkey, s_name, 1 FROM supplier UNION ALL SELECT n_nationkey, n_name, 2 FROM nation)) WHERE n = 1"
)
def priority_union(spark, sf_dir):
    """U4, P15"""
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return grouping.by_priority([a, b, c], ["k"], ["name"]).select("k", "source_no", "name")


@query("SELECT DISTINCT l_suppkey AS id FROM lineitem UNION SELECT s_suppkey FROM supplier")
def distinct_ids(spark, sf_dir):
    """U3, U5"""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"))
    return a.unionAll(table(spark, sf_dir, "supplier").select("s_suppkey")).distinct()


# --- groups -------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, count(*) AS n, string_agg(o_orderkey || o_orderstatus, '; ' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def group_sorted_list(spark, sf_dir):
    """Lists of structs, sorted."""
    lists = grouping.grouped(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    keys = F.transform("items", lambda x: F.concat(x["o_orderkey"].cast("string"), x["o_orderstatus"]))
    return lists.select("o_custkey", F.size("items").cast("long").alias("n"), F.array_join(keys, "; ").alias("orders"))


@query(f"SELECT l_orderkey, count(*) AS n, string_agg({_ROMAN_SQL}, ', ' ORDER BY n) AS romans FROM (SELECT l_orderkey, l_linenumber AS n FROM lineitem) GROUP BY l_orderkey HAVING count(*) > 1")
def having_multi(spark, sf_dir):
    """A9, A13"""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numerals.to_roman(F.col("l_linenumber")).alias("roman"))
    return grouping.joined(d, ["l_orderkey"], ["l_linenumber"], "roman", ", ", "romans").where("n > 1")


@query(
    "SELECT verse, count(*) AS n, string_agg(k::VARCHAR, ',' ORDER BY k) AS numbers FROM (SELECT o_orderkey % 1000 AS k, unnest(generate_series(a, b)) AS verse FROM"
    " (SELECT o_orderkey, (o_orderkey % 50)::INT AS a, (o_orderkey % 50 + o_custkey % 7 - 2)::INT AS b FROM orders)) GROUP BY verse"
)
def range_explode(spark, sf_dir):
    """A range that runs backwards gives nothing."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("k"), (F.col("o_orderkey") % 50).cast("int").alias("a"), (F.col("o_orderkey") % 50 + F.col("o_custkey") % 7 - 2).cast("int").alias("b"))
    return grouping.joined(reshape.range_rows(o, "a", "b", "verse"), ["verse"], ["k"], "k", ",", "numbers").select("verse", "n", "numbers")


@query("SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def first_and_last(spark, sf_dir):
    """A16"""
    return grouping.first_and_last(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["role", "turn"])


@query("SELECT n_nationkey AS doc, unnest([n_nationkey, n_nationkey + 1]) AS number FROM nation")
def split_numbers(spark, sf_dir):
    """E3"""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"), F.concat(F.col("n_nationkey").cast("string"), F.lit(" &amp; "), (F.col("n_nationkey") + 1).cast("string"), F.lit(" &amp; x")).alias("list"))
    return reshape.split_rows(n, "list", "&amp;", "number").select("doc", "number")


@query("SELECT r_regionkey, unnest(generate_series(1, r_regionkey + 1))::INT AS chapter FROM region")
def chapter_list(spark, sf_dir):
    """E6, D2"""
    return reshape.counted(table(spark, sf_dir, "region").select("r_regionkey", (F.col("r_regionkey") + 1).alias("n")), "n", "chapter").select("r_regionkey", "chapter")


# --- intervals ------------------------------------------------------------------------------------------------------

_SPANS = "SELECT {k} AS {p}_id, {k} % 40 AS {p}_sc, {k} % 7 AS {p}_sv, {k} % 40 + {x} % 3 - 1 AS {p}_ec, {x} % 11 AS {p}_ev FROM {t}"


def _spans(df: DataFrame, key: str, other: str, p: str) -> DataFrame:
    k, x = F.col(key), F.col(other)
    return df.select(k.alias(f"{p}_id"), (k % 40).alias(f"{p}_sc"), (k % 7).alias(f"{p}_sv"), (k % 40 + x % 3 - 1).alias(f"{p}_ec"), (x % 11).alias(f"{p}_ev"))


def _whole(spans: DataFrame) -> DataFrame:
    """No bound is null: ``overlap_join`` leaves such rows out, down to a filter in the scan."""
    return spans.select(spans.columns[0], *[F.coalesce(c, F.lit(2**31 - 1)).alias(c) for c in spans.columns[1:]])


@query(
    f"WITH a AS ({_SPANS.format(k='o_orderkey', x='o_custkey', p='a', t='orders')}), b AS ({_SPANS.format(k='s_suppkey', x='s_nationkey', p='b', t='supplier')})"
    " SELECT a_id, b_id FROM a JOIN b ON (a_sc, a_sv) <= (b_ec, b_ev) AND (a_ec, a_ev) >= (b_sc, b_sv)"
)
def interval_overlap(spark, sf_dir):
    """Some intervals end before they start. All rows take part: a bound that is null counts as above all numbers, as in SQL."""
    a = _whole(_spans(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "a"))
    b = _whole(_spans(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", "b"))
    return intervals.overlap_join(a, b, "a_id", "b_id", ("a_sc", "a_sv", "a_ec", "a_ev"), ("b_sc", "b_sv", "b_ec", "b_ev")).select("a_id", "b_id")


def _successor_sql(change: str, change_last: str, size: str) -> str:
    return f"""WITH s AS (SELECT o_custkey, o_orderkey, (o_orderkey % 28 + 1)::INT AS sc, (o_orderkey % 9 + 1)::INT AS sv FROM orders),
e AS (SELECT *, sc AS ec, CASE WHEN o_orderkey % 3 = 0 THEN sv + 4 WHEN o_orderkey % 3 = 1 THEN sv END AS ev FROM s),
n AS (SELECT *, lead(sc) OVER w AS nc, lead(sv) OVER w AS nv, lead(o_orderkey) OVER w IS NULL AS is_last FROM e WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
d AS (SELECT *, CASE WHEN nv = 1 THEN greatest(nc - 1, 1) ELSE nc END AS dc FROM n),
f AS (SELECT *, CASE WHEN nv = 1 THEN {size} ELSE nv - 1 END AS dv FROM d)
SELECT o_custkey, o_orderkey, sc, sv, (CASE WHEN is_last THEN CASE WHEN {change_last} THEN 28 ELSE ec END WHEN {change} THEN dc ELSE ec END)::INT AS ec,
       (CASE WHEN is_last THEN CASE WHEN {change_last} THEN 20 ELSE ev END WHEN {change} THEN dv ELSE ev END)::INT AS ev FROM f"""


def _starts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 28 + 1).cast("int").alias("sc"), (F.col("o_orderkey") % 9 + 1).cast("int").alias("sv"))
    return o.withColumn("ec", F.col("sc")).withColumn("ev", F.when(F.col("o_orderkey") % 3 == 0, F.col("sv") + 4).when(F.col("o_orderkey") % 3 == 1, F.col("sv")))


def _successors(spark, sf_dir, **how):
    return intervals.end_from_successor(_starts(spark, sf_dir), ["o_custkey"], "o_orderkey", ("sc", "sv"), ("ec", "ev"), **how).select("o_custkey", "o_orderkey", "sc", "sv", "ec", "ev")


_POINT = "(ev IS NULL OR ev = sv)"


@query(_successor_sql("true", "true", "50"))
def successor_interval_always(spark, sf_dir):
    """W1 a"""
    return _successors(spark, sf_dir, override="always", last="always")


@query(_successor_sql("true", "true", "coalesce((SELECT max(n_nationkey) + 10 FROM nation WHERE n_nationkey = dc), 50)"))
def successor_interval_table(spark, sf_dir):
    """W1 b: the last minor of a major comes from a table."""
    sizes = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 10).alias("size"))
    return _successors(spark, sf_dir, override="always", last="always", sizes=sizes)


@query(_successor_sql(_POINT, "true", "50"))
def successor_interval_point(spark, sf_dir):
    """W1 c"""
    return _successors(spark, sf_dir, override="if_point", last="always")


@query(_successor_sql(_POINT, "ev IS NULL", "50"))
def successor_interval(spark, sf_dir):
    """W1 d, the default"""
    return _successors(spark, sf_dir, override="if_point", last="if_open")


# --- state along lines --------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, CASE WHEN v IS NOT NULL AND v IS DISTINCT FROM p THEN v END AS shown FROM (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (SELECT *, CASE WHEN event_id % 4 > 0 THEN event_type END AS v FROM events))")
def emit_on_change(spark, sf_dir):
    """W2"""
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 4 > 0, F.col("event_type")).otherwise(""))
    return runs.on_change(e, ["user_id"], ["ts", "event_id"], "v").select("event_id", "user_id", "shown")


@query(
    """WITH l AS (SELECT event_id, user_id, event_type, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3)::BIGINT AS line FROM events),
d AS (SELECT DISTINCT user_id, event_type, line FROM l), g AS (SELECT *, line - row_number() OVER (PARTITION BY user_id, event_type ORDER BY line) AS g FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY line) % 2 = 1 AS shown FROM g)
SELECT event_id, user_id, event_type, line, shown FROM l JOIN s USING (user_id, event_type, line)"""
)
def alternating_suppress(spark, sf_dir):
    """Lines of three events each, so that keys repeat on a line and over lines."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor((n - 1) / 3).cast("long").alias("line"))
    return runs.alternate(e, ["user_id"], "line", "event_type").select("event_id", "user_id", "event_type", "line", "shown")


@query(
    """SELECT conv_id, paragraph, count(*) AS n_lines, string_agg(text, ' ' ORDER BY turn) AS body FROM (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS paragraph FROM
(SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 OR role = 'user' THEN 1 ELSE 0 END AS s FROM conversations)) GROUP BY conv_id, paragraph"""
)
def segment_paragraphs(spark, sf_dir):
    """A new paragraph wherever the user speaks."""
    c = runs.paragraphs(table(spark, sf_dir, "conversations").withColumn("is_break", F.col("role") == "user"), ["conv_id"], ["turn"], "is_break")
    return runs.paragraph_texts(c, ["conv_id"], "turn", "text")


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_size ORDER BY coalesce(try_cast(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT), 0), p_brand, p_partkey) AS display_number FROM part")
def natural_renumber(spark, sf_dir):
    """T3, W5, W13"""
    return grouping.renumbered(table(spark, sf_dir, "part"), ["p_size"], "p_brand", ties=["p_partkey"]).select("p_partkey", "p_brand", "display_number")


@query("SELECT conv_id, turn, number FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM conversations) WHERE turn % 3 <> 1 AND length(text) > 0")
def enumerate_with_gaps(spark, sf_dir):
    """Numbers are given before empty contents go."""
    c = table(spark, sf_dir, "conversations").withColumn("content", F.when(F.col("turn") % 3 != 1, F.col("text")).otherwise(""))
    return grouping.enumerated(c, ["conv_id"], ["turn"], "content").select("conv_id", "turn", "number")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE contains(source, 'src') AND NOT contains(source, '9') AND lower(lang) = 'en') WHERE n = 2")
def nth_qualifying(spark, sf_dir):
    """P6-P8"""
    keep = F.contains("source", F.lit("src")) & ~F.contains("source", F.lit("9")) & (F.lower("lang") == "en")
    return grouping.nth(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], keep, 2).select("source", "doc_id", "n_chars")


# --- lookups --------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, coalesce(n_name, c_name) AS label, coalesce(n_regionkey, -1) AS region FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON c_nationkey = n_nationkey")
def coalesce_lookup(spark, sf_dir):
    """R1, J4, J10"""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").where("n_nationkey % 3 > 0")
    c = lookup.with_default(c, n, "n_nationkey", "n_name", F.col("c_name"), "label")
    return lookup.with_default(c, n, "n_nationkey", "n_regionkey", F.lit(-1), "region").select("c_custkey", "label", "region")


@query("SELECT o_orderkey, coalesce(a.n_name, b.n_name, 'none') AS label FROM orders LEFT JOIN nation a ON o_custkey = a.n_nationkey LEFT JOIN nation b ON o_orderkey % 40 = b.n_nationkey")
def layered_lookup(spark, sf_dir):
    """By id, else by position, else a default."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 40).alias("place"))
    n = table(spark, sf_dir, "nation")
    return lookup.first_of(o, [(n, "o_custkey", "n_nationkey"), (n, "place", "n_nationkey")], "n_name", F.lit("none"), "label").select("o_orderkey", "label")


_RANGES = ((1, 11, "a"), (12, 25, "b"), (27, 40, "c"), (41, 50, "d"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN q BETWEEN 1 AND 11 THEN 'a' WHEN q BETWEEN 12 AND 25 THEN 'b' WHEN q BETWEEN 27 AND 40 THEN 'c' WHEN q BETWEEN 41 AND 50 THEN 'd' END AS file, CASE WHEN q <= 11 THEN 'C' || q ELSE 'SERMON ' || {_ROMAN_SQL.replace('n ', 'q ').replace('(n', '(q')} END AS anchor FROM (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q FROM lineitem)")
def range_lookup(spark, sf_dir):
    """26 is in no range."""
    q = F.col("l_quantity").cast("int")
    anchor = F.when(q <= 11, F.concat(F.lit("C"), q.cast("string"))).otherwise(F.concat(F.lit("SERMON "), numerals.to_roman(q)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", intervals.in_range(q, _RANGES).alias("file"), anchor.alias("anchor"))


@query("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS flag FROM orders")
def membership_flag(spark, sf_dir):
    """P4, J7"""
    members = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return lookup.flagged(table(spark, sf_dir, "orders"), members, ["o_custkey"]).select("o_orderkey", "flag")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_keys(spark, sf_dir):
    """Documents without a label."""
    return lookup.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    """WITH e AS (SELECT conv_id, unnest(generate_series(0, 5))::BIGINT AS turn FROM (SELECT DISTINCT conv_id FROM conversations)), a AS (SELECT DISTINCT conv_id, turn FROM conversations)
SELECT e.conv_id, count(*) AS expected, count(a.turn) AS present, bool_and(a.turn IS NOT NULL) AS complete FROM e LEFT JOIN a USING (conv_id, turn) GROUP BY e.conv_id"""
)
def completeness_report(spark, sf_dir):
    """Six turns are expected of each conversation."""
    c = table(spark, sf_dir, "conversations")
    expected = c.select("conv_id").distinct().withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    return lookup.completeness(expected, c, ["conv_id", "turn"], "conv_id")


@query(
    """SELECT source, count(*) AS n_docs, count(DISTINCT lang) AS n_langs, sum(n_chars)::BIGINT AS n_chars, count_if(n_chars > 2000) AS n_long, count_if(NOT n_chars > 2000) AS n_short FROM documents GROUP BY source"""
)
def summary_counts(spark, sf_dir):
    """A8, A15, K8"""
    long_ = F.col("n_chars") > 2000
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.count_distinct("lang").alias("n_langs"), F.sum("n_chars").alias("n_chars"), F.count_if(long_).alias("n_long"), F.count_if(~long_).alias("n_short"))


@query(f"SELECT doc_id, count_if(regexp_matches(line, '^[A-Z][a-zà-ÿ]+(,|\\.|\\s|$)')) AS n_short_start, count(*) AS n_lines FROM ({_LINES}) GROUP BY doc_id")
def line_shape_counts(spark, sf_dir):
    """A11"""
    rows = readers.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("line").rlike(r"^[A-Z][a-zà-ÿ]+(,|\.|\s|$)")).alias("n_short_start"), F.count("*").alias("n_lines"))


@query("SELECT c_custkey, coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN c_nationkey % 4 IN (0, 3) WHEN 'MACHINERY' THEN c_nationkey % 4 = 2 ELSE false END AND c_custkey % 5 > 0, false) AS valid FROM customer")
def page_guard(spark, sf_dir):
    """Known pairs of author and book, and a whole positive number."""
    k = F.col("c_custkey")
    book = F.element_at(F.array(*map(F.lit, crossref.BOOKS)), (F.col("c_nationkey") % 4 + 1).cast("int"))
    number = F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit("x"))).otherwise(k.cast("string"))
    valid = crossref.valid_page(F.col("c_mktsegment"), book, number, {"BUILDING": ("matthew", "john"), "MACHINERY": ("luke",)})
    return table(spark, sf_dir, "customer").select("c_custkey", valid.alias("valid"))


@query("SELECT item_id, unnest([0, 1, 2])::INT AS pos, unnest([left(text, 20) || substr(text, 21), '', substr(text, 21)]) AS content FROM benchmark")
def element_whole_texts(spark, sf_dir):
    """Each element's whole text, nested text included."""
    left, right = (markup.escape_html(F.expr(f"substr(text, {at})")) for at in ("1, 20", "21"))
    xml = F.concat(F.lit("<d><p>"), left, F.lit("<i>"), right, F.lit('</i></p><p n="2"/><p><i>'), right, F.lit("</i></p></d>"))
    rows = readers.element_texts(table(spark, sf_dir, "benchmark").select("item_id", xml.alias("xml")), "xml", "/d/p")
    return rows.select("item_id", "pos", "content")


@query(
    """WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, CASE WHEN parts[1] IN ('matthew', 'mark', 'luke', 'john') THEN parts[1] ELSE 'matthew' END AS book, coalesce(try_cast(parts[2] AS INT), 1) AS chapter FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN list_prepend('luke', parts[2:]) ELSE parts END AS parts FROM p)"""
)
def route_parse(spark, sf_dir):
    """R4, Q5, P12"""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    path = F.when(F.col("page_id") % 3 == 0, F.regexp_replace(path, r"^/[^/]*", "/luke")).otherwise(path)
    book, chapter = crossref.route(path)
    return table(spark, sf_dir, "pages").select("page_id", book.alias("book"), chapter.alias("chapter"))


# --- markup ---------------------------------------------------------------------------------------------------------


def _rules_sql(value: str, rules: markup.Rules) -> str:
    """A rule table as nested calls in SQL."""
    for pattern, to in rules:
        value = f"regexp_replace({value}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$', chr(92))}', 'g')"
    return value


def _strip_sql(value: str, allowed: str) -> str:
    """Tags are removed but for those of the allowed names: these are set aside and put back."""
    aside = f"regexp_replace({value}, '<(/?(?:{allowed})(?:\\b[^>]+)?)>', chr(1) || '\\1' || chr(2), 'g')"
    return f"replace(replace(regexp_replace({aside}, '<[^>]+>', '', 'g'), chr(1), '<'), chr(2), '>')"


def _paragraphs_sql(value: str) -> str:
    return f"array_to_string(list_transform(list_filter(list_transform(string_split({value}, '</p>'), lambda x: trim(regexp_replace(x, '<p[^>]*>', '', 'g'))), lambda x: x <> ''), lambda x: '<p>' || x || '</p>'), '')"


@query(f"SELECT page_id, {_SPACED.format(f'''regexp_replace({_CLEAN}, '<[^>]+>', ' ', 'g')''')} AS text FROM pages")
def html_strip(spark, sf_dir):
    """S11, G16, G22, G23"""
    clean = markup.rewrite(F.col("html"), [*markup.CLEAN_DOCUMENT[:3], (r"<[^>]+>", " ")])
    return table(spark, sf_dir, "pages").select("page_id", markup.normalise_space(clean).alias("text"))


_STRIPPED = (
    "regexp_replace(regexp_replace(" + _CLEAN + ", '(?i)</?blockquote[^>]*>', '', 'g'), '(?is)<p[^>]*>\\s*</p>', '', 'g')",
    "regexp_replace(regexp_replace(s, '(?i)<(/?)b>', '<\\1strong>', 'g'), '(?i)<(/?)i>', '<\\1em>', 'g')",
    "regexp_replace(regexp_replace(s, '<(/?(?:p|em|strong)(?:\\b[^>]+)?)>', chr(1) || '\\1' || chr(2), 'g'), '<[^>]+>', '', 'g')",
    "trim(regexp_replace(replace(replace(s, chr(1), '<'), chr(2), '>'), '\\s+', ' ', 'g'))",
    "regexp_replace(replace(s, '> <', '><'), '([.,;:!?])([A-Za-z])', '\\1 \\2', 'g')",
)
_STEPS = "SELECT page_id, {} AS s FROM pages".format(_STRIPPED[0])
for _step in _STRIPPED[1:]:
    _STEPS = f"SELECT page_id, {_step} AS s FROM ({_STEPS})"


@query(f"SELECT page_id, {_paragraphs_sql('s')} AS html FROM ({_STEPS})")
def html_allowlist_strip(spark, sf_dir):
    """G15-G18"""
    clean = markup.rewrite(F.col("html"), markup.CLEAN_DOCUMENT)
    kept = markup.rewrite(markup.strip_tags(clean, ["p", "em", "strong"]), markup.TIDY_SPACE)
    return table(spark, sf_dir, "pages").select("page_id", markup.paragraphs(kept).alias("html"))


@query("SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS ordinal, href, label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) AS label, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1), 1) AS i FROM pages)")
def regex_extract_all(spark, sf_dir):
    """G29, W7"""
    rows = markup.match_rows(table(spark, sf_dir, "pages").select("page_id", "html"), "html", r'<a href="([^"]*)">([^<]*)</a>', ["href", "label"])
    return rows.select("page_id", "ordinal", "href", "label")


@query(
    """WITH g AS (
  SELECT page_id, string_split(regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', chr(1), 'g'), chr(1)) AS gaps, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS labels FROM pages)
SELECT page_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: CASE WHEN i > 1 AND length(labels[i - 1]) > 2 THEN '<sup>' || (i - 1) || ':' || labels[i - 1] || '</sup>' ELSE '' END || gaps[i]), '') AS html FROM g"""
)
def footnote_callback(spark, sf_dir):
    """Each link becomes a numbered mark; links with a short label go."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    mark = F.concat(F.lit("<sup>"), F.col("ordinal").cast("string"), F.lit(":"), "label", F.lit("</sup>"))
    write = lambda found: found.withColumn("replacement", F.when(F.length("label") > 2, mark))
    return markup.replace_with(p, ["page_id"], "html", r'<a href="([^"]*)">([^<]*)</a>', ["href", "label"], write).select("page_id", "html")


@query(
    """WITH s AS (SELECT page_id, string_split(regexp_replace(html, '<(?:p|h1)>', chr(1), 'g'), chr(1)) AS bodies, regexp_extract_all(html, '<(?:p|h1)>') AS heads FROM pages)
SELECT page_id, unnest(range(1, len(heads) + 1)) AS section, unnest(heads) AS header, md5(unnest(bodies[2:])) AS body FROM s"""
)
def section_slice(spark, sf_dir):
    """What follows each paragraph or title tag."""
    out = markup.sections(table(spark, sf_dir, "pages"), ["page_id"], "html", "<(?:p|h1)>")
    return out.select("page_id", F.col("section").cast("long").alias("section"), "header", F.md5(F.col("body").cast("binary")).alias("body"))


@query(
    """SELECT page_id, CASE WHEN b > 0 THEN substr(html, b, CASE WHEN e > 0 THEN e ELSE length(html) - b + 1 END) END AS slice FROM (SELECT page_id, html, b, CASE WHEN b > 0 THEN strpos(substr(html, b + 1), '</p>') END AS e FROM
(SELECT page_id, html, CASE WHEN a > 0 AND strpos(substr(html, a + 1), '<p>') > 0 THEN a + strpos(substr(html, a + 1), '<p>') END AS b FROM (SELECT page_id, html, strpos(html, '<p>') AS a FROM pages)))"""
)
def marker_split(spark, sf_dir):
    """From the second paragraph tag to the next end tag."""
    return table(spark, sf_dir, "pages").select("page_id", markup.between(F.col("html"), "<p>", "</p>", 2).alias("slice"))


@query("SELECT page_id, replace(replace(replace(url || ' \"<a>\"', '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS attribute, url || ' \"<a>\"' AS back, replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '\"'), '&amp;', '&') AS title, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[-—]+\\s*', '', 'g') AS joined FROM pages")
def entities_and_escapes(spark, sf_dir):
    """G4, G11, G25"""
    value = F.concat("url", F.lit(' "<a>"'))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    escaped = markup.escape_attribute(value)
    return table(spark, sf_dir, "pages").select("page_id", escaped.alias("attribute"), markup.unescape_attribute(escaped).alias("back"), markup.decode_entities(title).alias("title"), markup.rewrite(title, markup.HYPHENS).alias("joined"))


@query("SELECT doc_id, regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1) AS last_word, coalesce(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, 'th'))[1], '') AS first_th, length(substr(text, 1, 1000))::BIGINT AS head FROM documents WHERE n_chars > 20 AND NOT regexp_matches(text, '(?i)^(the|notes)')")
def text_windows(spark, sf_dir):
    """P9-P11, W10, W11"""
    d = table(spark, sf_dir, "documents").where((F.col("n_chars") > 20) & ~F.col("text").rlike("(?i)^(the|notes)"))
    first = F.coalesce(grouping.first_matching(F.split("text", "\n"), "th"), F.lit(""))
    last = F.coalesce(grouping.last_match(F.col("text"), "[A-Za-z]+"), F.lit(""))
    return d.select("doc_id", last.alias("last_word"), first.alias("first_th"), F.length(F.substring("text", 1, 1000)).cast("long").alias("head"))


# --- maps and JSON --------------------------------------------------------------------------------------------------


@query("SELECT event_id, 'k' AS key, (props->>'$.k')::INT AS value FROM events WHERE (props->>'$.k') IS NOT NULL")
def json_fields(spark, sf_dir):
    """S4, S6"""
    e = table(spark, sf_dir, "events").select("event_id", readers.json_entries(F.col("props"), "int").alias("m"))
    return readers.map_rows(e, "m").select("event_id", "key", "value")


@query("SELECT r_name, '{' || string_agg('\"' || n_nationkey || '\":\"' || n_name || '\"', ',' ORDER BY n_nationkey::VARCHAR) || '}' AS json FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def json_map_sink(spark, sf_dir):
    """K1, E5, T5: keys in string order."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return writers.map_json(n, "n_nationkey", "n_name", "r_name")


@query("SELECT '{\"groups\":' || count(*) || ',\"total\":' || sum(n) || ',\"items\":[' || string_agg('{\"name\":\"' || source || '\",\"rows\":' || n || '}', ',' ORDER BY source) || ']}' AS json FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def json_manifest(spark, sf_dir):
    """K5, K7"""
    return writers.manifest(table(spark, sf_dir, "documents"), "source")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN n_chars END, quality) AS filled FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def add_if_absent(spark, sf_dir):
    """S14, P16, R2"""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("filled"))
    q = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("filled"))
    return writers.add_if_absent(d, q, "doc_id", "filled")


# --- whole plans ----------------------------------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT 'b' || (n_regionkey) AS book, n_nationkey AS chapter, n_nationkey % 5 + 1 AS verse FROM nation),
k AS (SELECT book, chapter, verse, 'K' || (chapter % 6) AS key FROM l),
lk AS (SELECT 'K' || (s_suppkey % 6) AS key, 'b' || (s_nationkey % 5) AS other_book, s_suppkey % 9 + 1 AS sc, s_suppkey % 4 + 1 AS sv, s_suppkey % 9 + 1 + s_suppkey % 2 AS ec, s_suppkey % 6 + 1 AS ev FROM supplier),
r AS (SELECT 'b' || (c_nationkey % 5) AS range_book, c_custkey AS number, c_custkey % 9 + 1 AS a, c_custkey % 5 + 1 AS b, c_custkey % 9 + 1 AS c, c_custkey % 7 + 1 AS d FROM customer)
SELECT l.book, l.chapter, l.verse, k.key, lk.other_book AS range_book, r.number::BIGINT AS number, CASE WHEN b = d THEN a || ':' || b ELSE a || ':' || b || '-' || d END AS label
FROM l JOIN k USING (book, chapter, verse) JOIN lk ON k.key = lk.key AND lk.other_book <> l.book JOIN r ON r.range_book = lk.other_book AND (sc, sv) <= (c, d) AND (ec, ev) >= (a, b)"""
)
def crossref_chain(spark, sf_dir):
    """J6 with J2, J5, F1, F9"""
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    t = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    lines_ = n.select(t("b", F.col("n_regionkey")).alias("book"), F.col("n_nationkey").alias("chapter"), (F.col("n_nationkey") % 5 + 1).alias("verse"))
    keys = lines_.withColumn("key", t("K", F.col("chapter") % 6))
    k = F.col("s_suppkey")
    ref = t(k % 9 + 1, ".", k % 4 + 1, "B-", k % 9 + 1 + k % 2, ".", k % 6 + 1)
    table_ = s.select(t("K", k % 6).alias("key"), t("b", F.col("s_nationkey") % 5).alias("other_book"), ref.alias("reference"))
    k = F.col("c_custkey")
    ranges = c.select(t("b", F.col("c_nationkey") % 5).alias("range_book"), k.alias("number"), (k % 9 + 1).cast("int").alias("start_major"), (k % 5 + 1).cast("int").alias("start_minor"), (k % 9 + 1).cast("int").alias("end_major"), (k % 7 + 1).cast("int").alias("end_minor"))
    return crossref.parallels(lines_, keys, table_, ranges).select("book", "chapter", "verse", "key", "range_book", "number", "label")


@query(
    """WITH v AS (SELECT doc_id AS chapter, line_no AS verse, min(line) AS text FROM (""" + _LINES + """) GROUP BY ALL)
SELECT n_nationkey AS canon, r_regionkey AS ord, r_name AS book, (n_nationkey + r_regionkey) AS chapter, (r_regionkey + 1)::INT AS verse, coalesce(text, 'not available') AS text, CASE WHEN n_regionkey = r_regionkey THEN -1 ELSE r_regionkey END AS sort_key
FROM nation CROSS JOIN region LEFT JOIN v ON v.chapter = n_nationkey + r_regionkey AND v.verse = r_regionkey + 1"""
)
def canon_view(spark, sf_dir):
    """Q3: R2, T6, F3, P14"""
    rows = readers.lines(table(spark, sf_dir, "documents").select(F.lit("d").alias("book"), F.col("doc_id").alias("chapter"), "text"))
    rows = rows.select("book", "chapter", F.col("line_no").alias("verse"), "line_no", F.col("line").alias("text"))
    books = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r_regionkey")  # a fixed set of five
    points = table(spark, sf_dir, "nation").select("*", books).join(table(spark, sf_dir, "region"), "r_regionkey").select(F.lit("d").alias("book"), F.col("n_nationkey").alias("canon"), F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name"), (F.col("n_nationkey") + F.col("r_regionkey")).cast("long").alias("chapter"), (F.col("r_regionkey") + 1).alias("verse"), crossref.own_first(F.col("r_regionkey"), F.col("n_regionkey"), F.col("r_regionkey")).alias("sort_key"))
    return crossref.point_text(rows, points).select("canon", "ord", F.col("name").alias("book"), "chapter", "verse", F.coalesce("text", F.lit("not available")).alias("text"), "sort_key")


_LINK = '<a href="([^"]*)">([^<]*)</a>'
_NOTE = "replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')"
#: the first rule of PAGE_BREAKS without its lookahead
_BREAKS = [(r"(?i)(\w)-?<pb[^>]*/?>(\w)", "$1$2"), markup.PAGE_BREAKS[1], (r"(?is)<h1>.*?</h1>", "")]
_LEADING = (r"^\s*(?:[A-Z][a-z]+\.?\s+)?(?:[IVXLC]+|\d+)[.:]\s*\d+(?:\s*[-,]\s*\d+)*[.;:]?[\s\p{Z}]*", "")


@query(
    f"""WITH b AS (SELECT page_id, html, CASE WHEN contains(html, '<article>') THEN substr(html, strpos(html, '<article>')) END AS a FROM pages),
c AS (SELECT page_id, html, CASE WHEN contains(a, '</article>') THEN left(a, strpos(a, '</article>') - 1) ELSE a END AS body FROM b),
t AS (SELECT page_id, {_rules_sql(_rules_sql(_strip_sql(_rules_sql('body', [*markup.CLEAN_DOCUMENT, *_BREAKS]), 'p|sup|a'), markup.TIDY_SPACE), [_LEADING])} AS text, regexp_extract_all(html, '{_LINK}', 2) AS labels FROM c)
SELECT page_id, {_paragraphs_sql('text')} || CASE WHEN len(labels) > 0 THEN '<ol>' || array_to_string(list_transform(labels, lambda x: '<li>' || {_NOTE} || '</li>'), '') || '</ol>' ELSE '' END AS html FROM t"""
)
def homily_page(spark, sf_dir):
    """Q4: an article sliced, cleaned, stripped to allowed tags and put into paragraphs, with its notes behind it."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", markup.between(F.col("html"), "<article>", "</article>").alias("body"))
    notes = markup.match_rows(table(spark, sf_dir, "pages").select("page_id", "html"), "html", r'<a href="([^"]*)">([^<]*)</a>', ["href", "label"])
    notes = notes.withColumn("item", F.concat(F.lit("<li>"), markup.escape_html(F.col("label")), F.lit("</li>")))
    notes = grouping.joined(notes, ["page_id"], ["ordinal"], "item", "", "list").select("page_id", "list")
    clean = markup.rewrite(F.col("body"), [*markup.CLEAN_DOCUMENT, *markup.PAGE_BREAKS, (r"(?is)<h1>.*?</h1>", "")])
    text = markup.paragraphs(markup.leading_reference_removed(markup.rewrite(markup.strip_tags(clean, ["p", "sup", "a"]), markup.TIDY_SPACE)))
    out = p.withColumn("text", text).join(notes, "page_id", "left")
    return out.select("page_id", F.concat("text", F.coalesce(F.concat(F.lit("<ol>"), "list", F.lit("</ol>")), F.lit(""))).alias("html"))


# --- editions -------------------------------------------------------------------------------------------------------


_EDITION = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'matthew' ELSE 'john' END AS book, CASE WHEN doc_id % 7 < 5 THEN ['I', 'II', 'III', 'IV', 'V'][doc_id % 7 + 1] ELSE 'VI' END AS numeral, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents"""
def _edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with a book and a numeral each."""
    rest = F.when(F.col("doc_id") % 7 < 5, numerals.to_roman(F.col("doc_id") % 7 + 1)).otherwise("VI")
    book = F.when(F.col("doc_id") % 2 == 0, "matthew").otherwise("john")
    return table(spark, sf_dir, "documents").select("doc_id", book.alias("book"), rest.alias("numeral"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))


@query(
    f"""SELECT doc_id, length(v)::BIGINT AS n_chars, md5(v) AS digest, left(v, 40) AS start FROM (
  SELECT doc_id, CASE WHEN source = '' THEN '<p>""</p>' ELSE '' END || CASE WHEN book = 'john' AND numeral = 'I' THEN 'Homily I.' ELSE '' END || ' Homily IX. ' || text AS v FROM ({_EDITION}))"""
)
def edition_headers(spark, sf_dir):
    """A header in paragraphs or as running text, titles and a quotation in front of whole documents; SQL has what is to be left."""
    header = F.concat(F.lit("Homilies of St. John Chrysostom,\narchbishop of constantinople,\non the\ngospel according to st. "), "book", F.lit("."))
    split = F.concat(F.lit("<p>"), F.array_join(F.split(header, "\n"), "</p>\n<p>"), F.lit("</p>"))
    title = F.concat(F.lit('<p><span class="c">Homily '), "numeral", F.lit('.</span></p><p>"'), "source", F.lit('"</p>'))
    raw = F.concat(F.when(F.col("doc_id") % 3 == 0, header).otherwise(split), title, F.lit('<scripRef p="1">Matt. 1.2</scripRef>Homily '), "numeral", F.lit(". Homily IX. "), "text")
    rows = _edition(spark, sf_dir)
    rows = rows.withColumn("v", editions.headers_removed(editions.element_removed(raw, "scripRef"), F.col("book")))
    out = rows.withColumn("v", editions.titles_removed(F.col("v"), F.col("numeral"), (F.col("book") == "john") & (F.col("numeral") == "I")))
    return out.select("doc_id", F.length("v").cast("long").alias("n_chars"), F.md5(F.col("v").cast("binary")).alias("digest"), F.substring("v", 1, 40).alias("start"))


_REMARKS = """<h3>SERMON IV. <i>x</i></h3><p align="center">From the Syriac MS.</p><p> cc. 2:21-24. </p><blockquote>From Mai</blockquote>[From Aubert]<A NAME="p12"><SPAN CLASS=pb>|12</SPAN></A><b>A</b> <i>word</i> """
_DEFINED = """<A NAME="3"></A>3. <sup>a</sup> see <i>there</i> """


@query(f"SELECT doc_id, length(v)::BIGINT AS n_chars, md5(v) AS digest, left(v, 40) AS start FROM (SELECT doc_id, regexp_replace('<strong>A</strong> <em>word</em> ' || text, '\\s+$', '') AS v FROM ({_EDITION}))")
def sermon_clean(spark, sf_dir):
    """Remarks in front of whole documents and a note behind them; SQL has what is to be left."""
    v = editions.sermon_cleaned(F.concat(F.lit(_REMARKS), "text", F.lit(_DEFINED)))
    return _edition(spark, sf_dir).select("doc_id", v.alias("v")).select("doc_id", F.length("v").cast("long").alias("n_chars"), F.md5(F.col("v").cast("binary")).alias("digest"), F.substring("v", 1, 40).alias("start"))


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '<div2 type="Homily" n="I" title="x">' || c_name || '</div2>' WHEN 1 THEN '<div2 type="Homily" n="II">second</div2>' END AS by_numeral,
CASE c_custkey % 3 WHEN 0 THEN '<div2 type="Homily" n="I" title="x">' || c_name || '</div2>' WHEN 1 THEN '<div2 type="Homily" n="II">second</div2>' END AS by_ordinal,
CASE c_custkey % 4 WHEN 0 THEN '#a ' || c_name || ' ' WHEN 1 THEN '#a ' || c_name || '<hr> nav ' WHEN 2 THEN '#a ' || c_name || ' ' WHEN 3 THEN '#a ' || c_name || ' end' END AS slice FROM customer"""
)
def edition_divisions(spark, sf_dir):
    """G5, G21"""
    k = F.col("c_custkey")
    xml = F.concat(F.lit('<div1><div2 type="Homily" n="I" title="x">'), "c_name", F.lit('</div2><div2 type="Homily" title="Hebrews">no</div2><div2 type="Homily" n="II">second</div2></div1>'))
    tail = F.when(k % 4 == 0, " #b<hr>").when(k % 4 == 1, "<hr> nav #b").when(k % 4 == 2, " <hr> nav").otherwise(" end")
    n = (k % 3 + 1).cast("int")
    c = table(spark, sf_dir, "customer").select(k, xml.alias("xml"), F.concat(F.lit("x #a "), "c_name", tail).alias("page"), n.alias("n"))
    return c.select(k.alias("k"), editions.division_by_numeral(F.col("xml"), numerals.to_roman(F.col("n"))).alias("by_numeral"), editions.division_by_ordinal(F.col("xml"), F.col("n"), "Homily", 'title="Hebrews').alias("by_ordinal"), editions.slice_ladder(F.col("page"), "#a", ["#b", "<hr>"]).alias("slice"))


@query("SELECT c_custkey AS k, c_name || ' [Greek: λόγος] & gone Matt. ' || c_nationkey AS note, '[<em>' || c_name || '</em> λόγος & Matt. ' || c_nationkey || ']' AS selected FROM customer")
def note_texts(spark, sf_dir):
    """G24, G25"""
    raw = F.concat(F.lit('<p class="endnote">[<i>'), "c_name", F.lit('</i> <span lang="EL">λόγος</span>\n&amp; <note n="1">gone</note> <scripRef>Matt. '), F.col("c_nationkey").cast("string"), F.lit("</scripRef>]</p>"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), editions.note_text(raw).alias("note"), editions.selective_text(raw).alias("selected"))


@query("SELECT 'f' || c_custkey AS file, 'f' || c_custkey || '_note_' || n AS note_key, n::BIGINT AS number, 'old ' || c_name AS note, CASE WHEN n % 3 > 0 THEN c_name || ' see more \"q\"' END AS defined FROM (SELECT c_custkey, c_name, c_custkey % 40 AS n FROM customer)")
def notes_by_number(spark, sf_dir):
    """G26, G27"""
    n = (F.col("c_custkey") % 40).cast("string")
    anchor = F.when(F.col("c_custkey") % 40 % 3 > 0, F.concat(F.lit('<A NAME="'), n, F.lit('"></A>'), n, F.lit(".&nbsp;"), "c_name", F.lit("  <I>see</I>&nbsp;more &quot;q&quot;<p>"))).otherwise("")
    page = F.concat(F.lit('a <A HREF="#'), n, F.lit('"><SUP>'), n, F.lit("</SUP></A> b "), anchor, F.lit('<A NAME="'), n, F.lit('"><SUP>'), n, F.lit("</SUP></A> old "), "c_name", F.lit(' <A NAME="77"><SUP>77</SUP></A> unmarked<br>'))
    pages = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file"), page.alias("page"), n.alias("n"))
    defined = pages.select("file", editions.note_by_number(F.col("page"), F.col("n")).alias("defined"))
    return editions.marked_notes(pages, "file", "page").join(defined, "file").select("file", "note_key", "number", "note", "defined")


@query("SELECT c_custkey AS k, (c_custkey % 9 + 1)::INT AS chapter, (c_nationkey + 1)::INT AS start, (CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 4 ELSE c_nationkey + 1 END)::INT AS \"end\", c_name AS text FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 5 = 0")
def verse_quotes(spark, sf_dir):
    """G28"""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    verses = F.concat((k % 9 + 1).cast("string"), F.lit(":"), (n + 1).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("-"), (n + 4).cast("string"))).otherwise(""), F.lit(". "), "c_name")
    q = editions.verse_quote(F.when(k % 5 == 0, F.col("c_name")).otherwise(verses))
    return table(spark, sf_dir, "customer").select(k.alias("k"), q.alias("q")).select("k", *[F.col(f"q.{f}").alias(f) for f in ("chapter", "start", "end", "text")])


# --- extensions: not in the surveyed operator set -----------------------------------------------------------------


@query(
    """WITH s AS (SELECT user_id, ts, event_id, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS value FROM g GROUP BY user_id, session"""
)
def ext_user_sessions(spark, sf_dir):
    """Extension: sessions with a gap of 30 minutes; streaming/sessions.py has the same over a stream."""
    from lineloom.streaming.sessions import sessions

    return sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))).select("user_id", "start", "n", F.round("value", 4).alias("value"))
