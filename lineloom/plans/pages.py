"""Pages of an annotated edition as they are served (Q4): one plan from markup and notes to a page.

Notes leave the text before any rule sees it: a mark of two private characters around the note's number stands for each, and
is replaced at the very end by what the notes table has under that number. So no rule can change a note.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions import editions, markup
from lineloom.functions.refs import range_label
from lineloom.operators import grouping
from lineloom.plans.crossref import valid_page

OPEN, CLOSE = "\ue000", "\ue001"
PAGE = ["author", "book", "number"]
#: ``markup.TIDY_SPACE`` without matches that change nothing.
_TIDY = ((r"[^\S ]\s*+| \s++", " "), (r">\s+<", "><"), (r"[.,;:!?](?=[A-Za-z])", "$0 "))


def notes_set_aside(s: Column, pattern: str) -> Column:
    """Each note is replaced by a mark with its number, group 1 of ``pattern``. Marks go behind the punctuation that
    follows them, without blanks between, and a blank between punctuation and a mark goes."""
    marked = F.regexp_replace(s, pattern, f"{OPEN}$1{CLOSE}")
    mark = f"{OPEN}[^{CLOSE}]*{CLOSE}"
    behind = F.regexp_replace(marked, rf"(?=[\s{OPEN}])\s*+((?:{mark})+)([.,;:!?]+)", "$2$1")
    return F.regexp_replace(behind, rf"\s(?<=[.,;:!?]\s)\s*+(?={OPEN})", "")


def notes_put_back(df: DataFrame, key: Sequence[str], text: str, notes: DataFrame, in_turn: Column | None = None, fallback: str = "Footnote %s") -> DataFrame:
    """Marks become superscripts with the note as tooltip, and a space where a letter follows.

    ``notes`` (key, original, display, content): a mark is looked up by its original number; without a note it goes. Where
    ``in_turn``, a condition on the key, holds, it is shown under its place, and its tooltip is the note of its original number, else the one that is
    displayed under that number, else ``fallback``.
    """
    told = F.struct(F.col("display").cast("string").alias("shown"), "content")
    by = lambda column: F.struct(F.col(column).cast("string").alias("n"), F.lit(column == "original").alias("own"))
    numbered = notes.select(*key, told.alias("_t"), F.explode(F.array(by("original"), by("display"))).alias("_by")).select(*key, "_by.n", "_by.own", "_t")
    known = numbered.groupBy(*key, "n").agg(F.min(F.when(F.col("own"), F.col("_t"))).alias("_own"), F.min(F.when(~F.col("own"), F.col("_t"))).alias("_nth"))
    in_turn = F.lit(False) if in_turn is None else F.coalesce(in_turn, F.lit(False))

    def write(found: DataFrame) -> DataFrame:
        both = found.join(known, [*key, "n"], "left")
        content = F.when(in_turn, F.coalesce("_own.content", "_nth.content", F.format_string(fallback, "n"))).otherwise(F.col("_own.content"))
        shown = F.when(in_turn, F.col("ordinal").cast("string")).otherwise(F.col("_own.shown"))
        space = F.when(F.col("next") != "", " ").otherwise("")
        return both.withColumn("replacement", F.concat(F.lit('<sup class="note" data-note="'), markup.escape_attribute(content), F.lit('">'), shown, F.lit("</sup>"), space))

    return markup.replace_with(df, key, text, rf"{OPEN}([^{CLOSE}]*){CLOSE}(?=([A-Za-z]?))", ["n", "next"], write)


def note_list(notes: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, list): a page's notes as an ordered list, by the number they are shown under."""
    item = F.concat(F.lit('<li id="fn-'), F.col("display").cast("string"), F.lit('">'), markup.escape_attribute(F.col("content")), F.lit("</li>"))
    items = grouping.joined(notes.withColumn("_item", item), list(key), ["display"], "_item", "", "list")
    return items.select(*key, F.concat(F.lit("<ol>"), "list", F.lit("</ol>")).alias("list"))


def homily_body(division: Column, book: Column, numeral: Column, names: Sequence[str], is_preface: Column) -> Column:
    """The text of a division, its notes set aside: without header, title, quotation, references and tags but paragraphs."""
    text = notes_set_aside(division, r'(?s)<note\b[^>]*\bn="([^"]+)"[^>]*>.*?</note>')
    text = editions.element_removed(text, "scripRef")
    text = editions.headers_removed(F.regexp_replace(text, r"(?s)\A(?:\s*<div2[^>]*>)?(.*+)", "$1"), book, is_preface)
    text = markup.rewrite_with(editions.titles_removed(text, numeral, is_preface), "<pb", markup.PAGE_BREAKS)
    text = markup.rewrite(markup.rewrite(markup.strip_tags(text, ["p"]), [(r"<p\s[^>]*>", "<p>")]), _TIDY)
    first = lambda t: F.regexp_replace(editions.leading_reference_removed(t, names), r"\A<p></p>", "")
    return markup.once(F.trim(markup.paragraphs(text)), lambda t: F.when(is_preface, t).otherwise(first(t)))


def sermon_body(page: Column, roman: Column, navigation: str) -> Column:
    """A sermon from its heading to the next one, a rule or the ``navigation``, cleaned, its notes set aside."""
    start = F.concat(F.lit('<a name="SERMON '), roman, F.lit('">'))
    found = editions.slice_ladder(page, start, ['<a name="SERMON ', "<hr>", navigation])
    marked = notes_set_aside(found, r'(?i)<a href="#([^"]+)"><sup>[^<]*</sup></a>')
    return editions.sermon_cleaned(F.regexp_replace(marked, r"(?s)\A<a name[^>]*>(?:</a>)?", ""))


def served(requests: DataFrame, texts: DataFrame, notes: DataFrame, coverage: DataFrame, known: Mapping[str, Sequence[str]], second: str) -> DataFrame:
    """Q4: (author, book, number, status, reference, html) of requested pages, one row a request.

    ``requests`` (author, book, number as text), ``texts`` (author, book, number, body) of divisions that ``homily_body`` and ``sermon_body`` have made, ``notes`` (author, book, number,
    original, display, content), ``coverage`` (author, book, number, start_major, .., end_minor). Status 400: a number that is none, 404: an unknown author or book or no such text (R2, P12), 200: found. A page has
    its passage above it if that is known, and its notes below.
    """
    number = F.col("number").try_cast("int")
    asked = requests.select("author", "book", F.col("number").alias("asked"), number.alias("number"))
    pairs = valid_page(F.col("author"), F.col("book"), F.lit("1"), known)
    bodies = notes_put_back(texts.select(*PAGE, "body"), PAGE, "body", notes, F.col("author") == second)
    label = F.concat(F.initcap("book"), F.lit(" "), range_label(*[F.col(c) for c in ("start_major", "start_minor", "end_major", "end_minor")]))
    passages = coverage.select(*PAGE, label.alias("reference")).groupBy(*PAGE).agg(F.min("reference").alias("reference"))
    rows = asked.join(bodies, PAGE, "left").join(passages, PAGE, "left").join(note_list(notes, PAGE), PAGE, "left")
    status = F.when(~pairs, 404).when(F.col("number").isNull(), 400).when(F.col("body").isNull(), 404).otherwise(200)
    above = F.coalesce(F.concat(F.lit('<p class="reference">'), "reference", F.lit("</p>")), F.lit(""))
    below = F.coalesce(F.concat(F.lit('<div class="notes">'), "list", F.lit("</div>")), F.lit(""))
    found = F.col("status") == 200
    rows = rows.withColumn("status", status)
    return rows.select("author", "book", F.col("asked").alias("number"), "status", F.when(found, F.col("reference")).alias("reference"), F.when(found, F.concat(F.lit('<div class="text">'), above, "body", below, F.lit("</div>"))).alias("html"))


def looked_up(df: DataFrame, table: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """R2: rows with what their key stands for and the status of the lookup: 200, or 404 where the table has no such key."""
    hit = table.select(key, *columns).withColumn("_hit", F.lit(True))
    return df.join(hit, key, "left").withColumn("status", F.when(F.col("_hit"), 200).otherwise(404)).drop("_hit")


