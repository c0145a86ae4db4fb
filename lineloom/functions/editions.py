"""Rules for annotated editions: divisions, headers, titles, editorial remarks and notes.

An edition's text is a list of blocks: what ends with the end tag of a paragraph, heading or block quote. What is editorial is
told from a block's plain words, which are compared with lists of wording; running text only loses what is named here at
its start or in brackets. A pattern for the start of a text matches every text, if only its empty start, so that none is searched for it. A null text gives null everywhere, an empty one the empty string or, where something is looked up, null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions import markup
from lineloom.functions.markup import once

# The wording of the edited texts' headers and remarks.
HEADER = ("Homilies of St. John Chrysostom", "archbishop of constantinople", "gospel according to st. {book}", "st. {book}")
LINK = "on the"
PREFACE = "Preface"
SOURCES = ("Aubert", "Mai", "Cramer", "the Syriac", "S. Cyril")
EDITORIAL = ("From S. Cyril's Commentary", "Sermon of S. Cyril")
SEMANTIC = {"i": "em", "b": "strong"}

_BLOCK_ENDS = ("p", "h3", "blockquote")
_GAP = r"(?:[\s\p{Z}]++|<[^>]*+>)*+"
_SPACE = r"[\s\x85\p{Z}]"  # what ``markup.normalise_space`` takes for white space


# --- blocks and their words


def blocks(s: Column, ends: Sequence[str] = _BLOCK_ENDS) -> Column:
    """The blocks of a text, each with its end tag. Joined again they are the text."""
    end = "/(?:" + "|".join(ends) + ")>"
    return F.filter(F.regexp_extract_all(s, F.lit(rf"(?i)[^<]*+(?:<(?!{end})[^<]*+)*+(?:<{end}|\z)"), F.lit(0)), lambda b: b != "")


def joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def words(block: Column) -> Column:
    """A block's text in lower case without tags, its white space as it is."""
    return F.lower(markup.strip_tags(block))


def begins(said: Column, *with_one: str) -> Column:
    """Which of these patterns a text begins with behind white space; else its first character, nothing for a blank text."""
    return F.regexp_extract(said, rf"\A{_SPACE}*+({'|'.join(with_one)}|.)?", 1)


def is_element(block: Column, *names: str) -> Column:
    return F.lower(F.regexp_extract(block, r"\A(?:\s*<([A-Za-z0-9]+))?", 1)).isin(*names)


def phrase(words: str | Column, space: str = r"\s") -> Column:
    """A pattern of words in any case, whatever white space is between them."""
    words = F.lit(words) if isinstance(words, str) else words
    return F.concat(F.lit(r"(?i:"), F.array_join(F.transform(F.split(words, " +"), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), f"{space}+"), F.lit(")"))


def any_of(patterns: Sequence[Column]) -> Column:
    return F.concat(F.lit("(?:"), F.concat_ws("|", *patterns), F.lit(")"))


def from_first_text(parts: Column, wording: Sequence[Column]) -> Column:
    """Blocks from the first that says more than this wording and ``LINK``: punctuation alone is nothing. If none does, all of them."""
    known = any_of([phrase(w, _SPACE) for w in [*wording, LINK]])
    more = F.concat(F.lit(r"(?s)\A(?:"), known, F.lit(r"|[^\p{L}\p{N}])*+(.?)"))
    says = lambda b: F.call_function("regexp_extract", words(b), more, F.lit(1)) != ""
    step = lambda acc, b: F.when(acc["found"], acc).otherwise(F.struct((acc["at"] + 1).alias("at"), says(b).alias("found")))
    # blocks behind the first one that says more aren't looked at
    first = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("at"), F.lit(False).alias("found")), step, lambda acc: F.when(acc["found"], acc["at"]))
    cut = lambda p, at: F.when(at > 1, F.slice(p, F.greatest(at, F.lit(1)), F.greatest(F.size(p), F.lit(1)))).otherwise(p)
    return once(parts, lambda p: once(first(p), lambda at: cut(p, at)))


def without_start(s: Column, wording: Sequence[Column]) -> Column:
    """A text without any sequence of this wording at its start, and ``LINK`` between; tags in front stay."""
    one = F.concat(F.lit("(?:"), phrase(LINK), F.lit(r"\s+)?"), any_of([phrase(w) for w in wording]), F.lit(r"(?![\p{L}\p{N}])[\s.,]*"))
    return F.regexp_replace(s, F.concat(F.lit(rf"(?s)\A({_GAP})(?:"), one, F.lit(")*(.*+)")), F.lit("$1$2"))


# --- headers and titles


def header_wording(book: Column) -> list[Column]:
    """What the header of a book is made of; for a null book, what all have in common."""
    return [F.replace(F.lit(h), F.lit("{book}"), F.coalesce(book, F.lit("{book}"))) for h in HEADER]


def element_removed(s: Column, name: str) -> Column:
    """Elements of a name go with their text, if they hold no other element."""
    return markup.rewrite_with(s, f"<{name}", [(rf"<{name}[^>]*>[^<]*</{name}>", "")])


def headers_removed(s: Column, book: Column, preface: Column | None = None) -> Column:
    """The blocks of a book's header go, and its words at the start of the first block of text; where ``preface`` holds,
    that word too. Headers of other books stay."""
    wording = header_wording(book)
    if preface is not None:  # a word that is a header only there; elsewhere the first phrase stands in for it
        wording = [*wording, F.when(preface, PREFACE).otherwise(HEADER[0])]
    return without_start(joined(from_first_text(blocks(s), wording)), wording)


def header_lines_removed(s: Column, book: Column | None = None) -> Column:
    """Lines before the first one that is text go; blank lines, rules and lines of a header aren't text. If none is, all stay."""
    lines = from_first_text(F.split(s, "\n"), header_wording(F.lit(None).cast("string") if book is None else book))
    return F.array_join(lines, "\n")


def titles_removed(s: Column, numeral: Column, whole_only: Column | None = None) -> Column:
    """Blocks that are only a row's own title ("Homily" and its numeral) or one quotation go, and the title in running text.
    Where ``whole_only`` holds, titles in running text stay; a null numeral removes quotations only."""
    title = F.concat(F.lit("homily "), F.lower(numeral), F.lit("."))
    gone = lambda said: said.rlike(r'\A"[^"]+"\z') | F.coalesce(said == title, F.lit(False))
    whole = lambda w: begins(w, '"', "homily").isin('"', "homily") & once(markup.normalise_space(w), gone)
    may = lambda b: is_element(b, "p") & F.regexp_extract(b, rf"\A(?:{_SPACE}++|<[^>]+>)*+([\"Hh])?", 1).isin('"', "H", "h")
    kept = joined(F.filter(blocks(s), lambda b: ~(may(b) & once(words(b), whole))))
    stays = numeral.isNull() if whole_only is None else numeral.isNull() | F.coalesce(whole_only, F.lit(False))
    own = F.concat(F.lit(r"(?=[Hh])\b"), phrase(F.concat(F.lit("Homily "), F.coalesce(numeral, F.lit("")), F.lit("."))))
    return once(kept, lambda k: F.when(stays | ~F.contains(F.lower(k), F.lit("homily")), k).otherwise(F.regexp_replace(k, own, F.lit(""))))


def leading_reference_removed(s: Column, names: Sequence[str]) -> Column:
    """A verse reference at the start, also behind the tag of the first paragraph: one of the books' names with a chapter in
    Roman or Arabic numbers and its verses, or the verses that are left of one. What is left may have another in front; that stays."""
    book = "|".join(f"\\Q{n}\\E" for n in names)
    verses = r"\d+(?:\s*[,-]\s*\d+)*"
    one = rf"(?:(?:{book})[\s\p{{Z}}]+(?:[IVXLC]+|\d+)[.:]\s*{verses}|,\s*{verses})\.?[\s\p{{Z}}]*"
    return F.regexp_replace(s, rf"(?is)\A(?:(<p>)?[\s\p{{Z}}]*{one})?(.*+)", "$1$2")


# --- sermons


def bracketed_removed(s: Column, begins: str) -> Column:
    """Remarks in square brackets that begin so."""
    return once(s, lambda x: F.when(F.contains(x, F.lit("[")), F.regexp_replace(x, F.concat(F.lit(r"\["), phrase(begins), F.lit(r"\s[^\]]*\]")), F.lit(""))).otherwise(x))


def renamed(s: Column, names: Mapping[str, str] | None = None) -> Column:
    """Elements under other names, without attributes."""
    pairs = [(f"<{e}{a}>", f"<{e}{b}>") for a, b in (SEMANTIC if names is None else names).items() for e in ("", "/")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, s)


def is_remark(block: Column) -> Column:
    """Blocks that tell a sermon's number, its source or its passage, and empty paragraphs."""

    heading = is_element(block, "h3", "blockquote")

    def remark(said: Column) -> Column:
        told = reduce(Column.__or__, [F.contains(said, F.lit(f"from {x}".lower())) for x in SOURCES])
        numbered = said.rlike(r"\bsermon [ivxlcdm]+\b")
        editorial = reduce(Column.__or__, [F.contains(said, F.lit(x.lower())) for x in EDITORIAL])
        short = said.rlike(r"\A\[?from ") & told | said.rlike(r"\Acc?\. \d+:\d+[\d-]*\.\z") | (said == "")
        return F.when(heading, told | numbered).otherwise(editorial | short)

    def may(w: Column) -> Column:  # most paragraphs are told apart by their first word
        named = reduce(Column.__or__, [F.contains(w, F.lit(max(x.lower().split(), key=len))) for x in EDITORIAL])
        return heading | begins(w, r"\[?from", r"cc?\.").isin("", "from", "[from", "c.", "cc.") | named

    looked = once(words(block), lambda w: F.when(may(w), once(markup.normalise_space(w), remark)).otherwise(False))
    return F.when(is_element(block, "h3", "blockquote", "p"), looked).otherwise(False)


def sermon_cleaned(s: Column) -> Column:
    """A sermon's text without scripts, page marks, editorial remarks, the end of a heading that a cut left over, number
    marks in running text and defined notes; presentational elements get semantic names."""

    def from_text(text: Column, low: Column) -> Column:
        place = lambda x: F.nullif(F.call_function("locate", F.lit(x), low, F.lit(1)), F.lit(0))
        cut = lambda end: F.coalesce(end < F.least(*[F.coalesce(place(x), F.length(text) + 1) for x in ("<h3", "<p>", "<p ")]), F.lit(False))
        return once(place("</h3>"), lambda end: F.when(cut(end), F.substring(text, end + 5, F.length(text))).otherwise(text))

    clean = reduce(lambda c, r: markup.rewrite_with(c, r[0], [r[1]]), zip(("<script", "<style", "<!--"), markup.CLEAN_DOCUMENT[:3], strict=True), s)
    rest = once(clean, lambda text: once(F.lower(text), lambda low: F.when(F.contains(low, F.lit("</h3>")), from_text(text, low)).otherwise(text)))
    kept = joined(F.filter(blocks(rest), lambda b: ~is_remark(b)))
    kept = markup.rewrite_with(kept, '<a name="p', [(r'(?i)<a name="p\d+">\s*<span class="?pb"?>[^<]*</span>\s*</a>', "")])
    kept = markup.rewrite_with(bracketed_removed(kept, "From"), "sermon", [(r"(?i)(?=s)\bsermon\s+[ivxlc]+\b\.?\s*", "")])
    return F.regexp_replace(renamed(definitions_removed(kept)), r"(?s)\A\s*+((?:.*\S)?)\s*+", "$1")


def definitions_removed(s: Column) -> Column:
    """Notes defined behind numbered anchors, each up to the next anchor or paragraph."""
    return markup.rewrite_with(s, "<a name=", [(r'(?i)<a name="(\d+)"></a>\1\.[^<]*+(?:<(?!a name=|p[\s>])[^<]*+)*+', "")])


# --- divisions


def division_by_numeral(s: Column, numeral: Column, element: str = "div2") -> Column:
    """The first element whose ``n`` is the numeral, up to its first end tag; null if there is none."""
    found = F.regexp_extract_all(s, F.concat(F.lit(rf'(?s)<{element}[^>]*\bn="'), numeral, F.lit(rf'"[^>]*>.*?</{element}>')), F.lit(0))
    return F.get(found, 0)


def division_by_ordinal(s: Column, n: Column, kind: str, without: str, element: str = "div2") -> Column:
    """The n-th element, from 1, of a type that doesn't hold ``without``; null beyond the last."""
    found = F.regexp_extract_all(s, F.lit(rf'(?s)<{element}[^>]*type="{kind}"[^>]*>.*?</{element}>'), F.lit(0))
    return F.get(F.filter(found, lambda x: ~F.contains(x, F.lit(without))), n - 1)


def slice_ladder(s: Column, start: str | Column, ends: Sequence[str | Column]) -> Column:
    """From ``start`` to the next place of the first of ``ends`` that occurs behind it, else to the end; null without a start."""
    value = lambda x: F.lit(x) if isinstance(x, str) else x
    place = lambda s, x, at: F.nullif(F.call_function("locate", value(x), s, at), F.lit(0))
    cut = lambda s, at: F.substring(s, at, F.coalesce(*[place(s, e, at + 1) for e in ends], F.length(s) + 1) - at)
    return once(s, lambda s: once(place(s, start, F.lit(1)), lambda at: cut(s, at)))


# --- notes


def selective_text(s: Column, skipped: Sequence[str] = ("note",), names: Mapping[str, str] | None = None) -> Column:
    """An element's text: skipped children go with their text, renamed ones stay as tags, of all others the text stays."""
    names = SEMANTIC if names is None else names
    gone = "|".join(skipped)
    rules = [(rf"(?s)<({gone})\b[^>]*(?:/>|(?<!/)>.*?</\1>)", "")] if skipped else []
    rules += [(rf"<(/?){old}(?:\s[^>]*)?>", f"<$1{new}>") for old, new in names.items()]
    return markup.normalise_space(markup.decode_entities(markup.strip_tags(markup.rewrite(s, rules), names.values())))


def note_text(s: Column) -> Column:
    """A note's first paragraph (or all of it) without tags; Greek spans are marked, brackets around the whole go."""
    paragraph = F.regexp_extract_all(s, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    inner = F.coalesce(F.get(paragraph, 0), s)
    marked = markup.rewrite(inner, [(r'<span[^>]*lang="EL"[^>]*>([^<]+)</span>', "[Greek: $1]"), (r"<[^>]+>", "")])
    bare = lambda t: F.when(t.startswith("[") & t.endswith("]"), F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(t)
    return once(markup.normalise_space(markup.decode_entities(marked)), bare)


def note_by_number(s: Column, number: Column) -> Column:
    """The note defined behind the anchor of a number, up to the next anchor or paragraph, as plain text; null if there is none.

    The anchor is followed by the number and a full stop, which are no part of the note."""
    n = number.cast("string")
    anchor = F.concat(F.lit('<a name="'), n, F.lit('"></a>'), n, F.lit("."))
    place = lambda s, x, at: F.nullif(F.call_function("locate", x, F.lower(s), at), F.lit(0))
    stop = lambda s, at: F.least(*[F.coalesce(place(s, F.lit(x), at), F.length(s) + 1) for x in ("<a name=", "<p>", "<p ")])
    body = once(s, lambda s: once(place(s, anchor, F.lit(1)) + F.length(anchor), lambda at: F.substring(s, at, stop(s, at) - at)))
    return markup.normalise_space(markup.decode_entities(markup.strip_tags(body)))


def marked_notes(df: DataFrame, file: str, text: str) -> DataFrame:
    """One row for each number that is both marked and defined in a file: (file, note_key, number, note). The key holds
    the file, so numbers of different files don't collide; of several definitions of a number the first counts."""
    marks = markup.matches(F.col(text), r'<A HREF="#(\d+)"><SUP>\1</SUP></A>', 1)
    rows = df.select(file, F.col(text).alias("_s"), marks.alias("_marks"))
    rows = markup.match_rows(rows, "_s", r'<A NAME="(\d+)"><SUP>\1</SUP></A>\s*([^<]+)', ["_n", "_t"])
    rows = rows.where(F.array_contains("_marks", F.col("_n")))
    first = rows.groupBy(file, "_n").agg(F.min_by("_t", "ordinal").alias("_t"))
    return first.select(file, F.concat(F.col(file), F.lit("_note_"), "_n").alias("note_key"), F.col("_n").cast("long").alias("number"), F.trim("_t").alias("note"))


def verse_quote(s: Column) -> Column:
    """struct(chapter, start, end, text) of a quotation that starts with its verses; null if it doesn't."""
    part = lambda g: F.regexp_extract(s, r"\A\s*(\d+):(\d+)(?:-(\d+))?\.\s*([^\n]*)", g)
    number = lambda c: c.try_cast("int")
    quote = F.struct(number(part(1)).alias("chapter"), number(part(2)).alias("start"), F.coalesce(number(part(3)), number(part(2))).alias("end"), F.trim(part(4)).alias("text"))
    return F.when(part(1) != "", quote)
