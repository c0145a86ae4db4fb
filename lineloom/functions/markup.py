"""Text and markup rewriting as chains of column expressions.

Rules are data: ordered (pattern, replacement) pairs, applied one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]

# Entities are decoded with the ampersand last, and encoded with it first.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))

#: Elements that carry no text, editorial brackets, page marks, empty paragraphs; then presentational to semantic tags.
CLEAN_DOCUMENT: Rules = (
    (r"(?is)<script\b.*?</script\s*>", ""),
    (r"(?is)<style\b.*?</style\s*>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"\[From [^\]]+\]", ""),
    (r"(?i)</?blockquote[^>]*>", ""),
    (r"(?is)<p[^>]*>\s*</p>", ""),
    (r"(?i)<(/?)i>", "<$1em>"),
    (r"(?i)<(/?)b>", "<$1strong>"),
)
#: A word broken by a page mark is joined, any other page mark is a space.
PAGE_BREAKS: Rules = ((r"(?i)(\w)-?<pb[^>]*/?>(?=\w)", "$1"), (r"(?i)\s*<pb[^>]*/?>\s*", " "))
#: G17
TIDY_SPACE: Rules = ((r"\s+", " "), (r">\s+<", "><"), (r"([.,;:!?])([A-Za-z])", "$1 $2"))
#: A note mark goes behind the punctuation that follows it.
MARK_AFTER_PUNCTUATION: Rules = ((r"\s*(<sup\b[^>]*>.*?</sup>)\s*([.,;:!?]+)", "$2$1"), (r"\s+(<sup\b)", "$1"))
#: G11
HYPHENS: Rules = ((r"[-—]+\s*", ""),)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), 0)


def rewrite(s: Column, rules: Rules) -> Column:
    """Apply rules in order."""
    return reduce(lambda c, r: F.regexp_replace(c, F.lit(r[0]), F.lit(r[1])), rules, s)


def rewrite_with(s: Column, part: str, rules: Rules) -> Column:
    """``rewrite`` by rules whose matches all hold ``part``, in any case; texts without it are not searched for them."""
    return once(s, lambda x: F.when(F.contains(F.lower(x), F.lit(part.lower())), rewrite(x, rules)).otherwise(x))


def quoted(term: str) -> str:
    """A literal as a pattern."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#/" else c for c in term)


def highlight(s: Column, term: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """G1: wrap every occurrence of ``term``, in any case."""
    return F.regexp_replace(s, F.lit("(?iu)" + quoted(term)), F.lit(f"{before}$0{after}")) if term else s


def cut_bytes(s: Column, most: int, mark: str = "...") -> Column:
    """At most ``most`` bytes of UTF-8, then the mark; the cut goes back to the start of a character that it would split."""
    raw = F.substring(s.cast("binary"), 1, most)
    # the first byte that is cut off tells whether a character goes on there
    tail = lambda n: F.conv(F.hex(F.substring(s.cast("binary"), most + 1 - n, 1)), 16, 10).cast("int")
    inside = lambda n: F.coalesce(tail(n).between(0x80, 0xBF), F.lit(False))
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    kept = F.substring(raw, F.lit(1), F.lit(most) - back)
    return F.when(F.octet_length(s) > most, F.concat(kept.cast("string"), F.lit(mark))).otherwise(s)


def escape_html(s: Column) -> Column:
    """G3"""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")], s)


def escape_attribute(s: Column) -> Column:
    """Quotes and angle brackets only."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), [('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")], s)


def unescape_attribute(s: Column) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[1]), F.lit(r[0])), [('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")], s)


def decode_entities(s: Column) -> Column:
    """The few entities that occur in running text."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), ENTITIES, s)


def normalise_space(s: Column) -> Column:
    """Any Unicode white space is one space; ends are trimmed."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip_tags(s: Column, allowed: Iterable[str] = ()) -> Column:
    """Remove tags, but for those of the allowed names."""
    names = "|".join(allowed)
    return F.regexp_replace(s, rf"<(?!/?(?:{names})\b)[^>]+>" if names else r"<[^>]+>", "")


def paragraphs(s: Column) -> Column:
    """Split at ``</p>``, trim, drop empty ones and wrap again."""
    parts = F.transform(F.split(s, "</p>"), lambda p: F.trim(F.regexp_replace(p, r"<p[^>]*>", "")))
    return F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "")


def leading_reference_removed(s: Column) -> Column:
    """A verse reference at the very start, in Roman or Arabic numbers, with the punctuation after it."""
    return F.regexp_replace(s, r"^\s*(?:[A-Z][a-z]+\.?\s+)?(?:[IVXLC]+|\d+)[.:]\s*\d+(?:\s*[-,]\s*\d+)*[.;:]?[\s\p{Z}]*", "")


def attribution(author: Column, work: Column, number: Column, book: Column, label: Column) -> Column:
    """F16: one sentence that names author, work, number, book and passage."""
    return F.format_string("%s, %s %s on %s (%s)", author, work, number, book, label)


def reference_box(number: Column, is_cross: Column, author: Column, book: Column, own_label: Column, cross_label: Column) -> Column:
    """struct(class, number, tooltip) of a reference: its class by kind and sign, and the label of the crossing range
    for cross references, else that of its own interval. Negative numbers are the second author's."""
    second = number < 0
    css = F.concat_ws(" ", F.lit("ref"), F.when(is_cross, "cross-ref"), F.when(second, "second"))
    label = F.when(is_cross, cross_label).otherwise(own_label)
    n = F.abs(number).cast("string")
    return F.struct(css.alias("css"), n.alias("number"), attribution(author, F.when(second, "Sermon").otherwise("Homily"), n, book, label).alias("tooltip"))


def blank_reference(ref: Column) -> Column:
    """References that only name a kind of text are blank."""
    return F.when(ref.isNull() | ref.contains("Homily") | ref.contains("Sermon") | (ref == "Introduction"), "").otherwise(ref)


def matches(s: Column, pattern: str, group: int = 0) -> Column:
    """All matches, in order."""
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def match_rows(df: DataFrame, text: str, pattern: str, groups: Sequence[str]) -> DataFrame:
    """One row a match, with its ordinal from 1 and its groups as columns."""
    zipped = F.arrays_zip(*[matches(F.col(text), pattern, i + 1).alias(g) for i, g in enumerate(groups)])
    return df.select("*", F.posexplode(zipped).alias("_pos", "_m")).select("*", (F.col("_pos") + 1).alias("ordinal"), *[F.col(f"_m.{g}").alias(g) for g in groups]).drop("_pos", "_m")


def replace_with(df: DataFrame, key: Sequence[str], text: str, pattern: str, groups: Sequence[str], write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Replace each match by what ``write`` makes of it.

    ``write`` gets a row for each match (the key, ``ordinal`` from 1 over the text, the match and its groups) and one with ordinal 0,
    without a match, for what stands before the first. It keeps all rows and adds the column ``replacement``; null removes the match. It
    may join. ``key`` must be unique. The text is made once, however long its expression is.
    """
    none = F.array(F.lit(None).cast("string"))
    each = {"gap": F.split(F.col(text), pattern), "match": F.concat(none, matches(F.col(text), pattern)), **{g: F.concat(none, matches(F.col(text), pattern, i + 1)) for i, g in enumerate(groups)}}
    pieces = df.select(*key, F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in each.items()])).alias("ordinal", "_m"))
    pieces = pieces.select(*key, "ordinal", F.col("_m.gap").alias("_gap"), *[F.col(f"_m.{n}").alias(n) for n in ("match", *groups)])
    put = F.when(F.col("ordinal") > 0, F.coalesce("replacement", F.lit(""))).otherwise("")
    both = write(pieces).select(*key, F.struct("ordinal", F.concat(put, "_gap").alias("piece")).alias("p"))
    joined = both.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["piece"]), "").alias(text))
    return df.drop(text).join(joined, list(key))


def sections(df: DataFrame, key: Sequence[str], text: str, header: str) -> DataFrame:
    """(key, section from 1, header, body): each body runs from its header to the next one or the end."""
    bodies = F.slice(F.split(F.col(text), header), 2, 1 << 30)
    zipped = F.arrays_zip(matches(F.col(text), header).alias("header"), bodies.alias("body"))
    return df.select(*key, F.posexplode(zipped).alias("_pos", "_s")).select(*key, (F.col("_pos") + 1).alias("section"), F.col("_s.header").alias("header"), F.col("_s.body").alias("body"))


def between(s: Column, start: str, end: str, occurrence: int = 1) -> Column:
    """From an occurrence of ``start`` up to ``end``'s next occurrence, or to the end of the text; null without a start."""
    at = _nth(s, start, occurrence)
    stop = _from(s, end, at)
    return F.when(at > 0, F.substring(s, at, F.when(stop > 0, stop - at).otherwise(F.length(s))))


def _nth(s: Column, part: str, n: int) -> Column:
    at = F.expr("0")
    for _ in range(n):
        at = F.when(at.isNull(), None).otherwise(F.nullif(_from(s, part, at), F.lit(0)))
    return at


def _from(s: Column, part: str, after: Column) -> Column:
    """Place of ``part`` behind position ``after``, 0 if there is none."""
    return F.call_function("locate", F.lit(part), s, after + 1)
