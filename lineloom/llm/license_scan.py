"""License statements in texts, by ordered signature rules.

``license_rules`` has hundreds of rules in order of priority. A text is made into words; texts that hold none of the rules'
keywords are done. In the others each word gets its number, the rules whose keyword occurs are matched as regular
expressions, and the numbers in a match are its interval of words. A detection is suppressed where one of the same or a
higher priority covers its interval. Everything is expressions over one row: nothing is shuffled, and rows may repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.llm._common import hidden, place
from lineloom.llm.license_rules import RULES, Rule

#: How telling a detection of each level is.
STRENGTH = {1: 1.0, 2: 0.9, 3: 0.6, 4: 0.3}
#: How many neighbours are compared, as far as that is enough.
REACH = (4, 16, 64, 256, 1024, 4096)
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOUND = "array<struct<first: int, last: int, level: int, rule: int, label: string, base: boolean>>"


def plain(text: Column) -> Column:
    """Words with A-Z in lower case and one blank between them; empty for a null text."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, _NO_WORD, " "))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, an array, with the value computed once even where ``use`` has it inside a lambda."""
    return F.flatten(F.transform(F.array(value), use))


def _keywords(rules: Sequence[Rule]) -> Column:
    return F.expr(f"array({', '.join(repr(k) for k in sorted({r.keyword for r in rules}))})")


def _detections(words: Column, rules: Sequence[Rule]) -> Column:
    """Every match of the rules whose keyword is among the words, by place, longer ones first."""
    row = "named_struct('rule', {}, 'keyword', '{}', 'pattern', r'{}', 'level', {}, 'label', '{}', 'base', {})"
    table = F.expr(f"array({', '.join(row.format(i, r.keyword, r.pattern(), r.level, r.label, r.base) for i, r in enumerate(rules))})")
    tried = _once(F.array_intersect(_keywords(rules), words), lambda held: F.filter(table, lambda r: F.array_contains(held, r["keyword"])))
    numbered = F.array_join(F.transform(words, lambda w, i: F.concat(F.lit(" "), w, F.lit(":"), i.cast("string"), F.lit(" "))), "")
    number = lambda m, p: F.regexp_extract(m, p, 1).cast("int")

    def hits(text: Column, r: Column) -> Column:
        made = lambda m: F.struct(number(m, r":(\d+)").alias("first"), number(m, r":(\d+) $").alias("last"), r["level"].alias("level"), r["rule"].alias("rule"), r["label"].alias("label"), r["base"].alias("base"))
        return F.transform(F.regexp_extract_all(text, r["pattern"], F.lit(0)), made)

    found = _once(numbered, lambda text: F.flatten(F.transform(tried, lambda r: hits(text, r))))
    by_place = F.array_sort(F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("_last"), d["rule"].alias("rule"), d.alias("d"))))
    return F.transform(by_place, lambda p: p["d"])


def _kept(found: Column, most_words: int) -> Column:
    """Detections that no other of the same or a higher priority covers.

    One that covers another starts at most ``most_words`` before it, or at the same word. So in an array by place, few
    neighbours need a look: as many as the least of ``REACH`` behind which all start further away, else all.
    """
    far = lambda k: F.forall(F.sequence(F.lit(k), F.size(found) - 1), lambda i: F.get(found, i)["first"] - F.get(found, i - k)["first"] > most_words)
    reach = F.size(found)
    for k in reversed(REACH):
        reach = F.when(F.size(found) <= k, F.size(found)).when(far(k), F.lit(k)).otherwise(reach)

    def covered(d: Column, i: Column, reach: Column) -> Column:
        near = F.slice(found, F.greatest(i - reach + 1, F.lit(1)), 2 * reach + 1)
        over = lambda b: (b["first"] <= d["first"]) & (b["last"] >= d["last"])
        wider = lambda b: (b["first"] < d["first"]) | (b["last"] > d["last"])
        return F.exists(near, lambda b: over(b) & (b["level"] <= d["level"]) & (wider(b) | (b["rule"] < d["rule"])))

    return _once(reach, lambda n: F.filter(found, lambda d, i: ~covered(d, i, n)))


def scan(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``n_words`` long, ``found`` and ``kept``: arrays of (first, last word, level, rule, label, base) by place.

    ``found`` has every match of every rule (matches of one rule don't overlap), ``kept`` what is not suppressed. Null,
    empty and blank texts have no word and no detection. Rows that repeat or share an id are scanned each. Columns that
    already have one of these names are replaced, all others stay.
    """
    made = ("n_words", "found", "kept")
    rows = hidden(df).withColumn("_plain", plain(F.col(place(df, text))))
    blanks = F.length("_plain") - F.length(F.replace("_plain", F.lit(" "), F.lit("")))
    rows = rows.withColumn("n_words", F.when(F.col("_plain") == "", 0).otherwise(blanks + 1).cast("long"))
    rows = rows.withColumn("_words", F.split("_plain", " "))
    gate = F.arrays_overlap("_words", _keywords(rules))
    rows = rows.withColumn("found", F.when(gate, _detections(F.col("_words"), rules)).otherwise(F.array().cast(_FOUND)))
    rows = rows.withColumn("kept", _kept(F.col("found"), max(r.most_words() for r in rules)))
    stays = [F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns) if c.lower() not in made]
    return rows.select(*stays, *made)


def labels(found: Column) -> Column:
    """The distinct labels of detections, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")


def score(kept: Column) -> Column:
    """How telling the most telling detection is; 0 without any."""
    best = F.array_min(F.transform(kept, lambda d: d["level"]))
    return F.coalesce(*[F.when(best == level, F.lit(s)) for level, s in STRENGTH.items()], F.lit(0.0))
