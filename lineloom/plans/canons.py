"""The tables of canons as one job (Q7): files of rows to ranges, maps and a manifest, published together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.functions import numerals, refs
from lineloom.operators import grouping, reshape
from lineloom.sources import published, readers, writers


def read_canons(spark: SparkSession, path: str, books: Mapping[str, str], skip: int = 1) -> DataFrame:
    """(canon, rowid, one column a book) of files ``.../canon=N/..``, whose columns are all ``books``, empty where a canon lacks one."""
    rows = readers.tsv(spark, path, ", ".join(f"{b} int" for b in books), skip=skip, file="file")
    return rows.select(F.regexp_extract("file", r"canon=(\d+)/", 1).cast("int").alias("canon"), "rowid", *books)


def entries(canons: DataFrame, sections: DataFrame, books: Mapping[str, str]) -> DataFrame:
    """(canon, rowid, key, book, section, reference, verse, sc, sv, ec, ev): a row for each cell of a canon that has a section.

    ``sections`` (book, section, reference). The key is the canon's numeral and the row's number. Verse is where the reference starts, and its range is null if it can't be read.
    """
    cells = reshape.long_form(canons, ["canon", "rowid"], list(books), "short", "section")
    name = F.coalesce(*[F.when(F.col("short") == s, F.lit(b)) for s, b in books.items()])
    key = F.concat(numerals.to_roman(F.col("canon")), F.lit("."), F.col("rowid").cast("string"))
    rows = cells.select("canon", "rowid", key.alias("key"), name.alias("book"), "section").join(sections.select("book", "section", "reference"), ["book", "section"])
    rows = rows.withColumns({"verse": refs.start_key(F.col("reference")), "_r": refs.parse_range(F.col("reference"))})
    return rows.select("canon", "rowid", "key", "book", "section", "reference", "verse", *[F.col(f"_r.{c}").alias(c) for c in ("sc", "sv", "ec", "ev")])


def lookup_maps(rows: DataFrame) -> DataFrame:
    """K1: (key, json): what each key refers to in each book."""
    return writers.map_json(rows, "book", "reference", "key")


def verse_maps(rows: DataFrame) -> DataFrame:
    """K1, A4: (book, json): the key that begins at each verse; the last of the canons' rows counts."""
    last = grouping.last_wins(rows.where("verse IS NOT NULL"), ["book", "verse"], ["canon", "rowid"], ["key"])
    return writers.map_json(last, "verse", "key", "book")


def run(spark: SparkSession, root: str, canons: DataFrame, sections: DataFrame, books: Mapping[str, str]) -> dict:
    """Q7: all outputs in one run: the entries, which are computed once, and from them each canon's rows (K2), the maps (K1) and counts (K7)."""
    return published.publish(
        spark,
        root,
        [
            ("entries", "parquet", lambda _: entries(canons, sections, books)),
            ("canons", "json", lambda t: t["entries"].select("canon", "rowid", "book", "section", "reference")),
            ("canon_lookup", "json", lambda t: lookup_maps(t["entries"])),
            ("verse_to_canon", "json", lambda t: verse_maps(t["entries"])),
            ("counts", "json", lambda t: writers.manifest(t["entries"], "canon")),
        ],
    )
