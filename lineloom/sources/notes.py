"""Loaders of notes in their shapes (K8, S5): what can't be read is a second output, and no load stops another."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOTES = "source string, page string, original string, display int, content string"
REJECTED = "source string, page string, reason string, record string"
_FIELDS = "struct<original_number: string, display_number: string, content: string>"
_NAMED = "struct<file: string, number: string, text: string>"


def _items(shape: str, entry: Column) -> Column:
    """The notes in a map's value, each as text of JSON; null if the value isn't of the shape."""
    if shape == "lists":
        return F.from_json(entry, "array<string>")
    if shape == "pages":
        return F.from_json(entry, "struct<footnotes: array<string>>")["footnotes"]
    if shape == "named":
        return F.when(F.from_json(entry, "map<string,string>").isNotNull(), F.array(entry))
    raise ValueError(f"{shape}: no such shape")


def load(spark: SparkSession, sources: Mapping[str, tuple[str, str]], page_of_file: str = r"^(.*)$") -> tuple[DataFrame, DataFrame]:
    """(notes, rejected) of several sources: name to (path, shape).

    Each path holds files that are one JSON object: page to a list of notes (``lists``), page to an object that has them
    under ``footnotes`` (``pages``), or a key to one note with its file (``named``; group 1 of ``page_of_file`` is the page, and
    notes are displayed in the order of their numbers). A note needs a number, and a text, which may be empty. Rejected is, with its reason, a path that doesn't
    exist, a file that is no object, a value that isn't of the shape, and a note without number or text: never more than that.
    """
    parts = [_load(spark, name, path, shape, page_of_file) for name, (path, shape) in sources.items()]
    if not parts:
        return spark.createDataFrame([], NOTES), spark.createDataFrame([], REJECTED)
    return tuple(reduce(DataFrame.unionByName, side) for side in zip(*parts, strict=True))


def _load(spark: SparkSession, name: str, path: str, shape: str, page_of_file: str) -> tuple[DataFrame, DataFrame]:
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], NOTES), spark.createDataFrame([(name, None, "no such path", path)], REJECTED)
    # a row holds a whole file or a whole entry only where that is what is rejected: else each note would carry all of them
    whole = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("page"), e["value"].alias("entry"), F.when(e["value"].isNull(), F.col("value")).alias("file")))
    read = F.from_json("value", "map<string,string>")
    entries = files.select(F.explode(whole(read)).alias("e")).select("e.page", _items(shape, F.col("e.entry")).alias("items"), F.coalesce("e.entry", "e.file").alias("record"))
    each = entries.select("page", F.when(F.col("items").isNull(), F.col("record")).alias("record"), F.col("items").isNull().alias("no_items"), F.explode_outer("items").alias("item"))
    if shape == "named":
        note = F.from_json("item", _NAMED)
        page = F.regexp_extract(note["file"], page_of_file, 1)
        original, shown, content = note["number"], F.lit(None).cast("int"), note["text"]
    else:
        note = F.from_json("item", _FIELDS)
        page, original, shown, content = F.col("page"), note["original_number"], note["display_number"].try_cast("int"), note["content"]
    reason = F.when(F.col("no_items"), "not of this shape").when(F.col("item").isNotNull() & (original.isNull() | content.isNull()), "no number or text")
    told = each.withColumn("reason", reason)
    rejected = told.where("reason IS NOT NULL").select(F.lit(name).alias("source"), "page", "reason", F.coalesce("item", "record").alias("record"))
    empty = F.trim("value").rlike(r"^\{\s*\}$")
    none = files.where(F.coalesce(F.size(read) < 1, F.lit(True)) & ~empty)
    rejected = rejected.unionByName(none.select(F.lit(name).alias("source"), F.lit(None).cast("string").alias("page"), F.lit("no object").alias("reason"), F.col("value").alias("record")))
    notes = told.where("reason IS NULL AND item IS NOT NULL").select(F.lit(name).alias("source"), page.alias("page"), original.alias("original"), shown.alias("display"), content.alias("content"))
    in_order = F.row_number().over(Window.partitionBy("source", "page").orderBy(F.col("original").try_cast("int"), "original", "content"))
    return notes.withColumn("display", F.coalesce("display", in_order) if shape == "named" else F.col("display")), rejected


def summary(notes: DataFrame, rejected: DataFrame) -> DataFrame:
    """K8: (source, pages, notes, rejected) of each source."""
    good = notes.groupBy("source").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("notes"))
    bad = rejected.groupBy("source").agg(F.count("*").alias("rejected"))
    return good.join(bad, "source", "full").na.fill(0, ["pages", "notes", "rejected"])


def read_with_rejects(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of JSON by schema: rejected (record) are the texts that aren't of it. Both are empty if the path doesn't exist."""
    corrupt = "_corrupt_record"
    whole = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    try:
        rows = spark.read.schema(whole).options(**({"multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt} | options)).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema), spark.createDataFrame([], "record string")
    # Spark reads the column of bad records only together with others
    bad = rows.where(F.col(corrupt).isNotNull()).select(F.coalesce(F.col(corrupt), F.to_json(F.struct(*schema.names))).alias("record"))
    return rows.where(F.col(corrupt).isNull()).drop(corrupt), bad
