"""From raw documents to token ids: language, near duplicates, personal data, mix, tokens.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and works on all that its predecessor kept. All
but the last return those columns again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.llm import bpe, jaccard_join, language_id, mixing, pii
from lineloom.llm._common import checkpointed, discard, forget, hidden, place, stored, table
from lineloom.llm.registry import vocabulary_path

#: A language must have so much of the probability of all that the model knows.
LEAST_SCORE = 0.5


def named(docs: DataFrame) -> list:
    """The columns that ``hidden`` made of those of ``docs``, under their names."""
    return [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, as do those of which no language has ``LEAST_SCORE``; the others get the predicted language.

    The model learns from the labelled documents of ``docs`` that aren't held out. If there are none, every document stays.
    """
    model = language_id.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), "doc_id")
    if not model.languages:
        return docs
    found = language_id.predict(hidden(docs), model, place(docs, "text"), label="_lang", score="_score")
    found = found.where((F.col("_lang") != language_id.UNKNOWN) & (F.col("_score") >= LEAST_SCORE))
    return found.withColumn(place(docs, "lang"), F.col("_lang")).select(*named(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays; rows that repeat its id and text are one.

    Rows that share an id are one document for links, and their different texts stay or go together. Rows with a null id
    have no group and stay.
    """
    key, text = place(docs, "doc_id"), place(docs, "text")
    rows = hidden(docs)
    found = jaccard_join.join(rows.select(key, text), key, text)
    keep = checkpointed(found.where(f"{key} = component_id").select(key).distinct())
    del found
    forget(spark)  # the join's shuffles go before the texts are shuffled
    first = Window.partitionBy(key, "_text").orderBy(F.xxhash64(*rows.columns))
    kept = rows.join(keep, key, "left_semi").withColumn("_text", F.md5(F.coalesce(text, F.lit("")).cast("binary"))).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select(*named(docs)).union(docs.where("doc_id IS NULL"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data, disguised ones included, is replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order; the last of each source may end early."""
    return mixing.mix(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives its text again."""
    done = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary_path("byte_bpe_50k.json"))
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mix", mix_sources),
    ("tokens", encode_tokens),
]

#: Neither the byte context trees nor the merges can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage returns is written to the shared checkpoint folder and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        after = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        forget(spark)  # no stage starts with the shuffles of the one before
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
