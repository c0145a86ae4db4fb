"""Tags and texts of markup as ordered events, and elements at any depth from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions.markup import CLEAN_DOCUMENT, decode_entities, normalise_space, rewrite

# Elements of HTML that have no end tag.
VOID = "area base br col embed hr img input link meta source track wbr".split()


def events(df: DataFrame, key: Sequence[str], html: str, names: Sequence[str] = ()) -> DataFrame:
    """(key, pos from 0, kind, name, content, depth) of each tag and text of a document, in order.

    Comments, scripts and styles are no events. ``depth`` is that of the element which begins or ends, or holds the text;
    void elements and ``<../>`` have no content and kind ``empty``. With ``names`` only their tags count and are events, in lower case.
    A null document has no event; depths of a document whose tags don't match are those of the running sum.
    """
    pieces = F.regexp_extract_all(rewrite(F.col(html), CLEAN_DOCUMENT[:3]), F.lit(r"<[^>]+>|[^<]+"), F.lit(0))
    out = df.select(*key, F.posexplode(pieces).alias("pos", "content"))
    content = F.col("content")
    name = F.lower(F.regexp_extract(content, r"\A</?([A-Za-z][A-Za-z0-9]*)", 1))
    empty = name.isin(*VOID) | content.endswith("/>")
    tag = content.startswith("<")
    kind = F.when(~tag, "text").when(name == "", "other").when(content.startswith("</"), "end").when(empty, "empty").otherwise("start")
    out = out.withColumns({"name": F.when(tag, name).otherwise(""), "kind": kind}).where("kind <> 'other'")
    if names:
        out = out.where(~tag | F.col("name").isin(*names))
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    depth = F.sum(step).over(w) + F.when(F.col("kind").isin("end", "empty"), 1).otherwise(0)
    return out.withColumn("depth", depth.cast("int")).select(*key, "pos", "kind", "name", "content", "depth")


def element_texts(df: DataFrame, key: Sequence[str], xml: str, names: Sequence[str]) -> DataFrame:
    """(key, pos, name, level, content): every element of these names at any depth, in document order, with its whole text.

    What stands in an element inside another is text of both. ``level`` counts elements of these names only, from 1, so
    tags of other names need not match. Entities are decoded, white space is one space. An element without text has
    the empty string; one that never ends goes to the document's end.

    Each text asks, on every level it stands in, for the last element that began there: no text is joined with elements it isn't in.
    """
    rows = events(df, key, xml, [n.lower() for n in names])
    begun = rows.where("kind IN ('start', 'empty') AND depth > 0").select(*key, F.col("depth").alias("level"), "pos", "name", F.lit(None).cast("string").alias("text"))
    texts = rows.where("kind = 'text' AND depth > 0").select(*key, F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("level"), "pos", F.lit(None).cast("string").alias("name"), F.col("content").alias("text"))
    w = Window.partitionBy(*key, "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("name").isNotNull(), F.struct("pos", "name")), ignorenulls=True).over(w)
    owned = begun.unionByName(texts).withColumn("_start", start).where("_start IS NOT NULL")
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))), lambda p: p["text"])
    whole = owned.groupBy(*key, "level", "_start").agg(F.array_join(parts, "").alias("content"))
    return whole.select(*key, F.col("_start.pos").alias("pos"), F.col("_start.name").alias("name"), "level", normalise_space(decode_entities(F.col("content"))).alias("content"))
