"""The queries ``opN_<name>``: each applies one operator to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import ann, bpe, exact_search, hard_negatives, html_text, jaccard_join, language_id, license_scan, mixing, pii, prefix_trie, suffix_dedup, token_counts
from lineloom.llm._common import table


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encode every text and decode its ids again; digests of both."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, packed=True).select("doc_id", "ids")
    return bpe.decode(ids, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.plan(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken", "finish_time")


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that strings of 200 bytes cover which start anywhere else too."""
    done = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows found of every row whose vec_id 100 divides."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 rows with the largest inner product with every row whose vec_id 50 divides."""
    return exact_search.search(table(spark, sf_dir, "embeddings"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text. The counts and the digest are those of the base spans, ``n_added`` counts the others."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[pii.count_of(base, k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, by a model of the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language_id.train(docs.where(remainder != 2), "doc_id")
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None, limit: int = 4096) -> DataFrame:
    """Token count of every text and whether it is over ``limit``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, path or vocabulary_path("piece_bpe_32k.model"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements in every text; counts, places and ``base_labels`` are those of the base phrases."""
    done = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda d: d["base"])
    return done.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["first"])).cast("long").alias("last_word"),
        license_scan.labels(F.col("base")).alias("base_labels"),
        license_scan.labels(F.concat("base", "kept")).alias("labels"),
        license_scan.score(F.col("kept")).alias("score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives of every row whose vec_id 50 divides, and negatives that score nearly as high; labels are shifted where 7 divides vec_id."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=shifted)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of the conversations, each with its first turns from the conversation that begins its hundred."""
    turns, texts, members = prefix_trie.read(table(spark, sf_dir, "conversations"))
    length = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    return prefix_trie.trie(prefix_trie.rebuilt(turns, members, 100, length, 5), texts, members)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_mix_sources": op2_mix_sources,
    "op3_repeated_bytes": op3_repeated_bytes,
    "op4_nearest": op4_nearest,
    "op5_top_products": op5_top_products,
    "op6_personal_data": op6_personal_data,
    "op7_main_text": op7_main_text,
    "op8_similar_documents": op8_similar_documents,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_license_scan": op11_license_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS place, md5(coalesce(text, '')) AS hash FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) AS n FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(n % 3 + 1)::INT] AS w, 3.0::DOUBLE * source_size AS cap FROM s
), u AS (
  SELECT *, cap / w AS ratio,
         (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS unit
  FROM w WINDOW b AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(unit, (ratio, n)) FROM u WHERE unit <= ratio) * w, cap)) AS target FROM u
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source, row_number() OVER () AS r,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id, d.size, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), i AS (
  SELECT r, size, sum(size) OVER (ORDER BY (p * source_size + start + size)::DOUBLE / target, source IS NULL, source COLLATE "C", p, start ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM q, (SELECT unnest([0, 1, 2]) AS p) WHERE size > 0 AND target > 0
), g AS (
  SELECT r, sum(greatest(0, least(size, (SELECT sum(size) FROM d) - ahead)))::BIGINT AS taken FROM i GROUP BY r
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, CASE WHEN target > 0 THEN (start + size)::DOUBLE / target END AS finish_time
FROM q LEFT JOIN g USING (r)""",
    "op8_similar_documents": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op5_top_products": """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), p AS (
  SELECT q.id AS query_id, x.id AS vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v x ON q.id <> x.id WHERE q.id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS a, a.id AS anchor_id, x.r AS x, x.id AS id, a.label = x.label AS alike, list_sum(list_transform(list_zip(a.v, x.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v x ON a.r <> x.r AND len(a.v) = len(x.v) WHERE a.id % 50 = 0
), p AS (
  SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, x) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.x ORDER BY n.score DESC, n.id, n.x)::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3""",
    "op13_prefix_trie": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(octet_length(encode(coalesce(role, ''))), ':', role, text))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b:
    xor(a >> 8, list_reduce(list_prepend(xor(a & 255, b), range(8)), lambda x, n: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h UNION ALL
  SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h
), l AS (
  SELECT c.conv_id, coalesce(list(sha256(concat(octet_length(encode(role)), ':', role, text)) ORDER BY i) FILTER (i IS NOT NULL), []) AS turns, coalesce(list(length(text) ORDER BY i) FILTER (i IS NOT NULL), []) AS chars
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id
), p AS (
  SELECT conv_id, d, len(turns) AS n, array_to_string(turns[1:d], '') AS node, array_to_string(turns[1:d - 1], '') AS parent, coalesce(chars[d], 0) AS chars FROM l, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)
), n AS (
  SELECT node, d, min(CASE WHEN d > 0 THEN parent END) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256 FROM p GROUP BY node, d
), k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY parent
), w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)
), u AS (
  SELECT x.node, count(*) FILTER (y.n_children = 0) AS n_leaves, sum(y.saved)::BIGINT AS saved_tokens FROM w x JOIN w y ON starts_with(y.node, x.node) GROUP BY x.node
)
SELECT w.conv_id, w.d::BIGINT AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens, w.ends_sha256
FROM w JOIN u USING (node) LEFT JOIN n q ON w.d > 0 AND q.node = w.parent""",
}
