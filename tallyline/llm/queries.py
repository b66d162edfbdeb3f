"""One query an operator, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import (
    chat,
    decontaminate,
    embedding_dedup,
    hard_negatives,
    lexical,
    line_dedup,
    one_bit,
    packing,
    quality,
    secret_scan,
    sharding,
    simhash,
    url_filter,
)
from tallyline.session import tune

Query = Callable[[SparkSession, str], DataFrame]

RULES = [
    url_filter.prefix_rule("allow", "com", "/"),
    url_filter.prefix_rule("block", "example.com", "/en/"),
    url_filter.prefix_rule("allow", "www.example.com", "/en/"),
    url_filter.prefix_rule("block", "net", "/es/"),
    url_filter.prefix_rule("block", "net", "/fr/"),
    url_filter.word_rule("block", "spam-farm"),
    url_filter.word_rule("block", "cheap-pills"),
    url_filter.word_rule("block", "casino"),
    url_filter.word_rule("block", "adult-video"),
]


def tokenizer_path() -> str:
    """The public vocabulary file; it is never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages", "page_id", "url"), RULES)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return linked.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("score", 6).alias("score"), "first_word", "end_word"
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
    return packed.withColumnRenamed("id", "doc_id")


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worth keeping: of good quality and not toxic."""
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    return _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").select("doc_id", good.alias("y"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    scored = quality.score_quality(docs, training_labels(spark, sf_dir))
    return scored.withColumnRenamed("id", "doc_id")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = chat.perspectives(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), context=64)
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return shown.select(
        F.col("conv").alias("conv_id"), "speaker", "part", "rendered", F.array_join(spans, ",").alias("mask"), "n_turns", "n_trained"
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_groups(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return grouped.select(
        F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_table(spark, sf_dir, "documents", "doc_id", "text"), sharding.grid(8), sharding.grid(9))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.described(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    secrets = secret_scan.scan_secrets(found, secret_scan.weak_label(found), planted=secret_scan.NEIGHBOURS)
    return secrets.withColumnRenamed("id", "doc_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    # Some labels are wrong on purpose, so that anchors have near rows of another label.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=label)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return lexical.rank(docs, _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = one_bit.nearest(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)
    return found.withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_embedding_dedup,
        op3_decontaminate,
        op4_packing,
        op5_quality,
        op6_chat,
        op7_simhash,
        op8_sharding,
        op9_line_dedup,
        op10_secret_scan,
        op11_hard_negatives,
        op12_lexical_search,
        op13_nearest,
    )
}

ORACLE: dict[str, str] = {
    "op1_url_filter": r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), listed AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|\.)(spam-farm|cheap-pills|casino|adult-video)\.') THEN 'block'
    ELSE 'allow' END AS verdict
FROM listed
""",
    "op6_chat": """
WITH said AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) - 1 AS pos FROM said
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM placed WHERE role <> 'system'
), sizes AS (
  SELECT conv_id AS c, max(pos) // 512 AS last_part FROM placed GROUP BY conv_id
), spread AS (
  SELECT *, pos // 512 AS part, true AS counted FROM placed
  UNION ALL SELECT p.*, pos // 512 + 1, false FROM placed p JOIN sizes ON conv_id IS NOT DISTINCT FROM c
            WHERE (pos + 64) // 512 > pos // 512 AND pos // 512 < last_part
  UNION ALL SELECT p.*, k.k, false FROM placed p JOIN sizes ON conv_id IS NOT DISTINCT FROM c JOIN range(1, 1000000) k(k) ON k.k <= last_part
            WHERE pos = 0 AND role = 'system' AND last_part > 0
), shown AS (
  SELECT p.conv_id, s.speaker, p.part, p.counted, p.pos, p.role = s.speaker AND p.counted AS own,
         '<|im_start|>' || CASE WHEN p.role = s.speaker THEN 'assistant' WHEN p.role = 'system' THEN 'system'
                                ELSE 'user name=' || p.role END || chr(10) AS head,
         p.body || '<|im_end|>' AS body
  FROM spread p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
), measured AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY pos) AS until FROM shown
)
SELECT conv_id, speaker, part, string_agg(head || body || chr(10), '' ORDER BY pos) AS rendered,
       coalesce(string_agg(CAST(CAST(until - 1 - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(until - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY pos)
                FILTER (WHERE own), '') AS mask,
       count(*) FILTER (WHERE counted) AS n_turns, count(*) FILTER (WHERE own) AS n_trained
FROM measured GROUP BY conv_id, speaker, part
""",
    "op9_line_dedup": r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs)
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id <> f.keeper, false) AS dropped
  FROM lines l LEFT JOIN frequent f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op11_hard_negatives": """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id
  AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10
""",
    "op12_lexical_search": r"""
WITH words AS (
  SELECT rowid AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), lengths AS (
  SELECT d, doc_id, count(*) AS n FROM words GROUP BY d, doc_id
), corpus AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths
), asked AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
), counted AS (
  SELECT d, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY d, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, corpus GROUP BY term, docs
), scored AS (
  SELECT i, item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN lengths USING (d), corpus
  GROUP BY i, item_id, d, doc_id
)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY i ORDER BY score DESC, doc_id, d)
QUALIFY row_number() OVER w <= 10
""",
    "op13_nearest": """
WITH sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), measured AS (
  SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) FOR i IN range(1, len(a.v) + 1)])) AS score
  FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM measured
WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id)
QUALIFY row_number() OVER w <= 10
""",
}
