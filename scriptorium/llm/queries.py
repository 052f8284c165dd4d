"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, chat, filter_audit, forest, line_dedup, ngram_join, ogg, packing, suffix_dedup, topk, toxicity, url_rules, whitening
from scriptorium.llm.common import table

#: (verdict, host, path)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.decode_ogg(ogg.encode_ogg(table(spark, sf_dir, "documents")))


def op2_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_chats(chat.render_chats(turns))


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
  SELECT *, CASE WHEN contains(text, '\\') OR regexp_matches(text, '</?s>|\[/?INST\]|\[ROLE\]|\[/?TEXT\]')
                 THEN regexp_replace(text, '(\\|</?s>|\[/?INST\]|\[ROLE\]|\[/?TEXT\])', '\\\1', 'g') ELSE text END AS shown
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE role WHEN 'user' THEN length(shown) + 18 WHEN 'assistant' THEN length(shown) + 6
                ELSE length(shown) + length(role) + 26 END) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=5, threshold=0.8, recall=0.999)
    return found.select("doc_id", "class_id", "n_links")


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared s JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE s.n >= 0.8 * (p.n + q.n - s.n)
  UNION ALL SELECT x.doc_id, y.doc_id FROM words x JOIN words y ON len(x.w) = 0 AND len(y.w) = 0 AND x.doc_id <> y.doc_id
), reach(a, b) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS doc_id, min(b) AS class_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links FROM reach r GROUP BY a
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup_units(documents.withColumn("n_chars", F.length(F.coalesce("text", F.lit("")))))
    return found.select(
        "doc_id", "n_chars", (F.col("n_chars") - F.length(F.coalesce("text", F.lit("")))).alias("n_removed"), F.size("removed_spans").alias("n_spans"),
        F.to_json("removed_spans").alias("removed_spans"), "text",
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_bpe(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode_bpe(encoded, ranks).drop("decoded")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(documents: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = packing.token_pieces(
        documents,
        public_tokenizers.path("byte_bpe_50k.json"),
        ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN,
    )
    return packing.pack_pieces(pieces)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(documents, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(documents, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rules_frame(spark, URL_RULES))


OP9_SQL = """
WITH rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
)
SELECT page_id, host, path,
       (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
       coalesce((SELECT arg_max(verdict, length(rhost || rpath)) FROM rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM split
"""

def op10_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), k=5, divisor=50, scale=256)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""



def op11_filter_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text
), marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * len(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 5 * length(t.text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN t.doc_id > f.first_id THEN 16 ELSE 0 END) AS mask
  FROM texts t JOIN firsts f ON f.text = t.text LEFT JOIN marks m ON m.doc_id = t.doc_id
), counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY 1, 2
), bits(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM bits a, bits b, bits c, bits d, bits e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
), steps AS (
  SELECT o.filter_order, s.step, b.bit, substring(o.filter_order, s.step, 1) AS letter,
         (SELECT coalesce(sum(x.bit), 0) FROM bits x WHERE strpos(o.filter_order, x.letter) < s.step) AS before
  FROM orders o CROSS JOIN (SELECT unnest(range(1, 6)) AS step) s JOIN bits b ON b.letter = substring(o.filter_order, s.step, 1)
), found AS (
  SELECT c.part, s.filter_order, CAST(s.step AS INTEGER) AS step, s.letter,
         CAST(sum(CASE WHEN mask & CAST(s.before + s.bit AS BIGINT) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN mask & CAST(s.before AS BIGINT) = 0 AND mask & s.bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN mask & CAST(s.before AS BIGINT) > 0 AND mask & s.bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = s.bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN mask & CAST(s.before AS BIGINT) = 0 AND mask & s.bit > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN mask & CAST(s.before AS BIGINT) = 0 AND mask & s.bit > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM counts c CROSS JOIN steps s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM found
"""


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)


def op13_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.neighbours(table(spark, sf_dir, "embeddings"), k=5, divisor=50)


QUERIES = {
    "op1_ogg_media": op1_ogg_media,
    "op2_chat_round_trip": op2_chat_round_trip,
    "op3_ngram_join": op3_ngram_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_pattern_packing": op7_pattern_packing,
    "op8_toxicity": op8_toxicity,
    "op9_url_rules": op9_url_rules,
    "op10_top_products": op10_top_products,
    "op11_filter_shapley": op11_filter_shapley,
    "op12_jacobi_whitening": op12_jacobi_whitening,
    "op13_projection_forest": op13_projection_forest,
}
ORACLES = {"op2_chat_round_trip": OP2_SQL, "op3_ngram_join": OP3_SQL, "op9_url_rules": OP9_SQL, "op10_top_products": OP10_SQL, "op11_filter_shapley": OP11_SQL}
