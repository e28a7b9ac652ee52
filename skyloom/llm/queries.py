"""The queries of this subpackage's operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, edits, html, language, lines, lm, mixing, quality, shingles, topk
from .common import crc_mod, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.with_near(edits.edited_fingerprints(table(spark, sf_dir, "documents")))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.jaccard_components(table(spark, sf_dir, "documents"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = crc_mod("doc_id", 10)
    model = lm.train(docs.where(f"{part} <> 0"))
    out = lm.score(docs, model)
    return out.select("doc_id", F.expr(f"{part} = 0").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256.0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, most=2.0)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = crc_mod("doc_id", 3)
    model = language.train(docs, F.expr(f"{part} <> 1"))
    return language.predict(docs, model).select("doc_id", F.expr(f"{part} = 1").alias("held_out"), "lang_pred", "score", "accepted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = crc_mod("doc_id", 5)
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.expr(f"{part} <> 0"))
    scored = quality.predict(docs, model)
    return scored.select("doc_id", F.expr(f"{part} = 0").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and "_" in k and callable(v)}


_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
  SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

_JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
  t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n, b.n AS n2, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
  l AS (SELECT * FROM p WHERE 100 * c >= 75 * (n + n2 - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT a AS node, b AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
  SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, (SELECT min(a) FROM l WHERE b = s.doc_id AND c = n AND c = n2)) AS class_id,
    least(s.doc_id, (SELECT min(reach) FROM r WHERE node = s.doc_id)) AS component_id FROM s"""


def oracle_sql() -> dict[str, str]:
    """The other queries are beyond SQL (or their random choices are); the tests check them against brute force."""
    return {"op2_jaccard": _JACCARD, "op4_top_k": _TOP_K}
