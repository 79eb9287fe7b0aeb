"""The registered queries: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from probelake.llm import bpe_count, html_extract, language_id, mixing, near_dup, packing, quality_model, quality_rules, toxicity, vector_dup
from probelake.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model.train_quality(docs, labels, crc_mod(F.col("id"), 5) != 0)
    return _folded(quality_model.score_quality(docs, model), 0.3)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op3_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.vector_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixing.mix_sources(docs, F.array("source"), mixing.cycle_weights)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language_id.train_filters(docs, crc_mod(F.col("doc_id"), 4) != 2)
    out = language_id.identify(docs, filters)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train_toxicity(docs, labels, crc_mod(F.col("id"), 5) != 0)
    return _folded(toxicity.score_toxicity(docs, model), 0.5)


def _folded(scores: DataFrame, least: float) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    return scores.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )


QUERIES = {
    "op1_quality_attention": op1_quality_attention,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_vector_duplicates": op3_vector_duplicates,
    "op4_html_extract": op4_html_extract,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_mix_sources": op7_mix_sources,
    "op8_language_id": op8_language_id,
    "op9_pack_best_fit": op9_pack_best_fit,
    "op10_toxicity": op10_toxicity,
}


def _rule_sql(rules) -> str:
    """The threshold table as one SQL condition that is true where a rule fails."""
    return " OR ".join(f"100 * {r.numerator} {r.op} {r.bound} * {r.denominator}" for r in rules)


_STOP_FORMS = ", ".join(f"'{w}'" for w in sorted({x for s in quality_rules.STOP_WORDS for x in (s, s.capitalize())}))

#: Models, hashes and library tokenizers have no SQL form; their tests use brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": f"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0) AS lines
      FROM documents),
    words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
    tri AS (SELECT doc_id, i, x || ' ' || lead(x) OVER s || ' ' || lead(x, 2) OVER s AS t FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri WHERE t IS NOT NULL) WHERE c > 1),
    cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 3) r(k) GROUP BY doc_id),
    m AS (
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(w, lambda x: list_contains([{_STOP_FORMS}], x))) AS n_stop_words, 1 AS one
      FROM d LEFT JOIN cov USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_rule_sql(quality_rules.BASE)}) AS base_failed,
      NOT ({_rule_sql((*quality_rules.BASE, *quality_rules.RULES))}) AS kept
    FROM m
    """,
    "op3_vector_duplicates": """
    WITH RECURSIVE ok AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
    e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
    reach AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT reach.n, e.v FROM reach JOIN e ON reach.m = e.u),
    c AS (SELECT n, min(m) AS component_id FROM reach GROUP BY n), k AS (SELECT u, count(*) AS n_links FROM e GROUP BY u)
    SELECT n AS vec_id, coalesce(n_links, 0) AS n_links, component_id, n = component_id AS kept FROM c LEFT JOIN k ON n = u
    """,
}
