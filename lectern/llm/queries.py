"""The queries opN_<name> over the whole tables, and SQL where it can express them.

Each query runs its operator with production parameters and derives the contract's columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, classifier, embeddings, html_main, line_dedup, minhash, mixing, pii, rules, stats, token_files
from lectern.llm.common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])
    return bpe.digests(ids, path, ["doc_id"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines_gone", "n_words_gone", "aligned_with", "text")


def op4_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(stats.shape(_table(spark, sf_dir, "documents"), ["doc_id"]), "statistics")
    out = rules.judged(rows, rules.learn(rows, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", *stats.BASE, "base_failed", "kept")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(stats.shape(_table(spark, sf_dir, "documents"), ["doc_id"]), "statistics")
    out = classifier.scored(rows, classifier.fit(rows, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", "held_out", "score", "predicted")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(files)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_main": op4_html_main,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_minhash": op7_minhash,
    "op8_token_files": op8_token_files,
    "op9_personal_data": op9_personal_data,
    "op10_source_mixing": op10_source_mixing,
}

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS all_words
  FROM per_source),
levels AS (
  SELECT *, CAST(all_words - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed),
final AS (SELECT arg_min(level, (CAST(cap AS DOUBLE) / weight, nth)) AS level FROM levels WHERE cap >= level * weight),
goals AS (
  SELECT l.source, l.source_size, CAST(CASE WHEN f.level IS NULL THEN l.cap ELSE least(CAST(l.cap AS DOUBLE), f.level * l.weight) END AS DOUBLE) AS target
  FROM levels l CROSS JOIN final f),
queued AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
copies AS (
  SELECT q.*, c.copy, CAST(source_size * c.copy + upto AS DOUBLE) / nullif(target, 0) AS fin
  FROM queued q CROSS JOIN (VALUES (0), (1), (2)) AS c(copy) WHERE size > 0),
running AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY fin, doc_id, copy ROWS UNBOUNDED PRECEDING) AS used,
         (SELECT sum(size) FROM sized) AS budget
  FROM copies),
takes AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM running WHERE used <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, CAST(0 AS BIGINT)) AS taken
FROM queued q LEFT JOIN takes t ON q.doc_id = t.doc_id
"""

#: What is not here learns from data or runs an algorithm that SQL cannot express; tests/llm
#: holds those against brute force.
ORACLE_SQL = {"op10_source_mixing": _MIX}
