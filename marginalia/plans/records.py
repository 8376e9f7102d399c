"""Queries: record checks, precedence, re-association, cache counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import content_tokens
from marginalia.operators.answers import cache_lookup
from marginalia.operators.records import answer_prose, enriched_status, problem, reassociate
from marginalia.plans.versions import _KEY
from marginalia.registry import query
from marginalia.sources.views import CHUNKS, QUESTIONS, chunks, questions, read


@query(f"""WITH {CHUNKS}, b AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE policy END AS policy, CASE WHEN id % 5 = 0 THEN '  ' ELSE text END AS text FROM chunks)
SELECT id, CASE WHEN policy IS NULL THEN 'missing field: policy' WHEN trim(text) = '' THEN 'blank field: text' END AS problem FROM b""")
def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    rows = chunks(spark, sf_dir).withColumns({"policy": F.when(i % 7 != 0, F.col("policy")), "text": F.when(i % 5 == 0, "  ").otherwise(F.col("text"))})
    return rows.select("id", problem().alias("problem"))


@query("""WITH i AS (SELECT source AS query_id, doc_id AS id, doc_id AS pos, text, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS n FROM documents),
r AS (SELECT source AS query_id, -doc_id AS ord, text, row_number() OVER (PARTITION BY source, text ORDER BY -doc_id) AS n FROM documents WHERE doc_id % 2 = 0)
SELECT i.query_id, i.id, row_number() OVER (PARTITION BY i.query_id ORDER BY r.ord NULLS LAST, i.pos) AS place FROM i LEFT JOIN r ON i.query_id = r.query_id AND i.text = r.text AND i.n = r.n""")
def rerank_reassociate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker that returned every other text of each source, last first."""
    d = read(spark, sf_dir, "documents")
    items = d.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "text")
    returned = d.where("doc_id % 2 = 0").select(F.col("source").alias("query_id"), (-F.col("doc_id")).alias("ord"), "text")
    return reassociate(items, returned)


@query("""SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 9 = 0 THEN 'retired' END, CASE l.quality WHEN 0 THEN 'retired' WHEN 1 THEN 'active' END, CASE WHEN d.doc_id % 4 = 0 THEN 'retired' END, 'active') AS status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def enrich_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    manifest = F.when(F.col("quality") == 0, "retired").when(F.col("quality") == 1, "active")
    return rows.select("doc_id", enriched_status(manifest, F.when(i % 4 == 0, "retired"), F.when(i % 9 == 0, "retired")).alias("status"))


@query("SELECT conv_id, turn, text AS prose FROM conversations WHERE role = 'assistant'")
def prose_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a citation block, and what is left without it."""
    rows = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", answer_prose(F.concat("text", F.lit("\n \nSources: P 1.0, 3. Leave"))).alias("prose"))


@query(f"WITH {QUESTIONS}, k AS (SELECT id, {_KEY} AS key FROM questions) SELECT count(*) AS lookups, count(*) - count(DISTINCT key) AS hits, count(DISTINCT key) AS misses FROM k")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir).select("id", F.array_join(content_tokens(F.col("question")), " ").alias("key"))
    return cache_lookup(rows, "key", ["id"], "id").agg(F.count(F.lit(1)).alias("lookups"), F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
