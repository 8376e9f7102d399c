"""Queries: whole answers, and the batch form of the span stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.router import best_policy, fit_text, parse_queries, parse_verdict
from marginalia.registry import query
from marginalia.sources.views import CHUNKS, QUESTIONS, chunks, questions, read
from marginalia.streaming.ingest import span_windows


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type AS step, count(*) AS spans, round(sum(value), 4) AS seconds FROM events GROUP BY ALL""")
def span_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = span_windows(read(spark, sf_dir, "events"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "step", "spans", F.round("seconds", 4).alias("seconds"))


@query(f"WITH {QUESTIONS} SELECT id, policy FROM questions")
def route_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy that a question is about, by its name's words."""
    return best_policy(questions(spark, sf_dir), chunks(spark, sf_dir).select("policy").distinct())


@query(f"""WITH {CHUNKS} SELECT id, CASE id % 3 WHEN 0 THEN policy || '|' || version WHEN 1 THEN regexp_replace(policy, '[0-9]+$', '') || '|' || version ELSE '' END AS queries FROM chunks""")
def parse_query_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id") % 3
    raw = F.when(n == 0, F.to_json(F.array("policy", "version", "policy", F.lit(" ")))).when(n == 1, F.concat(F.lit("1. "), "policy", F.lit("\n* "), F.lit("v"), "version", F.lit("x\n"), "policy")).otherwise(F.lit('{"a": 1}'))
    rows = chunks(spark, sf_dir).select("id", "policy", "version", raw.alias("raw"))
    found = parse_queries(F.col("raw"), 5)
    return rows.select("id", F.regexp_replace(F.array_join(found, "|"), r"\|v(.*)x$", "|$1").alias("queries"))


@query("""WITH t AS (SELECT doc_id, text, strlen(text) AS b FROM documents)
SELECT doc_id, b > 2000 AS cut, b <= 1000 AS with_parent FROM t""")
def fit_to_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts (with themselves as parent) for a sink of 2000 bytes a row."""
    text, parent = fit_text(F.col("text"), F.col("text"), 2000)
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", text.alias("fitted"), parent.alias("parent"))
    return rows.select("doc_id", (F.col("fitted") != F.col("text")).alias("cut"), F.col("parent").isNotNull().alias("with_parent"))


@query(f"""WITH {CHUNKS} SELECT policy, string_agg(version || ':' || CASE WHEN policy = 'src3' AND version <> '3.0' THEN 'retired' ELSE status END, ',' ORDER BY version) AS listing
FROM (SELECT policy, version, arg_min(status, id) AS status FROM chunks GROUP BY policy, version) GROUP BY policy""")
def admin_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after old versions of one policy were retired."""
    docs = chunks(spark, sf_dir).groupBy("policy", "version").agg(F.min_by("status", "id").alias("status"))
    docs = docs.withColumn("status", F.when((F.col("policy") == "src3") & (F.col("version") != "3.0"), "retired").otherwise(F.col("status")))
    return docs.groupBy("policy").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "version", "status"))), ",").alias("listing"))


@query("""SELECT doc_id, doc_id % 5 = 0 AS pass, CASE doc_id % 5 WHEN 0 THEN source || ', fine' WHEN 1 THEN '' ELSE 'unparseable judge response' END AS reason FROM documents""")
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' replies: fenced, with words around, without a boolean, without an object, cut off."""
    n, reason = F.col("doc_id") % 5, F.concat("source", F.lit(", fine"))
    good = F.concat(F.lit('```json\n{"pass": true, "reason": "'), reason, F.lit('"}\n```'))
    raw = F.when(n == 0, good).when(n == 1, 'Verdict: {"pass": false} so far.').when(n == 2, '{"pass": "yes", "reason": "x"}').when(n == 3, F.col("source")).otherwise('{"pass": true, "reas')
    verdict = parse_verdict(F.col("raw"))
    return read(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).select("doc_id", verdict["pass"].alias("pass"), verdict["reason"].alias("reason"))
