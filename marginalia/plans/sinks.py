"""Queries: what is written as JSON and read back, and catalogs in prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.router import parse_catalog
from marginalia.registry import query
from marginalia.sources.shared import fresh
from marginalia.sources.views import CHUNKS, chunks, read
from marginalia.sources.votes import append_votes, export_json, judged_votes, read_votes, snapshots

_CLASS = "CASE turn % 7 WHEN 3 THEN 'top-secret' WHEN 5 THEN NULL ELSE 'public' END"


@query(f"""WITH a AS (SELECT conv_id || '-' || turn AS trace_id, turn, text, {_CLASS} AS c FROM conversations WHERE role = 'assistant')
SELECT trace_id, CASE WHEN coalesce(c, 'top-secret') = 'top-secret' THEN '[redacted: top-secret]' ELSE text || ' [access-phrase] xabcdef' END AS answer, false AS cached,
  CASE WHEN turn < 4 THEN 'up' ELSE 'down' END AS vote, CASE WHEN turn < 4 THEN 'said [access-phrase]' ELSE '' END AS note FROM a WHERE turn <> 1""")
def feedback_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on assistants' turns, appended in two calls; those on turn 1 are neither up nor down, those of users rate no answer."""
    rows = read(spark, sf_dir, "conversations").withColumn("trace_id", F.concat_ws("-", "conv_id", "turn"))
    answers = rows.where("role = 'assistant'").select("trace_id", F.concat("text", F.lit(" abcdef xabcdef")).alias("answer"), F.expr(_CLASS).alias("classification"))
    votes = rows.select("trace_id", F.expr("CASE WHEN turn = 1 THEN 'maybe' WHEN turn < 4 THEN 'up' ELSE 'down' END").alias("vote"), F.expr("CASE WHEN turn < 4 THEN 'said abcdef' END").alias("note"))
    at, judged = fresh(spark), judged_votes(votes, snapshots(answers, "abcdef"), "abcdef")
    for side in ("up", "down"):
        append_votes(judged.where(F.coalesce(F.col("vote") == side, F.lit(True))), at)
    return read_votes(spark, at).where("_corrupt IS NULL").select("trace_id", "answer", "cached", "vote", "note")


@query(f"WITH {CHUNKS} SELECT id, policy, version, text, classification FROM chunks")
def chunk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, at = chunks(spark, sf_dir).select("id", "policy", "version", "text", "classification"), fresh(spark)
    export_json(rows, at)
    return spark.read.schema(rows.schema).json(at)


@query("SELECT DISTINCT CAST(doc_id AS VARCHAR) || ' ' || source || ': all' AS policy, unnest([lang, '2.0']) AS version, doc_id FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def prompt_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A router's prompt for each document, with a catalog of one policy whose name holds the separator."""
    rows = read(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    prompt = F.concat(F.lit("Pick one: a\n\nCatalog:\n"), F.col("doc_id").cast("string"), F.lit(" "), "source", F.lit(": all: "), "lang", F.lit(" ,2.0\nno versions here\n\nExamples:\nP: 9.9"))
    found = rows.select("doc_id", F.explode(parse_catalog(prompt)).alias("policy", "versions"))
    return found.select("doc_id", "policy", F.explode("versions").alias("version"))
