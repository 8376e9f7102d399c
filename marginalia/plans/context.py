"""Queries: indexed texts, prompt blocks, scopes by raw names, answer checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.filters import base_filter, compile_filter
from marginalia.operators import context as C
from marginalia.plans.versions import _KEY
from marginalia.registry import query
from marginalia.sources.views import CHUNKS, QUESTIONS, chunks, questions, read


def _parent() -> Column:
    i = F.col("id") % 3
    return F.when(i == 0, F.concat("heading_path", F.lit(": "), "text")).when(i == 1, F.col("text"))


@query(f"WITH {CHUNKS} SELECT id, CASE WHEN id % 5 = 0 THEN department || ' ' || text ELSE heading_path || chr(10) || text END AS keyword_text FROM chunks")
def keyword_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = F.when(F.col("id") % 5 == 0, F.concat("department", F.lit(" "), "text")).when(F.col("id") % 5 == 1, "")
    return chunks(spark, sf_dir).select("id", C.keyword_text(embedded, F.col("heading_path"), F.col("text")).alias("keyword_text"))


@query(f"""WITH {CHUNKS} SELECT id, policy || ' ' || version || ' ' || heading_path || chr(10) || CASE WHEN id % 3 = 0 THEN heading_path || ': ' || text ELSE text END AS block,
  CASE WHEN id % 3 = 0 THEN heading_path || ': ' || text END AS context_text FROM chunks""")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the text of their section where that says more, as a prompt shows them."""
    rows = chunks(spark, sf_dir).withColumn("parent_text", _parent()).withColumn("context_text", C.with_context(F.col("text"), F.col("parent_text")))
    block = C.chunk_block(*(F.col(c) for c in ("policy", "version", "heading_path", "text", "context_text")))
    return C.public(rows.select("id", block.alias("block"), "context_text", "parent_text"))


@query(f"""WITH {CHUNKS} SELECT coalesce(n.policy, o.policy) AS policy, coalesce(n.id, -1) AS current_id, coalesce(o.id, -1) AS previous_id,
  coalesce(n.policy, o.policy) || ' ' || coalesce(n.heading_path, o.heading_path) || chr(10) || CASE WHEN n.id IS NULL THEN 'current' ELSE 'current 2.0' || chr(10) || n.text END || chr(10) ||
  CASE WHEN o.id IS NULL THEN 'previous' ELSE 'previous 1.0' || chr(10) || o.text END AS block
FROM (SELECT * FROM chunks WHERE version = '2.0') n FULL JOIN (SELECT * FROM chunks WHERE version = '1.0') o ON n.policy = o.policy AND n.heading_path = o.heading_path AND n.id = o.id + 1""")
def comparison_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of each section of versions 1.0 and 2.0; a missing one leaves its label."""
    side = lambda v, name, shift: chunks(spark, sf_dir).where(F.col("version") == v).select("policy", "heading_path", (F.col("id") + shift).alias("place"), F.struct("id", "version", "text").alias(name))
    rows = side("2.0", "current", 0).join(side("1.0", "previous", 1), ["policy", "heading_path", "place"], "full_outer")
    block = C.pair_block(*(F.col(c) for c in ("policy", "heading_path", "current", "previous")))
    return rows.select("policy", F.coalesce("current.id", F.lit(-1)).alias("current_id"), F.coalesce("previous.id", F.lit(-1)).alias("previous_id"), block.alias("block"))


_ALIAS = "entries AS (SELECT DISTINCT 'group ' || CAST(CAST(substr(policy, 4) AS INTEGER) % 3 AS VARCHAR) AS policy, policy AS raw_policy FROM chunks)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = (F.substring("policy", 4, 9).cast("int") % 3).cast("string")
    return chunks(spark, sf_dir).select(F.concat(F.lit("group "), group).alias("policy"), F.col("policy").alias("raw_policy")).distinct()


@query(f"WITH {CHUNKS}, {_ALIAS} SELECT policy, array_to_string(list_sort(list(raw_policy)), ' ') AS raws FROM entries GROUP BY policy")
def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.raw_names(_entries(spark, sf_dir)).select("policy", F.array_join("raws", " ").alias("raws"))


@query(f"""WITH {CHUNKS}, {_ALIAS}, pairs AS (SELECT 'group 1' AS policy, '1.0' AS version UNION ALL SELECT 'group 2', '3.0' UNION ALL SELECT 'src3', '2.0')
SELECT id, policy, version FROM chunks c WHERE EXISTS (SELECT 1 FROM pairs p LEFT JOIN entries e ON e.policy = p.policy WHERE coalesce(e.raw_policy, p.policy) = c.policy AND p.version = c.version)""")
def pair_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of (canonical policy, version) pairs, by a semi join with their raw names."""
    pairs = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(v).alias("version")) for p, v in (("group 1", "1.0"), ("group 2", "3.0"), ("src3", "2.0"))])).alias("x")).select("x.*")
    return C.pair_filter(chunks(spark, sf_dir), pairs, _entries(spark, sf_dir)).select("id", "policy", "version")


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE classification IN ('public', 'internal') AND status = 'active' AND department IN ('de', 'fr') AND policy = 'src2'")
def filter_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = base_filter("default", {"department": ["de", "fr"], "policy": "src2", "clause_type": None}, active_only=True, fields=("department", "clause_type", "policy"))
    return chunks(spark, sf_dir).where(compile_filter(where)).select("id")


@query(f"WITH {CHUNKS} SELECT policy, version, min(added) AS added FROM (SELECT policy, version, 0 AS added FROM chunks WHERE status = 'retired' UNION ALL SELECT policy, version, 1 FROM chunks WHERE department = 'en') GROUP BY ALL")
def scope_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return C.widen(rows.where("status = 'retired'"), rows.where("department = 'en'"), ["policy", "version"])


@query("SELECT l_orderkey, bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') AS both FROM lineitem GROUP BY l_orderkey")
def subset_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("got"))
    return flags.select("l_orderkey", C.subset(F.array(F.lit("A"), F.lit("R")), F.col("got")).alias("both"))


@query(f"""WITH {QUESTIONS}, k AS (SELECT id, question, {_KEY} AS key FROM questions)
SELECT a.id, CASE WHEN a.id % 7 = 0 AND b.question IS NULL THEN true WHEN a.id % 7 = 0 OR b.question IS NULL THEN false ELSE a.key = b.key END AS compatible FROM k a LEFT JOIN k b ON b.id = a.id + 60""")
def compatible_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question against one that was stored 60 ids later; every seventh has no text."""
    asked = questions(spark, sf_dir).select("id", F.when(F.col("id") % 7 != 0, F.col("question")).alias("asked"))
    stored = questions(spark, sf_dir).select((F.col("id") - 60).alias("id"), F.col("question").alias("stored"))
    return asked.join(stored, "id", "left").select("id", C.questions_compatible(F.col("asked"), F.col("stored")).alias("compatible"))


@query("SELECT p_partkey, round(p_retailprice / 2500, 4) < 0.4 OR (p_size % 3 <> 0 AND round(p_size / 50.0, 4) < 0.3) AS low FROM part")
def low_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rerank = F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 50.0)
    return read(spark, sf_dir, "part").select("p_partkey", C.is_low(F.col("p_retailprice") / 2500, rerank, 0.4, 0.3).alias("low"))


@query(r"SELECT doc_id, regexp_matches(' ' || lower(text) || ' ', '[^a-z0-9]all[\s-]+rights[\s-]+reserved[^a-z0-9]') AND NOT regexp_matches(' ' || lower(text) || ' ', '[^a-z0-9]the[\s-]+of[^a-z0-9]') AS ok FROM documents")
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit("all").alias("who"), F.lit(k).alias("kind"), F.lit(p).alias("phrase")) for k, p in (("required", "all rights reserved"), ("banned", "the of"))])))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.lit("all").alias("who"))
    return C.answer_ok(docs, phrases, "doc_id", "text", "who")


@query(f"WITH {CHUNKS} SELECT id, id % 2 = 0 OR (id % 3 + 1) = 2 AS ok FROM chunks")
def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite their own chunk, or version 2.0 of its policy, against their own chunk."""
    said = F.when(F.col("id") % 2 == 0, F.col("version")).otherwise("2.0")
    answer = F.concat("text", F.lit("\n\n"), "policy", F.lit(" "), said, F.lit(", "), "heading_path", F.lit("\nother 9.9, end"))
    wanted = F.array(F.concat_ws("|", "policy", "version", "heading_path"))
    return chunks(spark, sf_dir).select("id", C.citation_ok(answer, wanted).alias("ok"))


@query("SELECT round(coalesce(sum(value), 0), 4) AS seconds FROM events WHERE event_type IN ('click', 'view', 'none such')")
def step_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.step_seconds(read(spark, sf_dir, "events"), "event_type", "value", ["click", "view", "none such"]).select(F.round("seconds", 4).alias("seconds"))


@query("SELECT p_brand, round(coalesce(avg(CASE WHEN p_size > 48 THEN p_retailprice END), 0), 6) AS mean FROM part GROUP BY p_brand")
def mean_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(C.mean(F.when(F.col("p_size") > 48, F.col("p_retailprice"))), 6).alias("mean"))
