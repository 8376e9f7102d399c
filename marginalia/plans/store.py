"""Queries: the chunk store, whole incremental loads, administration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import markdown_lines
from marginalia.operators.chunkers import CHUNK
from marginalia.registry import query
from marginalia.sources.load import ingest
from marginalia.sources.shared import fresh
from marginalia.sources.store import ChunkStore
from marginalia.sources.views import CHUNKS, MARKDOWN, chunks, markdown


def _digit() -> Column:
    return F.substring("policy", -1, 1).cast("int")



def _files(spark: SparkSession, sf_dir: str, majors: str, changed: bool) -> DataFrame:
    """Markdown documents of two major versions as files; in a later state, those of odd policies have one more line."""
    docs = markdown(spark, sf_dir).where(F.substring("version", 1, 1).isin(*majors))
    text = F.when((_digit() % 2 == 1) & F.lit(changed), F.concat("text", F.lit("\nAmended."))).otherwise(F.col("text"))
    docs = docs.withColumn("text", text)
    return docs.select(F.concat(F.lit("Corp - "), "policy", F.lit(" v"), "version", F.lit(".md")).alias("file"), "policy", "version", F.sha2("text", 256).alias("file_hash"), markdown_lines(F.col("text")).alias("lines"), F.lit(None).cast("string").alias("reject"))


def _manifest(files: DataFrame, changed: bool) -> DataFrame:
    major = F.substring("version", 1, 1)
    day = F.when(major == "1", "2024-01-08").when(major == "2", "2025-02-03").otherwise("2026-01-05")
    unset = F.lit(None).cast("string")
    department = F.when((_digit() % 4 == 0) & F.lit(changed), "hr")
    return files.select("file", department.alias("department"), unset.alias("doc_type"), unset.alias("classification"), unset.alias("status"), day.alias("effective_from"))


@query(f"""WITH {MARKDOWN}, docs AS (SELECT policy, version, CAST(split_part(version, '.', 1) AS INTEGER) AS major, CAST(split_part(version, '.', 3) AS INTEGER) AS block, CAST(right(policy, 1) AS INTEGER) AS digit FROM markdown),
after AS (SELECT policy, version, max(major * 1000000 + block) OVER (PARTITION BY policy) = major * 1000000 + block AS is_latest,
  coalesce(lead(CASE major WHEN 2 THEN '2025-02-03' ELSE '2026-01-05' END) OVER (PARTITION BY policy ORDER BY major, block), '') AS effective_to, CASE WHEN digit % 4 = 0 THEN 'hr' ELSE 'general' END AS department FROM docs WHERE major > 1),
size AS (SELECT policy, version, count(*) AS sections FROM numbered WHERE n % 5 = 0 OR trim(replace(text, chr(10), ' ')) <> '' GROUP BY ALL)
SELECT d.policy, d.version, CASE WHEN major = 1 THEN 'vanished' WHEN major = 3 THEN 'new' WHEN digit % 2 = 1 THEN 'changed' WHEN digit % 4 = 0 THEN 'metadata' ELSE 'unchanged' END AS action,
  a.is_latest, a.effective_to, a.department, CASE WHEN major > 1 THEN s.sections END AS sections, false AS third_run_writes
FROM docs d LEFT JOIN after a ON a.policy = d.policy AND a.version = d.version LEFT JOIN size s ON s.policy = d.policy AND s.version = d.version""")
def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of all files loaded one after the other, and the second once more: what each document's load did, and the catalog it left."""
    store = ChunkStore(spark, fresh(spark), CHUNK)
    reports = []
    for majors, changed in (("12", False), ("23", True), ("23", True)):
        files = _files(spark, sf_dir, majors, changed)
        reports.append(ingest(store, files, _manifest(files, changed), strict=False))
    sections = store.rows().groupBy("policy", "version").agg(F.countDistinct("section").alias("sections"))
    catalog = store.documents().select("policy", "version", "is_latest", "effective_to", "department").join(sections, ["policy", "version"], "left")
    return reports[1].actions.select("policy", "version", "action").join(catalog, ["policy", "version"], "left").withColumn("third_run_writes", F.lit(reports[2].written))


@query(f"""WITH {CHUNKS}, docs AS (SELECT policy, version, arg_min(effective_from, id) AS effective_from, CASE WHEN policy = 'src3' AND version <> '3.0' THEN 'retired' WHEN policy = 'src5' THEN 'retired' ELSE 'active' END AS status, count(*) AS chunks
  FROM chunks GROUP BY ALL HAVING NOT (policy = 'src1' AND version = '2.0'))
SELECT policy, version, status, chunks, coalesce(lead(effective_from) OVER (PARTITION BY policy ORDER BY version), '') AS effective_to,
  status = 'active' AND version = max(CASE WHEN status = 'active' THEN version END) OVER (PARTITION BY policy) AS is_latest FROM docs""")
def admin_retire_and_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a policy retired, all of another one, and a document purged: the catalog with its lifecycles."""
    store = ChunkStore(spark, fresh(spark), "id long, policy string, version string, text string")
    docs = chunks(spark, sf_dir).groupBy("policy", "version").agg(F.min_by("effective_from", "id").alias("effective_from"), F.count(F.lit(1)).alias("chunks"))
    store.put_documents(docs.withColumn("status", F.lit("active")))
    for policy, version in (("src3", "1.0"), ("src3", "2.0"), ("src5", None)):
        store.set_status(policy, version, "retired")
    store.purge("src1", "2.0")
    return store.documents().select("policy", "version", "status", "chunks", "effective_to", "is_latest")


@query(f"WITH {CHUNKS} SELECT id, policy, version, text FROM chunks WHERE (policy, version) IN (SELECT (policy, version) FROM chunks GROUP BY policy, version HAVING count(*) FILTER (WHERE status = 'retired') = 0) OR (policy = 'src2' AND version = '3.0')")
def store_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a table of documents (here those without a retired chunk, and one more), read from the folders that hold them."""
    store = ChunkStore(spark, fresh(spark), "id long, policy string, version string, text string")
    rows = chunks(spark, sf_dir)
    store.upsert(rows.where("version <> '3.0'"))
    store.upsert(rows.where("version = '3.0'"))
    clean = rows.groupBy("policy", "version").agg(F.count_if(F.col("status") == "retired").alias("n")).where("n = 0")
    one = rows.where("policy = 'src2' AND version = '3.0'")
    return store.pairs(clean.select("policy", "version").unionByName(one.select("policy", "version"))).select("id", "policy", "version", "text")
