"""The tables as a handbook: deterministic projections, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    i = F.col("doc_id")
    return d.join(labels, "doc_id", "left").select(
        i.alias("id"), F.col("source").alias("policy"), F.concat((i % 3 + 1).cast("string"), F.lit(".0")).alias("version"),
        F.concat(F.lit("S"), (F.floor(i / 60) + i % 3).cast("string")).alias("heading_path"), F.col("lang").alias("department"), "text",
        F.when(F.col("toxic") == 1, "top-secret").when(F.floor(i / 20) % 2 == 0, "public").otherwise("internal").alias("classification"),
        F.when(F.col("quality") == 0, "retired").otherwise("active").alias("status"),
        F.when(i % 3 == 0, "2024-01-08").when(i % 3 == 1, "2025-02-03").otherwise("2026-01-05").alias("effective_from"),
    )


CHUNKS = """chunks AS (
  SELECT d.doc_id AS id, d.source AS policy, CAST(d.doc_id % 3 + 1 AS VARCHAR) || '.0' AS version,
         'S' || CAST(d.doc_id // 60 + d.doc_id % 3 AS VARCHAR) AS heading_path, d.lang AS department, d.text,
         CASE WHEN l.toxic = 1 THEN 'top-secret' WHEN (d.doc_id // 20) % 2 = 0 THEN 'public' ELSE 'internal' END AS classification,
         CASE WHEN l.quality = 0 THEN 'retired' ELSE 'active' END AS status,
         CASE d.doc_id % 3 WHEN 0 THEN '2024-01-08' WHEN 1 THEN '2025-02-03' ELSE '2026-01-05' END AS effective_from
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return chunks(spark, sf_dir).select("id", "policy", "effective_from", F.concat(F.lit("What changed in "), "policy", F.lit(" between v"), (1 + i % 3).cast("string"), F.lit(" and version "), (1 + (i + 1) % 3).cast("string"), F.lit(".0 on "), "effective_from", F.lit("?")).alias("question"))


QUESTIONS = CHUNKS + """, questions AS (
  SELECT id, policy, effective_from, 'What changed in ' || policy || ' between v' || CAST(1 + id % 3 AS VARCHAR) || ' and version ' ||
         CAST(1 + (id + 1) % 3 AS VARCHAR) || '.0 on ' || effective_from || '?' AS question FROM chunks)"""


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    verb = F.when(i % 4 == 0, "must not").when(i % 4 == 1, "must").when(i % 4 == 2, "may").otherwise("usually")
    return chunks(spark, sf_dir).select("id", F.concat(F.lit("Staff "), verb, F.lit(" do so. "), F.col("text")).alias("text"))


CLAUSES = CHUNKS + """, clauses AS (
  SELECT id, 'Staff ' || CASE id % 4 WHEN 0 THEN 'must not' WHEN 1 THEN 'must' WHEN 2 THEN 'may' ELSE 'usually' END || ' do so. ' || text AS text FROM chunks)"""


#: Ids whose chunks may share a document.
BLOCK = 3000


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per policy, version and block of BLOCK ids (so that none grows with the corpus): a section with a rule per
    chunk, in the order of ids; every fifth has a table and bullets. Null texts have no section."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("policy", "version").orderBy("id"))
    s = F.col("n").cast("string")
    extra = F.when(F.col("n") % 5 == 0, "\n| a | b |\n| --- | --- |\n| 1 | 2 |\n- first point\n- second point").otherwise("")
    part = F.concat(F.lit("## "), s, F.lit(". Section "), s, F.lit("\n**"), s, F.lit(".1 Rule.** "), F.translate("text", "\n", " "), extra)
    block = F.concat("version", F.lit("."), F.floor(F.col("id") / BLOCK).cast("string"))
    rows = chunks(spark, sf_dir).where("text IS NOT NULL").withColumn("version", block).withColumn("n", n).select("policy", "version", "n", part.alias("part"))
    return rows.groupBy("policy", "version").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n").alias("body")).select("policy", "version", F.concat(F.lit("# Corp\n## "), "policy", F.lit(" v"), "version", F.lit("\n"), "body").alias("text"))


MARKDOWN = CHUNKS + f""", blocks AS (SELECT * REPLACE (version || '.' || CAST(id // {BLOCK} AS VARCHAR) AS version) FROM chunks WHERE text IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY policy, version ORDER BY id) AS n FROM blocks),
parts AS (SELECT policy, version, n, '## ' || CAST(n AS VARCHAR) || '. Section ' || CAST(n AS VARCHAR) || chr(10) || '**' || CAST(n AS VARCHAR) || '.1 Rule.** ' ||
  replace(text, chr(10), ' ') || CASE WHEN n % 5 = 0 THEN chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10) || '- first point' || chr(10) || '- second point' ELSE '' END AS part FROM numbered),
markdown AS (SELECT policy, version, '# Corp' || chr(10) || '## ' || policy || ' v' || version || chr(10) || string_agg(part, chr(10) ORDER BY n) AS text FROM parts GROUP BY policy, version)"""
