"""Queries: scans, catalog, filters and access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.filters import access_filter, compile_filter, visible
from marginalia.functions.text import version_key
from marginalia.registry import query
from marginalia.sources.views import CHUNKS, chunks, read

PICK = ["id", "policy", "version", "heading_path"]


def _chunk_query(name: str, where, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunks(spark, sf_dir).where(compile_filter(where) if isinstance(where, dict) else where()).select(*PICK)

    run.__name__ = name
    query(f"WITH {CHUNKS} SELECT id, policy, version, heading_path FROM chunks WHERE {sql}")(run)


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents")
def scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'de' AND n_chars > 2000")
def scan_prune_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where((F.col("lang") == "de") & (F.col("n_chars") > 2000)).select("doc_id", "source")


@query(f"""WITH {CHUNKS} SELECT policy, version, arg_min(department, id) AS department, arg_min(classification, id) AS classification, arg_min(status, id) AS status,
  arg_min(effective_from, id) AS effective_from, count(*) AS chunks FROM chunks GROUP BY policy, version""")
def catalog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min_by(F.struct("department", "classification", "status", "effective_from"), "id").alias("f")
    return chunks(spark, sf_dir).groupBy("policy", "version").agg(first, F.count(F.lit(1)).alias("chunks")).select("policy", "version", "f.*", "chunks")


@query(f"""WITH {CHUNKS} SELECT policy, string_agg(version, ',' ORDER BY version) AS versions, max(version) AS newest
FROM (SELECT DISTINCT policy, version FROM chunks WHERE status = 'active') GROUP BY policy""")
def catalog_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).where("status = 'active'").select("policy", "version").distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(version_key(F.col("version")).alias("k"), "version"))), lambda x: x["version"])
    return rows.groupBy("policy").agg(ordered.alias("v")).select("policy", F.array_join("v", ",").alias("versions"), F.element_at("v", -1).alias("newest"))


@query(f"""WITH {CHUNKS}, lines AS (SELECT policy || '|' || version || '|' || md5(CAST(count(*) AS VARCHAR)) || '|' || arg_min(status, id) AS line FROM chunks GROUP BY policy, version)
SELECT left(sha256(string_agg(line, chr(10) ORDER BY line)), 16) AS corpus_key FROM lines""")
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the catalog, which has one line per document version."""
    rows = chunks(spark, sf_dir).groupBy("policy", "version").agg(F.md5(F.count(F.lit(1)).cast("string")).alias("h"), F.min_by("status", "id").alias("status"))
    lines = rows.select(F.concat_ws("|", "policy", "version", "h", "status").alias("line"))
    return lines.agg(F.left(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256), F.lit(16)).alias("corpus_key"))


@query("""SELECT d.doc_id, coalesce(l.quality, 1) AS quality, CASE WHEN coalesce(l.toxic, 0) = 1 OR contains(upper(d.text), 'TOP SECRET') THEN 'top-secret' ELSE 'internal' END AS classification
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def manifest_defaults_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    secret = (F.coalesce("toxic", F.lit(0)) == 1) | F.contains(F.upper("text"), F.lit("TOP SECRET"))
    return d.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(1)).alias("quality"), F.when(secret, "top-secret").otherwise("internal").alias("classification"))


@query("""WITH f AS (SELECT page_id, 'Corp - ' || regexp_extract(url, '://([^/?#]*)', 1) || ' v' || CAST(page_id % 3 + 1 AS VARCHAR) || CASE WHEN page_id % 4 = 0 THEN '.x' ELSE '.0' END || '.md' AS file FROM pages)
SELECT page_id, regexp_matches(file, '^.* - .+ v[0-9]+(\\.[0-9]+)*\\.(pdf|docx|md)$') AS ok, regexp_extract(file, '^.* - (.+) v([0-9]+(\\.[0-9]+)*)\\.(pdf|docx|md)$', 1) AS policy,
  regexp_extract(file, '^.* - (.+) v([0-9]+(\\.[0-9]+)*)\\.(pdf|docx|md)$', 2) AS version FROM f""")
def filename_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.sources.files import CONTRACT

    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    name = F.concat(F.lit("Corp - "), host, F.lit(" v"), (F.col("page_id") % 3 + 1).cast("string"), F.when(F.col("page_id") % 4 == 0, ".x").otherwise(".0"), F.lit(".md"))
    rows = read(spark, sf_dir, "pages").select("page_id", name.alias("file"))
    return rows.select("page_id", F.col("file").rlike(CONTRACT).alias("ok"), F.regexp_extract("file", CONTRACT, 1).alias("policy"), F.regexp_extract("file", CONTRACT, 2).alias("version"))


_chunk_query("filter_eq", {"policy": "src3", "department": {"$eq": "en"}}, "policy = 'src3' AND department = 'en'")
_chunk_query("filter_in", {"version": {"$in": ["1.0", "3.0"]}}, "version IN ('1.0', '3.0')")
_chunk_query("filter_range", {"effective_from": {"$gte": "2025-01-01", "$lt": "2026-01-01"}}, "effective_from >= '2025-01-01' AND effective_from < '2026-01-01'")
_chunk_query("filter_or_pairs", {"$or": [{"policy": "src1", "version": "1.0"}, {"policy": "src2", "version": "3.0"}]}, "(policy = 'src1' AND version = '1.0') OR (policy = 'src2' AND version = '3.0')")
_chunk_query(
    "filter_and_nested", {"$and": [{"status": "active"}, {"$or": [{"department": "fr"}, {"classification": {"$ne": "public"}}]}, {"$or": []}]},
    "status = 'active' AND (department = 'fr' OR classification <> 'public')",
)
_chunk_query("access_default", access_filter("default"), "classification IN ('public', 'internal')")
_chunk_query("access_restricted", access_filter("restricted"), "classification IN ('public', 'internal', 'top-secret')")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM 1")
def filter_ne_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).where(compile_filter({"quality": {"$ne": 1}})).select("doc_id")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(l.quality IN (1), false)")
def filter_nin_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).where(compile_filter({"quality": {"$nin": [1]}})).select("doc_id")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE CASE WHEN l.toxic = 1 THEN 'top-secret' WHEN l.toxic = 0 THEN 'public' END IN ('public', 'internal')")
def visible_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "top-secret").when(F.col("toxic") == 0, "public")
    return _labelled(spark, sf_dir).where(visible(kind, "default")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thing')")
def entity_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("thing"))).select("doc_id")
