"""Queries: text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.registry import query
from marginalia.sources.views import CHUNKS, CLAUSES, MARKDOWN, QUESTIONS, chunks, clauses, markdown, questions, read

STEM = "CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END"


def tokens_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: {STEM})"


def _array(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query(f"SELECT doc_id, len(t) AS n, array_to_string(list_sort(list_distinct(t)), ' ') AS terms FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokenize_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(F.sort_array(F.array_distinct(t)), " ").alias("terms"))


@query(r"SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]')), 1) END AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query(r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS n FROM documents""")
def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@query("""WITH v AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 12 AS VARCHAR) AS version, p_brand, p_size, p_partkey % 12 AS minor FROM part)
SELECT p_brand, version, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, minor, p_partkey) AS n, p_partkey FROM v""")
def version_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 12).cast("string")).alias("version"))
    return rows.select("p_brand", "version", F.row_number().over(Window.partitionBy("p_brand").orderBy(T.version_key(F.col("version")), "p_partkey")).cast("long").alias("n"), "p_partkey")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.0' WHEN 1 THEN CAST(p_size AS VARCHAR) || '.0' WHEN 2 THEN CAST(p_size AS VARCHAR) || '.5' ELSE '' END AS version FROM part""")
def normalize_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = F.when(n == 0, F.concat(F.lit(" V"), s, F.lit(" "))).when(n == 1, s).when(n == 2, F.concat(F.lit("vv"), s, F.lit(".5"))).otherwise("  ")
    return read(spark, sf_dir, "part").select("p_partkey", T.normalize_version(raw).alias("version"))


@query(f"WITH {QUESTIONS} SELECT id, CAST(1 + id % 3 AS VARCHAR) || '.0,' || CAST(1 + (id + 1) % 3 AS VARCHAR) || '.0' AS versions FROM questions")
def mentioned_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.mentioned_versions(F.col("question"), F.array(F.lit("1.0"), F.lit("2.0"), F.lit("3.0")))
    return questions(spark, sf_dir).select("id", F.array_join(found, ",").alias("versions"))


@query(f"""WITH {CHUNKS} SELECT id, CASE id % 5 WHEN 0 THEN effective_from WHEN 4 THEN (CASE WHEN effective_from < '2026-02-01' THEN left(effective_from, 7) || '-01' END)
  WHEN 3 THEN '2025-06-01' ELSE effective_from END AS day FROM chunks""")
def mentioned_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("effective_from")
    n = F.col("id") % 5
    asked = (
        F.when(n == 0, F.concat(F.lit("Rule on "), "effective_from"))
        .when(n == 1, F.concat(F.lit("on "), F.date_format(d, "MMMM d"), F.lit("th, "), F.date_format(d, "yyyy")))
        .when(n == 2, F.concat(F.lit("on "), F.date_format(d, "d MMMM yyyy")))
        .when(n == 3, F.lit("what held last June?"))
        .otherwise(F.concat(F.lit("in "), F.date_format(d, "MMMM yyyy")))
    )
    return chunks(spark, sf_dir).select("id", T.mentioned_date(asked, F.lit("2026-03-01").cast("date")).alias("day"))


@query(f"WITH {CHUNKS} SELECT id, CAST(replace(effective_from, '-', '') AS INTEGER) AS num FROM chunks")
def date_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("id", T.date_number(F.col("effective_from")).alias("num"))


@query(f"""WITH {CLAUSES} SELECT id, CASE WHEN regexp_matches(text, '(?i){T.PROHIBITION}') THEN 'prohibition' WHEN regexp_matches(text, '(?i){T.OBLIGATION}') THEN 'obligation'
  WHEN regexp_matches(text, '(?i){T.PERMISSION}') THEN 'permission' ELSE 'informational' END AS clause FROM clauses""")
def clause_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("id", T.clause_type(F.col("text")).alias("clause"))


@query(rf"""SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS entities FROM (
  SELECT doc_id, list_concat(list_filter({_array(T.GLOSSARY)}, lambda g: contains(lower(t), g)), CASE WHEN doc_id % 3 = 0 THEN ['shrink-inator'] ELSE [] END) AS list_distinct_ordered
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'The Shrink-inator and Norm. ' ELSE '' END || text AS t FROM documents))""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, "The Shrink-inator and Norm. ").otherwise(""), "text")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.entities(t), ",").alias("entities"))


@query(rf"""WITH {QUESTIONS}, l AS (SELECT id, lower(question) AS q FROM questions)
SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(q, '\b20\d\d-\d\d-\d\d\b'), list_transform(regexp_extract_all(q, '\bv(?:ersion)?\s*\.?\s*(\d+(?:\.\d+)?)\b', 1), lambda v: 'v' || v)),
  list_filter(regexp_extract_all(q, '[a-z0-9]+(?:\.[0-9]+)?'), lambda w: NOT list_contains({_array(T.CACHE_STOP)}, w))))), ' ') AS tokens FROM l""")
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("id", F.array_join(T.content_tokens(F.col("question")), " ").alias("tokens"))


@query(f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'),
  lambda w: regexp_matches(w, '[0-9]') OR (length(w) > 2 AND NOT list_contains({_array(T.CITE_STOP)}, w))))), ' ') AS words FROM conversations""")
def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.content_words(F.col("text")), " ").alias("words"))


@query("""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x') || '|' || coalesce(nullif(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x')
  || '|' || sha1(CAST(p_partkey AS VARCHAR)) AS vector_id FROM part""")
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", T.slug(F.col("p_name")), T.slug(F.col("p_brand")), F.sha1(F.col("p_partkey").cast("string"))).alias("vector_id"))


_MD = r"""lines AS (SELECT policy, version, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM markdown),
cleaned AS (SELECT policy, version, i, raw, CASE WHEN starts_with(ltrim(l), '|') THEN l ELSE regexp_replace(regexp_replace(l, '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g') END AS line
  FROM (SELECT *, regexp_replace(regexp_replace(raw, '\s+$', ''), '^#{1,6}\s+', '') AS l FROM lines)), kept AS (SELECT * FROM cleaned WHERE trim(line) NOT IN ('---', '***'))"""


@query(rf"WITH {MARKDOWN}, {_MD} SELECT policy, version, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT regexp_matches(raw, '[*_]')), '')) AS digest, count(*) AS n FROM kept GROUP BY policy, version")
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, and a digest of those that have no emphasis marks, whose rule is beyond this SQL's patterns (tests have it)."""
    unmarked = F.array_join(T.markdown_lines(F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike("[*_]")), "\n")), "\n")
    return markdown(spark, sf_dir).select("policy", "version", F.md5(unmarked).alias("digest"), F.size(T.markdown_lines(F.col("text"))).cast("long").alias("n"))


@query(rf"""WITH {MARKDOWN}, {_MD}, headed AS (SELECT *, regexp_extract(line, '^\s*(\d+(?:\.\d+)+)\.?\s+(\S.*)$', 1) AS sub, trim(regexp_extract(line, '^\s*(\d+)\.\s+(\S.*)$', 2)) AS rest FROM kept),
levels AS (SELECT policy, version, CASE WHEN sub <> '' THEN length(sub) - length(replace(sub, '.', '')) + 1
  WHEN rest <> '' AND NOT regexp_matches(split_part(rest, '. ', 1), '[.!?]$') AND len(regexp_split_to_array(trim(split_part(rest, '. ', 1)), '\s+')) <= 12 THEN 1 END AS level FROM headed)
SELECT policy, version, CAST(level AS INTEGER) AS level, count(*) AS n FROM levels WHERE level IS NOT NULL GROUP BY ALL""")
def heading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = markdown(spark, sf_dir).select("policy", "version", F.explode(T.markdown_lines(F.col("text"))).alias("line"))
    return rows.withColumn("level", T.heading_level(F.col("line"))).where("level IS NOT NULL").groupBy("policy", "version", "level").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CHUNKS} SELECT id, CASE WHEN id % 4 IN (0, 3) THEN 'lookup' ELSE 'compare' END AS kind, CASE WHEN id % 4 = 3 THEN NULL ELSE policy END AS policy, CASE WHEN id % 4 = 3 THEN NULL ELSE version END AS version FROM chunks""")
def parse_route_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A router's reply: JSON, bare or in a fence; anything else is a plain lookup."""
    n = F.col("id") % 4
    body = F.to_json(F.struct(F.when(n == 0, "lookup").otherwise("compare").alias("kind"), "policy", "version"))
    raw = F.when(n == 3, "I think it is {broken").when(n == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    d = F.from_json(F.regexp_extract("raw", r"(?s)(\{.*\})", 1), "kind string, policy string, version string")
    rows = chunks(spark, sf_dir).select("id", raw.alias("raw")).withColumn("d", d)
    kind = F.when(F.col("d.kind").isin("lookup", "compare"), F.col("d.kind")).otherwise("lookup")
    return rows.select("id", kind.alias("kind"), "d.policy", "d.version")


@query(f"""WITH {CHUNKS} SELECT id, CASE WHEN classification = 'top-secret' THEN '[redacted: top-secret]' ELSE regexp_replace(text || ' abcdef xabcdef', '\\babcdef\\b', '[access-phrase]', 'g') END AS text FROM chunks""")
def redact_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.col("text"), F.lit(" abcdef xabcdef"))
    return chunks(spark, sf_dir).select("id", T.redact(said, F.col("classification"), "abcdef").alias("text"))
