"""Queries: chunking. Greedy packing is sequential within a document and beyond plain SQL, except where sections fit as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import markdown_lines
from marginalia.operators.chunkers import MAX_TOKENS, STRATEGIES, UNCAPPED, chunk_documents, recursive_split, register_chunker, split_texts, split_to_fit
from marginalia.registry import query
from marginalia.sources.views import MARKDOWN, markdown, read


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(spark, sf_dir).select("policy", "version", markdown_lines(F.col("text")).alias("lines"))


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without the marks of headings only: emphasis within texts has a query of its own."""
    plain = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "^#+ ", ""), r"^\*\*(\d+\.1 Rule\.)\*\*", "$1"))
    return markdown(spark, sf_dir).select("policy", "version", plain.alias("lines"))


_TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
#: leaf (base, t) cut into sentences (words, where a sentence is too long), and greedy packing as a recursion over them.
_PACKED = rf"""sentence AS (SELECT base, unnest(s) AS s, generate_subscripts(s, 1) AS k FROM (SELECT base, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS s FROM leaf WHERE {_TOKENS.format('t')} > {MAX_TOKENS})),
unit AS (SELECT base, k, 0 AS j, s AS u, {_TOKENS.format('s')} AS size, false AS word FROM sentence WHERE {_TOKENS.format('s')} <= {MAX_TOKENS}
  UNION ALL SELECT base, k, j, u, greatest({_TOKENS.format('u')}, 1), true FROM (SELECT base, k, unnest(w) AS u, generate_subscripts(w, 1) AS j FROM (SELECT base, k, string_split(regexp_replace(s, '\s+', ' ', 'g'), ' ') AS w FROM sentence WHERE {_TOKENS.format('s')} > {MAX_TOKENS}))),
ordered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k, j) AS i FROM unit),
packed AS (SELECT base, i, u, size AS cur, word, 1 AS piece FROM ordered WHERE i = 1
  UNION ALL SELECT o.base, o.i, o.u, CASE WHEN opens THEN o.size ELSE cur + o.size END, o.word, piece + CAST(opens AS INTEGER) FROM (SELECT o.*, p.cur, p.piece,
    CASE WHEN NOT o.word THEN p.word OR p.cur + o.size > {MAX_TOKENS} ELSE o.j = 1 OR p.cur >= {MAX_TOKENS} END AS opens FROM packed p JOIN ordered o ON o.base = p.base AND o.i = p.i + 1) o),
pieces AS (SELECT base, piece, string_agg(u, ' ' ORDER BY i) AS text FROM packed GROUP BY ALL UNION ALL SELECT base, 1, t FROM leaf WHERE {_TOKENS.format('t')} <= {MAX_TOKENS})"""
#: The squeezed texts of leaf sections.
_LEAVES = rf"""leaf AS (SELECT policy || '|' || version || '|' || CAST(n AS VARCHAR) || '. Section ' || CAST(n AS VARCHAR) || ' > ' || CAST(n AS VARCHAR) || '.1 Rule' AS base,
  trim(regexp_replace(replace(text, chr(10), ' ') || CASE WHEN n % 5 = 0 THEN ' | a | b | | --- | --- | | 1 | 2 | - first point - second point' ELSE '' END, '\s+', ' ', 'g')) AS t FROM numbered)"""


@query(f"""WITH RECURSIVE leaf AS (SELECT doc_id AS base, text AS t FROM documents WHERE text IS NOT NULL), {_PACKED}
SELECT base AS id, CAST(piece AS INTEGER) AS piece_no, text AS piece, CAST(CASE WHEN text = '' THEN 0 ELSE greatest({_TOKENS.format('text')}, 1) END AS INTEGER) AS tokens FROM pieces""")
def chunk_split_to_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(read(spark, sf_dir, "documents"), "doc_id", "text", lambda t: split_to_fit(t, MAX_TOKENS))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(read(spark, sf_dir, "documents"), "doc_id", "text", recursive_split)



def _sections(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per section: long ones are in several chunks, numbered after the first."""
    return rows.select(F.regexp_replace("id", r" #\d+$", "").alias("id"), *columns).distinct()


@query(f"""WITH {MARKDOWN} SELECT policy || '|' || version || '|' || CAST(n AS VARCHAR) || '. Section ' || CAST(n AS VARCHAR) || CASE k WHEN 1 THEN ' > ' || CAST(n AS VARCHAR) || '.1 Rule' ELSE '' END AS id, policy, version,
  CAST(n AS VARCHAR) || '. Section ' || CAST(n AS VARCHAR) AS section, k = 1 AS embed FROM numbered CROSS JOIN (SELECT unnest([0, 1]) AS k)""")
def chunk_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["policy", "version", "section", "embed"]
    return _sections(chunk_documents(_documents(spark, sf_dir), "structural", columns=["id", *columns]), *columns)


@query(f"""WITH {MARKDOWN} SELECT policy || '|' || version || '|' || CAST(n AS VARCHAR) || '. Section ' || CAST(n AS VARCHAR) || ' > ' || CAST(n AS VARCHAR) || '.1 Rule' AS id,
  policy || '|' || version || '|' || CAST(n AS VARCHAR) || '. Section ' || CAST(n AS VARCHAR) AS parent_id FROM numbered""")
def chunk_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(chunk_documents(_documents(spark, sf_dir), "parent_child", columns=["id", "parent_id"]), "parent_id")


@query(f"WITH RECURSIVE {MARKDOWN}, {_LEAVES}, {_PACKED} SELECT base || CASE WHEN piece > 1 THEN ' #' || CAST(piece AS VARCHAR) ELSE '' END AS id, text, {_TOKENS.format('text')} AS tokens FROM pieces")
def chunk_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all leaf chunks, long sections cut, by a table function that SQL calls for each document."""
    docs = _plain(spark, sf_dir)
    return spark.sql(f"SELECT c.id, c.text, CAST(c.tokens AS BIGINT) AS tokens FROM {{docs}} d, LATERAL {register_chunker(spark)}(d.policy, d.version, d.lines, 'parent_child') c", docs=docs)


@query(f"""WITH RECURSIVE {MARKDOWN}, {_LEAVES}, {_PACKED},
whole AS (SELECT base, t, split_part(base, '|', 1) || ' v' || split_part(base, '|', 2) AS name, split_part(base, '|', 3) AS path FROM leaf)
SELECT p.base || CASE WHEN piece > 1 THEN ' #' || CAST(piece AS VARCHAR) ELSE '' END AS id, 'Document: ' || name || ' (' || name || ')' || chr(10) || 'Section: ' || path || chr(10) || p.text AS embed_text,
  split_part(path, ' > ', 1) || chr(10) || split_part(path, ' > ', 2) || '. ' || t AS parent_text FROM pieces p JOIN whole w ON w.base = p.base""")
def chunk_contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded for a chunk: its document, section and text; and the whole section's text."""
    return chunk_documents(_plain(spark, sf_dir), "contextual", columns=["id", "embed_text", "parent_text"])


_EXTRA = " CASE WHEN n % 5 = 0 THEN ' | a | b | | --- | --- | | 1 | 2 | - first point - second point' ELSE '' END"


@query(f"""WITH RECURSIVE {MARKDOWN}, {_LEAVES.replace(" ||" + _EXTRA, "")}, {_PACKED},
counted AS (SELECT *, max(piece) OVER (PARTITION BY base) AS last FROM pieces),
fifth AS (SELECT DISTINCT c.base, c.last FROM counted c JOIN numbered n ON n.n % 5 = 0 AND c.base = n.policy || '|' || n.version || '|' || CAST(n.n AS VARCHAR) || '. Section ' || CAST(n.n AS VARCHAR) || ' > ' || CAST(n.n AS VARCHAR) || '.1 Rule'),
runs AS (SELECT base, piece, 'text' AS content_type, text FROM counted UNION ALL SELECT base, last + 1, 'table', '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' FROM fifth UNION ALL SELECT base, last + 2, 'list', '- first point' || chr(10) || '- second point' FROM fifth)
SELECT base || CASE WHEN piece > 1 THEN ' #' || CAST(piece AS VARCHAR) ELSE '' END AS id, content_type, text, CAST({_TOKENS.format('text')} AS INTEGER) AS tokens FROM runs""")
def chunk_table_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and lists stay whole, text between them is cut."""
    return chunk_documents(_plain(spark, sf_dir), "table_aware", columns=["id", "content_type", "text", "tokens"])


@query()
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per strategy: documents, embedded chunks, mean and largest size, tables, lists, chunks with a parent's text."""
    # documents are put together once, for all strategies, and no text is passed on
    rows = chunk_documents(_documents(spark, sf_dir), list(STRATEGIES), columns=["strategy", "policy", "version", "embed", "content_type", "tokens", "has_parent"]).where("embed")
    return rows.groupBy("strategy").agg(
        F.countDistinct("policy", "version").alias("docs"), F.count(F.lit(1)).alias("chunks"), F.round(F.avg("tokens"), 3).alias("mean_tokens"), F.max("tokens").alias("max_tokens"),
        F.count_if(F.col("content_type") == "table").alias("tables"), F.count_if(F.col("content_type") == "list").alias("lists"), F.count_if("has_parent").alias("with_parent"),
    )


@query(f"""WITH {MARKDOWN}, {_LEAVES} SELECT base AS id, t AS text FROM leaf""")
def chunk_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as they are, however long: the plain chunker that the others are measured against."""
    return chunk_documents(_plain(spark, sf_dir), "structural", UNCAPPED, ["id", "section", "heading_path", "text"]).where("heading_path <> section").select("id", "text")
