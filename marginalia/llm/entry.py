"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import table
from marginalia.llm.debruijn_dedup import debruijn_dedup
from marginalia.llm.decontaminate import contamination
from marginalia.llm.html_text import extract_text
from marginalia.llm.langid import language_id
from marginalia.llm.lexical_search import SQL as OP13_SQL
from marginalia.llm.lexical_search import lexical_search
from marginalia.llm.line_dedup import LEAST_PAGES, RATIO, line_dedup
from marginalia.llm.near_dedup import near_dedup
from marginalia.llm.packing import encoder, pack
from marginalia.llm.quality import SQL as OP5_SQL
from marginalia.llm.quality import quality_verdicts
from marginalia.llm.sentencepieces import encode
from marginalia.llm.suffix_dedup import suffix_dedup
from marginalia.llm.url_templates import SQL as OP10_SQL
from marginalia.llm.url_templates import url_verdicts
from marginalia.llm.whitening import whiten

#: The tokenizer file of op12: the vocabulary that the public_tokenizers package, installed on every machine, calls byte_bpe_50k.json.
BYTE_BPE = "byte_bpe_50k.json"


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False, check=True)
    return tokens.select("doc_id", F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_ids"), "ids", "lossless")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn_dedup(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs, counts=True)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), functools.partial(encoder, public_tokenizers.path(BYTE_BPE)))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS page, doc_id, source, text FROM documents),
lines AS (
  SELECT page, source, i, line, trim(line, ' ' || chr(9) || chr(13)) AS own
  FROM (SELECT page, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pages)
),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
counted AS (SELECT source, own, count(DISTINCT page) AS n FROM lines WHERE own <> '' GROUP BY source, own),
bad AS (SELECT c.source, c.own FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE c.n >= {LEAST_PAGES} AND c.n > CAST({RATIO} AS DOUBLE) * t.pages),
marked AS (SELECT l.*, b.own IS NOT NULL AS dropped FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.own = b.own),
cut AS (
  SELECT page, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '') AS text,
         count(*) FILTER (WHERE own <> '') AS n_lines, count(*) FILTER (WHERE dropped) AS n_removed FROM marked GROUP BY page
)
SELECT p.doc_id, p.source, CASE WHEN p.text IS NOT NULL THEN c.text END AS text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed
FROM pages p LEFT JOIN cut c ON p.page = c.page
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_html_extraction": op2_html_extraction,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_rules": op5_quality_rules,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}

SQL: dict[str, str] = {"op5_quality_rules": OP5_SQL, "op9_line_dedup": OP9_SQL, "op10_url_filters": OP10_SQL, "op13_ranked_lexical_search": OP13_SQL}
