"""Queries: the semantic cache over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import words
from marginalia.functions.vectors import hash_vector
from marginalia.operators.cache import semantic_lookup
from marginalia.plans.versions import _KEY
from marginalia.registry import query
from marginalia.sources.views import QUESTIONS, questions

_TTL = 700


@query(f"""WITH {QUESTIONS}, asked AS (SELECT id AS seq, CASE WHEN id % 7 = 0 THEN 'restricted' ELSE 'default' END AS level, id // 500 AS corpus_key,
  CASE id % 3 WHEN 0 THEN question WHEN 1 THEN 'Please: ' || lower(question) ELSE 'Would you please just say: ' || question END AS question FROM questions),
keyed AS (SELECT seq, level, corpus_key, {_KEY} AS key, regexp_extract_all(lower(question), '[a-z0-9]+') AS w FROM asked),
bucket AS (SELECT seq, CAST('0x' || right(md5(w), 2) AS INTEGER) AS b, count(*)::DOUBLE AS c FROM (SELECT seq, unnest(w) AS w FROM keyed) GROUP BY ALL),
vectors AS (SELECT seq, list_transform(range(256), lambda i: coalesce(map_extract(m, i)[1], 0)) AS v FROM (SELECT seq, map_from_entries(list((b, c))) AS m FROM bucket GROUP BY seq)),
pairs AS (SELECT a.seq, e.seq AS hit, round(list_cosine_similarity(va.v, ve.v), 9) AS similarity FROM keyed a JOIN keyed e ON e.level = a.level AND e.corpus_key = a.corpus_key AND e.key = a.key AND e.seq < a.seq AND a.seq - e.seq <= {_TTL}
  JOIN vectors va ON va.seq = a.seq JOIN vectors ve ON ve.seq = e.seq WHERE list_cosine_similarity(va.v, ve.v) >= 0.95),
best AS (SELECT seq, max(struct_pack(similarity := similarity, hit := hit)) AS best FROM pairs GROUP BY seq)
SELECT k.seq, b.best.hit AS hit, round(b.best.similarity, 6) AS similarity FROM keyed k LEFT JOIN best b ON b.seq = k.seq""")
def semantic_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in several wordings, asked one after the other: which earlier one has the answer."""
    i, q = F.col("id"), F.col("question")
    said = F.when(i % 3 == 0, q).when(i % 3 == 1, F.concat(F.lit("Please: "), F.lower(q))).otherwise(F.concat(F.lit("Would you please just say: "), q))
    asked = questions(spark, sf_dir).select(i.alias("seq"), F.when(i % 7 == 0, "restricted").otherwise("default").alias("level"), F.floor(i / 500).cast("string").alias("corpus_key"), said.alias("question"))
    asked = asked.withColumn("vector", hash_vector(words(F.col("question"))))
    return semantic_lookup(asked, asked, ttl=_TTL).select("seq", "hit", F.round("similarity", 6).alias("similarity"))
