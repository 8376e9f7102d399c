"""Queries: vectors, BM25, fusion, diversity.

Lexical queries are all benchmark texts; vector queries are all vectors whose id is divisible by 100, against all vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import vectors as V
from marginalia.functions.text import words
from marginalia.operators.fusion import fold, hybrid, lost_in_the_middle, mmr, rrf
from marginalia.operators.lexical import bm25, top
from marginalia.plans.texts import tokens_sql
from marginalia.registry import query
from marginalia.sources.views import CHUNKS, chunks, read

CANDIDATES, FUSED, BEST = 50, 20, 5


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))


def _out(ranked: DataFrame, score: str, *more: str) -> DataFrame:
    return ranked.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round(score, 6).alias(score), *more)


def _ranked(rows: str, score: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, id) AS rank FROM ({rows})) WHERE rank <= {k}"


_PAIRS = "SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS cosine, q.label AS ql, e.label AS el FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0"


@query(f"SELECT query_id, id, rank, round(cosine, 6) AS cosine FROM ({_ranked(_PAIRS, 'cosine', CANDIDATES)})")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return _out(V.topk(v, _asked(v), CANDIDATES), "cosine")


@query(f"SELECT query_id, id, rank, round(cosine, 6) AS cosine FROM ({_ranked(_PAIRS + ' WHERE e.label IN (1, 3, 5)', 'cosine', CANDIDATES)})")
def cosine_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return _out(V.topk(v.where(F.col("label").isin(1, 3, 5)), _asked(v), CANDIDATES), "cosine")


@query(f"SELECT query_id, count(*) AS n, CAST(count(*) FILTER (WHERE ql = el) AS DOUBLE) / count(*) AS same FROM ({_ranked(_PAIRS + ' WHERE q.vec_id <> e.vec_id', 'cosine', 10)}) GROUP BY query_id")
def knn_same_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    # a vector's own row is among its best; one more and that left out
    ranked = fold(V.topk(v, _asked(v), 11).where("id <> query_id"), ["query_id", "id"], [F.col("rank")])
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 10")
    labels = v.select("id", "label")
    rows = ranked.join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("ql")).cast("double")).alias("same"))


@query("SELECT vec_id AS id, round(h[1] / sqrt(list_sum(list_transform(h, lambda x: x * x))), 6) AS first, len(h) AS dims FROM (SELECT vec_id, (embedding::DOUBLE[])[1:16] AS h FROM embeddings)")
def truncate_renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("id", V.truncate(F.col("vector"), 16).alias("t")).select("id", F.round(F.col("t")[0], 6).alias("first"), F.size("t").cast("long").alias("dims"))


_SHORT = _PAIRS.replace("q.embedding::DOUBLE[], e.embedding::DOUBLE[]", "(q.embedding::DOUBLE[])[1:16], (e.embedding::DOUBLE[])[1:16]")


@query(f"""WITH short AS ({_ranked(_SHORT, 'cosine', 100)}), exact AS ({_PAIRS}),
scored AS (SELECT e.query_id, e.id, e.cosine FROM exact e JOIN short s ON e.query_id = s.query_id AND e.id = s.id) SELECT query_id, id, rank, round(cosine, 6) AS cosine FROM ({_ranked('SELECT * FROM scored', 'cosine', 10)})""")
def mrl_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 100 on the first 16 entries, rescored on all and cut to 10."""
    v = _vectors(spark, sf_dir)
    short = V.topk(v, _asked(v), 100, dims=16).select("query_id", "id")
    scored = short.join(v, "id").join(_asked(v), "query_id").select("query_id", "id", V.cosine(F.col("vector"), F.col("query_vector")).alias("cosine"))
    return _out(top(scored, 10, "cosine"), "cosine")


def hashed(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), V.hash_vector(words(F.col(text_col))).alias("vector"))


_HEX = "CAST('0x' || right(md5(w), 2) AS INTEGER)"
_HASH = f"""dw AS (SELECT doc_id AS id, {_HEX} AS b, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY ALL),
qw AS (SELECT item_id AS query_id, {_HEX} AS b, count(*)::DOUBLE AS c FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark) GROUP BY ALL),
dn AS (SELECT id, sqrt(sum(c * c)) AS n FROM dw GROUP BY id), qn AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM qw GROUP BY query_id),
dots AS (SELECT q.query_id, d.id, sum(q.c * d.c) AS s FROM qw q JOIN dw d ON q.b = d.b GROUP BY ALL),
dense AS (SELECT i.item_id AS query_id, d.doc_id AS id, coalesce(s.s / (dn.n * qn.n), 0) AS cosine FROM benchmark i CROSS JOIN documents d
  LEFT JOIN dots s ON s.query_id = i.item_id AND s.id = d.doc_id LEFT JOIN dn ON dn.id = d.doc_id LEFT JOIN qn ON qn.query_id = i.item_id)"""


def _dense(docs: DataFrame, spark: SparkSession, sf_dir: str, k: int = CANDIDATES) -> DataFrame:
    asked = hashed(read(spark, sf_dir, "benchmark"), "item_id").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return V.topk(hashed(docs, "id"), asked, k)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


@query(f"WITH {_HASH} SELECT query_id, id, rank, round(cosine, 6) AS cosine FROM ({_ranked('SELECT * FROM dense', 'cosine', CANDIDATES)})")
def hash_embed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_dense(_docs(spark, sf_dir), spark, sf_dir), "cosine")


def _bm25_sql(docs: str = "SELECT doc_id AS id, text FROM documents", name: str = "bm") -> str:
    return f"""{name}_d AS (SELECT id, {tokens_sql('text')} AS t FROM ({docs})),
{name}_w AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS a FROM {name}_d),
{name}_tf AS (SELECT id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT id, len(t)::DOUBLE AS dl, unnest(t) AS term FROM {name}_d) GROUP BY ALL),
{name}_df AS (SELECT term, count(*)::DOUBLE AS df FROM {name}_tf GROUP BY term),
{name}_q AS (SELECT query_id, term, count(*)::DOUBLE AS qtf FROM (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
{name} AS (SELECT q.query_id, t.id, sum(q.qtf * ln(1 + (w.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * t.tf * 2.5::DOUBLE / (t.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * t.dl / w.a))) AS score
  FROM {name}_tf t JOIN {name}_q q ON t.term = q.term JOIN {name}_df f ON f.term = t.term CROSS JOIN {name}_w w GROUP BY q.query_id, t.id)"""


@query(f"WITH {_bm25_sql()} SELECT query_id, id, rank, round(score, 6) AS score FROM ({_ranked('SELECT * FROM bm WHERE score > 0', 'score', CANDIDATES)})")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(bm25(_docs(spark, sf_dir), _items(spark, sf_dir), CANDIDATES), "score")


_PUBLIC = "SELECT id, text FROM chunks WHERE classification IN ('public', 'internal') AND status = 'active'"


def _allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("classification IN ('public', 'internal') AND status = 'active'").select("id", "text")


@query(f"WITH {CHUNKS}, {_bm25_sql(_PUBLIC)} SELECT query_id, id, rank, round(score, 6) AS score FROM ({_ranked('SELECT * FROM bm WHERE score > 0', 'score', CANDIDATES)})")
def bm25_filtered_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of what the caller may see only."""
    return _out(bm25(_allowed(spark, sf_dir), _items(spark, sf_dir), CANDIDATES), "score")


_LISTS = f"lex AS ({_ranked('SELECT * FROM bm WHERE score > 0', 'score', CANDIDATES)}), den AS ({_ranked('SELECT * FROM dense', 'cosine', CANDIDATES)})"


def _fused(weights: tuple[float, float]) -> str:
    return f"fused AS (SELECT query_id, id, sum(part) AS rrf FROM (SELECT query_id, id, {weights[0]}::DOUBLE / (60 + rank) AS part FROM den UNION ALL SELECT query_id, id, {weights[1]}::DOUBLE / (60 + rank) FROM lex) GROUP BY ALL)"


def _lists(docs: DataFrame, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _dense(docs, spark, sf_dir), bm25(docs, _items(spark, sf_dir), CANDIDATES)


@query(f"WITH {_HASH}, {_bm25_sql()}, {_LISTS}, {_fused((1, 1))} SELECT query_id, id, rank, round(rrf, 6) AS rrf FROM ({_ranked('SELECT * FROM fused', 'rrf', FUSED)})")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(top(rrf(list(_lists(_docs(spark, sf_dir), spark, sf_dir))), FUSED, "rrf"), "rrf")


@query(f"WITH {_HASH}, {_bm25_sql()}, {_LISTS}, {_fused((2, 1))} SELECT query_id, id, rank, round(rrf, 6) AS rrf FROM ({_ranked('SELECT * FROM fused', 'rrf', FUSED)})")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(top(rrf(list(_lists(_docs(spark, sf_dir), spark, sf_dir)), [2.0, 1.0]), FUSED, "rrf"), "rrf")


def _hybrid(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = top(hybrid(*_lists(docs, spark, sf_dir)), FUSED, "rrf")
    return rows.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("rrf", 6).alias("rrf"), F.round(F.coalesce("cosine", F.lit(0.0)), 6).alias("cosine"), F.round("score", 6).alias("bm25"))


_HYBRID = f"""SELECT f.query_id, f.id, f.rank, round(f.rrf, 6) AS rrf, round(coalesce(d.cosine, 0), 6) AS cosine, round(l.score, 6) AS bm25 FROM ({_ranked('SELECT * FROM fused', 'rrf', FUSED)}) f
LEFT JOIN den d ON d.query_id = f.query_id AND d.id = f.id LEFT JOIN lex l ON l.query_id = f.query_id AND l.id = f.id"""


@query(f"WITH {_HASH}, {_bm25_sql()}, {_LISTS}, {_fused((1, 1))} {_HYBRID}")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: dense and lexical candidates, fused."""
    return _hybrid(_docs(spark, sf_dir), spark, sf_dir)


@query(f"WITH {CHUNKS}, {_HASH.replace('FROM documents', 'FROM (SELECT id AS doc_id, text FROM (' + _PUBLIC + '))').replace('CROSS JOIN documents d', 'CROSS JOIN (SELECT id AS doc_id FROM (' + _PUBLIC + ')) d')}, {_bm25_sql(_PUBLIC)}, {_LISTS}, {_fused((1, 1))} {_HYBRID}")
def hybrid_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(_allowed(spark, sf_dir), spark, sf_dir)


_SECOND = _PAIRS.replace("list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])", "list_cosine_similarity((q.embedding::DOUBLE[])[1:16], (e.embedding::DOUBLE[])[1:16])")
_THIRD = _PAIRS.replace("list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])", "list_cosine_similarity((q.embedding::DOUBLE[])[1:32], (e.embedding::DOUBLE[])[1:32])")
_THREE = f"a AS ({_ranked(_PAIRS, 'cosine', CANDIDATES)}), b AS ({_ranked(_SECOND, 'cosine', CANDIDATES)}), c AS ({_ranked(_THIRD, 'cosine', CANDIDATES)})"


@query(f"""WITH {_THREE}, fused AS (SELECT query_id, id, sum(1::DOUBLE / (60 + rank)) AS rrf FROM (SELECT query_id, id, rank FROM a UNION ALL SELECT query_id, id, rank FROM b UNION ALL SELECT query_id, id, rank FROM c) GROUP BY ALL)
SELECT query_id, id, rank, round(rrf, 6) AS rrf FROM ({_ranked('SELECT * FROM fused', 'rrf', FUSED)})""")
def multi_query_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list per form of the query (here: the vector and two truncations), fused."""
    v = _vectors(spark, sf_dir)
    return _out(top(rrf([V.topk(v, _asked(v), CANDIDATES, dims=d) for d in (64, 16, 32)]), FUSED, "rrf"), "rrf")


@query(f"""WITH {_THREE}, fused AS (SELECT query_id, id, sum(w / (60 + rank)) AS rrf FROM (SELECT query_id, id, rank, 1::DOUBLE AS w FROM b UNION ALL SELECT query_id, id, rank, 3::DOUBLE FROM c) GROUP BY ALL)
SELECT query_id, id, rank, round(rrf, 6) AS rrf FROM ({_ranked('SELECT * FROM fused', 'rrf', FUSED)})""")
def ensemble_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rerankers' orders, fused with weights."""
    v = _vectors(spark, sf_dir)
    return _out(top(rrf([V.topk(v, _asked(v), CANDIDATES, dims=d) for d in (16, 32)], [1.0, 3.0]), FUSED, "rrf"), "rrf")


def _mmr_sql(relevance: str) -> str:
    """Five greedy picks as five steps."""
    sim = "list_cosine_similarity(x.v, y.v)"
    base = f"""cand AS (SELECT r.query_id, r.id, r.rank AS pos, {relevance} AS rel0, e.embedding::DOUBLE[] AS v FROM ({_ranked(_PAIRS, 'cosine', FUSED)}) r JOIN embeddings e ON e.vec_id = r.id),
span AS (SELECT query_id, min(rel0) AS lo, CASE WHEN max(rel0) = min(rel0) THEN 1 ELSE max(rel0) - min(rel0) END AS sp FROM cand GROUP BY query_id),
c0 AS (SELECT c.query_id, c.id, c.pos, c.v, (c.rel0 - s.lo) / s.sp AS rel FROM cand c JOIN span s ON s.query_id = c.query_id),
p1 AS (SELECT query_id, id, v, 1 AS pick FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7::DOUBLE * rel, 9) DESC, pos) AS n FROM c0) WHERE n = 1)"""
    steps = ""
    for k in range(2, BEST + 1):
        chosen = " UNION ALL ".join(f"SELECT query_id, id, v FROM p{i}" for i in range(1, k))
        steps += f""", p{k} AS (SELECT query_id, id, v, {k} AS pick FROM (SELECT x.query_id, x.id, any_value(x.v) AS v, row_number() OVER (PARTITION BY x.query_id ORDER BY round(0.7::DOUBLE * any_value(x.rel) - 0.3::DOUBLE * max({sim}), 9) DESC, any_value(x.pos)) AS n
  FROM c0 x JOIN ({chosen}) y ON x.query_id = y.query_id WHERE NOT EXISTS (SELECT 1 FROM ({chosen}) z WHERE z.query_id = x.query_id AND z.id = x.id) GROUP BY x.query_id, x.id) WHERE n = 1)"""
    return f"WITH {base}{steps} " + " UNION ALL ".join(f"SELECT query_id, id, pick FROM p{i}" for i in range(1, BEST + 1))


def _mmr(spark: SparkSession, sf_dir: str, relevance) -> DataFrame:
    v = _vectors(spark, sf_dir)
    rows = V.topk(v, _asked(v), FUSED).join(v, "id").select("query_id", F.col("rank").alias("pos"), "id", relevance.alias("relevance"), "vector")
    return mmr(rows, BEST)


@query(_mmr_sql("r.cosine"))
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mmr(spark, sf_dir, F.col("cosine"))


@query(_mmr_sql("1::DOUBLE / r.rank"))
def mmr_rerank_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance from positions, as without rerank scores."""
    return _mmr(spark, sf_dir, 1.0 / F.col("rank"))


@query(f"SELECT query_id, id, rank, CASE WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE {FUSED} + 1 - rank // 2 END AS place FROM ({_ranked(_PAIRS, 'cosine', FUSED)})")
def lost_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    ranked = V.topk(v, _asked(v), FUSED)
    return ranked.select("query_id", "id", F.col("rank").cast("long").alias("rank"), lost_in_the_middle(F.col("rank"), F.lit(FUSED)).cast("long").alias("place"))


@query(f"WITH {CHUNKS} SELECT replace(policy, 'src1', 'src') AS policy, version, heading_path, min(id) AS id FROM chunks GROUP BY 1, 2, 3")
def fold_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases folded to one name; the first chunk of each place stays."""
    rows = chunks(spark, sf_dir).withColumn("policy", F.regexp_replace("policy", "src1", "src"))
    return fold(rows, ["policy", "version", "heading_path"], [F.col("id")]).select("policy", "version", "heading_path", "id")
