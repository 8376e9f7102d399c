"""Queries: lifecycles, version joins, cache, evaluation, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.router import named_in
from marginalia.functions.text import CITE_STOP, CACHE_STOP, content_tokens, content_words
from marginalia.functions.vectors import topk
from marginalia.operators import lifecycle
from marginalia.operators.answers import cache_lookup, cited, expire, price, siblings
from marginalia.operators.metrics import ndcg, recall, reciprocal_rank, summary
from marginalia.plans.retrieval import _asked, _PAIRS, _ranked, _vectors
from marginalia.plans.texts import _array
from marginalia.registry import query
from marginalia.sources.views import CHUNKS, QUESTIONS, chunks, questions, read


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a versioned catalog: a customer is a policy, an order a version."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("policy"), F.row_number().over(by).cast("string").alias("version"),
        F.when(F.col("o_orderstatus") == "F", "retired").otherwise("active").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective_from"),
    )


_CATALOG = """catalog AS (SELECT o_custkey AS policy, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v,
  CASE WHEN o_orderstatus = 'F' THEN 'retired' ELSE 'active' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS effective_from FROM orders),
planned AS (SELECT policy, CAST(v AS VARCHAR) AS version, v, status, effective_from,
  coalesce(status = 'active' AND v = max(CASE WHEN status = 'active' THEN v END) OVER (PARTITION BY policy), false) AS is_latest,
  coalesce(lead(effective_from) OVER (PARTITION BY policy ORDER BY v), '') AS effective_to FROM catalog),
dated AS (SELECT *, CAST(replace(effective_from, '-', '') AS INTEGER) AS effective_from_num, CASE WHEN effective_to = '' THEN 99991231 ELSE CAST(replace(effective_to, '-', '') AS INTEGER) END AS effective_to_num FROM planned)"""


@query(f"WITH {_CATALOG} SELECT policy, version, status, effective_from, is_latest, effective_to, effective_from_num, effective_to_num FROM dated")
def lifecycle_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.plan(_catalog(spark, sf_dir))


@query(f"WITH {_CATALOG} SELECT policy, version FROM dated WHERE is_latest")
def is_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.plan(_catalog(spark, sf_dir)).where("is_latest").select("policy", "version")


@query(f"WITH {_CATALOG} SELECT policy, min(effective_from_num) AS first, max(effective_to_num) AS last, count(*) AS n FROM dated GROUP BY policy")
def effective_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.plan(_catalog(spark, sf_dir)).groupBy("policy").agg(F.min("effective_from_num").alias("first"), F.max("effective_to_num").alias("last"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CATALOG} SELECT policy, arg_max(version, v) AS version FROM dated WHERE effective_from_num <= 19980615 AND effective_to_num > 19980615 GROUP BY policy")
def in_force_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.in_force(lifecycle.plan(_catalog(spark, sf_dir)), 19980615)


@query(f"WITH {CHUNKS}, newest AS (SELECT policy, max(version) AS version FROM chunks WHERE status = 'active' GROUP BY policy) SELECT c.id, c.policy, c.version FROM chunks c JOIN newest n ON c.policy = n.policy AND c.version = n.version")
def scope_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    newest = rows.where("status = 'active'").groupBy("policy").agg(F.max("version").alias("version"))
    return rows.join(newest, ["policy", "version"], "left_semi").select("id", "policy", "version")


@query(f"""WITH {_CATALOG}, before AS (SELECT policy, version, v = max(v) OVER (PARTITION BY policy) AS is_latest, effective_to FROM dated)
SELECT d.policy, d.version, d.is_latest, d.effective_to FROM dated d JOIN before b ON d.policy = b.policy AND d.version = b.version WHERE d.is_latest <> b.is_latest OR d.effective_to <> b.effective_to""")
def lifecycle_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs from a plan that took every version as active."""
    rows = _catalog(spark, sf_dir)
    columns = ["is_latest", "effective_to"]
    return lifecycle.changed(lifecycle.plan(rows.withColumn("status", F.lit("active"))), lifecycle.plan(rows), ["policy", "version"], columns).select("policy", "version", *columns)


@query(f"""WITH {QUESTIONS} SELECT id, CASE WHEN id % 5 = 0 THEN '2.0' WHEN id % 5 = 1 THEN (CASE id % 3 WHEN 2 THEN '2.0' ELSE CAST(1 + id % 3 AS VARCHAR) || '.0' END)
  ELSE CAST(least(1 + id % 3, 1 + (id + 1) % 3) AS VARCHAR) || '.0' END AS older, CASE WHEN id % 5 < 2 THEN '3.0' ELSE CAST(greatest(1 + id % 3, 1 + (id + 1) % 3) AS VARCHAR) || '.0' END AS newer FROM questions""")
def compare_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.functions.text import mentioned_versions

    versions = F.array(F.lit("1.0"), F.lit("2.0"), F.lit("3.0"))
    n = F.col("id") % 5
    asked = F.when(n == 0, "What changed?").when(n == 1, F.concat(F.lit("What changed in version "), (1 + F.col("id") % 3).cast("string"), F.lit("?"))).otherwise(F.col("question"))
    rows = questions(spark, sf_dir).select("id", F.sort_array(mentioned_versions(asked, versions)).alias("named"))
    return rows.select("id", lifecycle.compare_targets(versions, F.col("named")).alias("t")).select("id", "t.older", "t.newer")


@query(f"""WITH {CHUNKS}, n AS (SELECT * FROM chunks WHERE version = '3.0'), o AS (SELECT * FROM chunks WHERE version = '1.0')
SELECT coalesce(n.policy, o.policy) AS policy, coalesce(n.heading_path, o.heading_path) AS heading_path, n.id AS current_id, o.id AS previous_id,
  CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN n.text = o.text THEN 'same' ELSE 'changed' END AS kind
FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY policy, heading_path ORDER BY id) = 1) n
FULL OUTER JOIN (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY policy, heading_path ORDER BY id) = 1) o ON n.policy = o.policy AND n.heading_path = o.heading_path""")
def compare_versions_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.operators.fusion import fold

    rows, key = chunks(spark, sf_dir), ["policy", "heading_path"]
    newer, older = (fold(rows.where(F.col("version") == v), key, [F.col("id")]) for v in ("3.0", "1.0"))
    return lifecycle.compare(newer, older, key).select("policy", "heading_path", F.col("current.id").alias("current_id"), F.col("previous.id").alias("previous_id"), "kind")


@query(f"""WITH {CHUNKS}, c AS (SELECT id, policy, version, 'P' || CAST(CAST(substr(heading_path, 2) AS BIGINT) // 4 AS VARCHAR) AS parent, heading_path FROM chunks WHERE status = 'active' AND classification IN ('public', 'internal')),
hits AS (SELECT *, row_number() OVER (ORDER BY id) AS pos FROM c WHERE id % 100 = 0),
first AS (SELECT policy, version, parent, min(pos) AS pos FROM hits GROUP BY ALL)
SELECT id, pos, 0 AS sibling FROM hits UNION ALL SELECT c.id, f.pos, 1 FROM c JOIN first f ON c.policy = f.policy AND c.version = f.version AND c.parent = f.parent WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.id = c.id)""")
def siblings_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.concat(F.lit("P"), F.floor(F.substring("heading_path", 2, 20).cast("long") / 4).cast("string"))
    rows = chunks(spark, sf_dir).where("status = 'active' AND classification IN ('public', 'internal')").select("id", "policy", "version", "heading_path", parent.alias("parent"))
    hits = rows.where("id % 100 = 0").withColumn("pos", F.row_number().over(Window.orderBy("id")).cast("long"))
    return siblings(hits, rows, ["policy", "version", "parent"]).select("id", "pos", "sibling")


@query(f"WITH {CHUNKS} SELECT DISTINCT policy, version FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunks d WHERE d.policy = c.policy AND d.version = c.version AND d.status = 'retired' AND d.classification = 'public')")
def vanished_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents that are not on disk (here: those without a retired public chunk)."""
    stored = chunks(spark, sf_dir)
    there = stored.where("status = 'retired' AND classification = 'public'").select("policy", "version")
    return stored.select("policy", "version").distinct().join(there, ["policy", "version"], "left_anti")


@query("""WITH n AS (SELECT doc_id, md5(text) AS h, source FROM documents), o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5('old' || text) ELSE md5(text) END AS h, CASE WHEN doc_id % 5 = 0 THEN 'moved' ELSE source END AS source FROM documents WHERE doc_id % 11 <> 0)
SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.h <> o.h THEN 'changed' WHEN n.source <> o.source THEN 'metadata' ELSE 'unchanged' END AS action FROM n LEFT JOIN o ON n.doc_id = o.doc_id""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.sources.store import diff

    d = read(spark, sf_dir, "documents")
    new = d.select("doc_id", F.md5("text").alias("file_hash"), "source")
    i = F.col("doc_id")
    old = d.where(i % 11 != 0).select("doc_id", F.when(i % 7 == 0, F.md5(F.concat(F.lit("old"), "text"))).otherwise(F.md5("text")).alias("file_hash"), F.when(i % 5 == 0, "moved").otherwise(F.col("source")).alias("source"))
    return diff(new, old, ["doc_id"], ["source"]).select("doc_id", "action")


@query(f"WITH {CHUNKS}, alias AS (SELECT 'src1' AS raw, 'source one' AS canonical UNION ALL SELECT 'src2', 'source two') SELECT c.id, coalesce(a.canonical, c.policy) AS policy FROM chunks c LEFT JOIN alias a ON a.raw = c.policy")
def alias_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = F.create_map(F.lit("src1"), F.lit("source one"), F.lit("src2"), F.lit("source two"))
    return chunks(spark, sf_dir).select("id", F.coalesce(aliases[F.col("policy")], "policy").alias("policy"))


@query(f"WITH {QUESTIONS} SELECT q.id, p.policy FROM questions q JOIN (SELECT DISTINCT policy FROM chunks) p ON contains(lower(q.question), lower(p.policy))")
def policies_named_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_in(questions(spark, sf_dir).select("id", F.col("question").alias("text")), chunks(spark, sf_dir).select("policy"))


_KEY = rf"""array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(lower(question), '\b20\d\d-\d\d-\d\d\b'),
  list_transform(regexp_extract_all(lower(question), '\bv(?:ersion)?\s*\.?\s*(\d+(?:\.\d+)?)\b', 1), lambda v: 'v' || v)),
  list_filter(regexp_extract_all(lower(question), '[a-z0-9]+(?:\.[0-9]+)?'), lambda w: NOT list_contains({_array(CACHE_STOP)}, w))))), ' ')"""


@query(f"WITH {QUESTIONS}, k AS (SELECT id, {_KEY} AS key FROM questions) SELECT id, hit FROM (SELECT id, lag(id) OVER (PARTITION BY key ORDER BY id) AS hit FROM k) WHERE hit IS NOT NULL")
def cache_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest earlier question with the same content tokens."""
    rows = questions(spark, sf_dir).select("id", F.array_join(content_tokens(F.col("question")), " ").alias("key"))
    return cache_lookup(rows, "key", ["id"], "id").where("hit IS NOT NULL").select("id", "hit")


def _judged(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """Ranked neighbours of each query vector; same label = relevant."""
    v = _vectors(spark, sf_dir)
    labels = v.select("id", "label")
    ranked = topk(v, _asked(v), k).join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return ranked.select("query_id", "id", "rank", (F.col("label") == F.col("ql")).cast("int").alias("relevant"))


_JUDGED = f"judged AS (SELECT query_id, id, rank, CAST(ql = el AS INTEGER) AS relevant FROM ({_ranked(_PAIRS, 'cosine', 50)})), sizes AS (SELECT q.vec_id AS query_id, count(*) AS total FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "label").join(v.groupBy("label").agg(F.count(F.lit(1)).alias("total")), "label").select("query_id", "total")


@query(f"WITH {_JUDGED} SELECT s.query_id, round(coalesce(sum(relevant) FILTER (WHERE rank <= 20), 0) / s.total::DOUBLE, 6) AS recall FROM sizes s LEFT JOIN judged j ON j.query_id = s.query_id GROUP BY s.query_id, s.total")
def eval_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall(_judged(spark, sf_dir), _sizes(spark, sf_dir), 20).select("query_id", F.round("recall", 6).alias("recall"))


@query(f"WITH {_JUDGED} SELECT query_id, round(coalesce(1::DOUBLE / min(rank) FILTER (WHERE relevant = 1 AND id <> query_id), 0), 6) AS rr FROM judged GROUP BY query_id")
def eval_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).withColumn("relevant", F.when(F.col("id") == F.col("query_id"), 0).otherwise(F.col("relevant")))
    return reciprocal_rank(rows).select("query_id", F.round("rr", 6).alias("rr"))


@query(f"""WITH {_JUDGED}, got AS (SELECT query_id, sum(CASE WHEN id = query_id THEN 2 ELSE relevant END / log2(rank + 1)) FILTER (WHERE rank <= 10) AS dcg FROM judged GROUP BY query_id),
ideal AS (SELECT query_id, 2 + sum(CASE WHEN i <= least(total, 10) THEN 1 / log2(i + 1) ELSE 0 END) AS idcg FROM sizes CROSS JOIN (SELECT unnest(range(2, 11)) AS i) GROUP BY query_id)
SELECT g.query_id, round(g.dcg / i.idcg, 6) AS ndcg FROM got g JOIN ideal i ON g.query_id = i.query_id""")
def eval_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).withColumn("gain", F.when(F.col("id") == F.col("query_id"), 2.0).otherwise(F.col("relevant").cast("double")))
    return ndcg(rows, _sizes(spark, sf_dir), 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type")
def eval_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(pct(0.5).alias("p50"), pct(0.95).alias("p95"), F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT d.source AS grp, l.quality, l.toxic, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT coalesce(grp, '(all)') AS grp, count(*) AS cases, round(avg(quality), 6) AS accuracy, sum(toxic)::BIGINT AS leaks, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95 FROM c GROUP BY GROUPING SETS ((grp), ())""")
def eval_summary_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("grp"), F.col("quality").alias("correct"), F.col("toxic").alias("leak"), F.col("n_chars").alias("latency"))
    return summary(rows)


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)(^|[^a-z0-9])the[\s-]+is([^a-z0-9]|$)') AS required, NOT regexp_matches(text, '(?i)(^|[^a-z0-9])idiots?([^a-z0-9]|$)') AS clean FROM documents""")
def answer_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.operators.metrics import contains_phrase

    return read(spark, sf_dir, "documents").select("doc_id", contains_phrase(F.col("text"), "the is").alias("required"), (~contains_phrase(F.col("text"), "idiot")).alias("clean"))


_CW = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: regexp_matches(w, '[0-9]') OR (length(w) > 2 AND NOT list_contains({_array(CITE_STOP)}, w))))"


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_CW} AS w FROM conversations)
SELECT u.conv_id, u.turn, len(list_intersect(u.w, a.w)) AS shared, len(list_intersect(u.w, a.w)) >= 3 AS cited FROM t u JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'""")
def citation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", content_words(F.col("text")).alias("w"))
    answers = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    rows = t.where("role = 'user'").join(answers, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.size(F.array_intersect("w", "w2")).cast("long").alias("shared"), cited(F.col("w"), F.col("w2")).alias("cited"))


@query(f"WITH {CHUNKS} SELECT policy, count(*) FILTER (WHERE classification = 'top-secret') AS secret_hits, bool_or(classification = 'top-secret' AND status = 'active') AS leak FROM chunks GROUP BY policy")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = F.col("classification") == "top-secret"
    return chunks(spark, sf_dir).groupBy("policy").agg(F.count_if(secret).alias("secret_hits"), F.bool_or(secret & (F.col("status") == "active")).alias("leak"))


@query("""SELECT coalesce(event_type, '(total)') AS step, count(*) AS spans, round(sum(value), 4) AS seconds, round(100 * sum(value) / (SELECT sum(value) FROM events), 4) AS share FROM events GROUP BY ROLLUP (event_type)""")
def trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.operators.metrics import trace_table

    return trace_table(read(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH costs AS (SELECT 'click' AS model, 0.002::DOUBLE AS per_search, 0.1::DOUBLE AS per_1k UNION ALL SELECT 'purchase', 0.01, 0.5 UNION ALL SELECT 'default', 0, 0.05)
SELECT e.event_type, round(sum(coalesce(c.per_search, d.per_search) + e.value / 1000 * coalesce(c.per_1k, d.per_1k)), 6) AS cost FROM events e LEFT JOIN costs c ON c.model = e.event_type CROSS JOIN (SELECT * FROM costs WHERE model = 'default') d GROUP BY e.event_type""")
def cost_price_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = {"click": (0.002, 0.1), "purchase": (0.01, 0.5), "default": (0.0, 0.05)}
    rows = read(spark, sf_dir, "events").select("event_type", price(costs, F.col("event_type"), F.col("value"), F.lit(1)).alias("cost"))
    return rows.groupBy("event_type").agg(F.round(F.sum("cost"), 6).alias("cost"))


@query("""WITH last AS (SELECT user_id, max(ts) AS used FROM events GROUP BY user_id), live AS (SELECT * FROM last WHERE used >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY)
SELECT user_id, n AS age FROM (SELECT user_id, row_number() OVER (ORDER BY used DESC, user_id) AS n FROM live) WHERE n <= 256""")
def cache_ttl_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries older than the time to live go, then those used longest ago beyond the cache's size."""
    used = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("used"))
    return expire(used, "user_id", "used", days=5, most=256).select("user_id", "age")


@query("SELECT date_trunc('day', ts)::DATE AS day, count(*) FILTER (WHERE value >= 50) AS up, count(*) FILTER (WHERE value < 50) AS down, count(*) AS total FROM events GROUP BY 1")
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("value") >= 50).alias("up"), F.count_if(F.col("value") < 50).alias("down"), F.count(F.lit(1)).alias("total"))


@query("SELECT text, min(conv_id * 1000 + turn) AS first, count(*) AS times FROM conversations WHERE role = 'user' GROUP BY text")
def feedback_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct questions with their first place, for the evaluation set."""
    return read(spark, sf_dir, "conversations").where("role = 'user'").groupBy("text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first"), F.count(F.lit(1)).alias("times"))
