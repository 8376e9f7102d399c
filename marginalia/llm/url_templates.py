"""URL filters by a path-template tree.

Explicit rules judge the urls they fit; the tree judges the rest.

1. Segments that vary become wildcards. The children of a tree node are grouped by shape (digit runs as '#'); a shape with
   digits, or with VARIABLE or more distinct segments that make up at least half of its urls, is written as its shape with
   '*' for what varies; other segments stay. Statistics are sums over (host, parent, shape), whatever the size of a host.
2. A template's branch of the tree has two parts: the prefixes of its path, which all hosts share (``/es``, ``/es/*``), and below
   them the host with its own prefixes. A host's node counts its labelled urls (those that a rule fits) and how many are
   blocked; a path's node counts hosts, each once, as blocked where most of its labelled urls there are: a host of very many
   urls says no more about other hosts than a small one. A node whose rate doesn't differ from its siblings' (two-proportion
   test at Z) is merged with them: it takes the counts of all.
3. A node speaks for a template if it is the template's last one or the next one on the branch has labels too. So labels of
   other branches below a node say nothing about a branch without any: rules for ``net/es/`` and ``net/fr/`` do not reject
   ``net/en/``. A template's purity goes down the nodes that speak: it begins as the share of blocked urls over all labelled
   ones, and at each node becomes (blocked + SMOOTH * purity above) / (labelled + SMOOTH). Templates above PURITY are
   rejected, but not where no node speaks: the share over all urls alone is no evidence. The column level names the deepest
   node that speaks: path or host, and its depth.

Defined cases: a null url, or one without '://', has an empty host and path and is allowed; nothing is decoded, so odd
characters stay; repeated rows are judged (and count) each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import materialise, plain

#: Verdict and rule (host, then path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
VARIABLE = 8
Z = 1.96
SMOOTH = 2.0
PURITY = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    return F.regexp_replace(segment, "[0-9]+", "#")


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Per row of pages: id, host, path, rule, verdict, template, purity and level (null: no node speaks)."""
    named = pages.select(plain(id_col).alias("id"), plain(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = named.select("id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    urls = urls.select("id", "host", "path", rule.alias("rule"), verdict.alias("given"))
    # distinct (host, path) carry the tree, with their numbers of urls
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    tree = urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.max("given").alias("given")).withColumn("segments", segments).withColumn("shapes", F.transform("segments", _shape))
    parent = F.array_join(F.slice("shapes", F.lit(1), F.col("i")), "/")
    places = tree.select("host", "n", F.col("shapes"), F.posexplode("segments").alias("i", "segment")).select("host", parent.alias("parent"), _shape(F.col("segment")).alias("shape"), "segment", "n")
    varying = materialise(  # apart from the join, so that Spark can split a hot host there
        places.groupBy("host", "parent", "shape", "segment").agg(F.sum("n").alias("n"))
        .groupBy("host", "parent", "shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
        .select(F.col("host").alias("h"), F.col("parent").alias("p"), F.col("shape").alias("s"), (F.col("shape").contains("#") | ((F.col("d") >= VARIABLE) & (2 * F.col("d") >= F.col("n")))).alias("varies"))
    )
    exploded = tree.select("host", "path", "shapes", F.posexplode("segments").alias("i", "segment")).select("host", "path", "i", "segment", parent.alias("parent"), _shape(F.col("segment")).alias("shape"))
    written = F.when(~F.col("varies"), F.col("segment")).when(F.col("shape").contains("#"), F.regexp_replace("shape", "#", "*")).otherwise("*")
    templates = (
        exploded.join(varying, (F.col("host") == F.col("h")) & (F.col("parent") == F.col("p")) & (F.col("shape") == F.col("s")))
        .groupBy("host", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", written.alias("w")))), lambda x: x["w"]).alias("t"))
    )
    rows = materialise(
        tree.select("host", "path", "n", "given").join(templates, ["host", "path"], "left").select("host", "path", "n", "given", F.coalesce("t", F.array().cast("array<string>")).alias("t"))
    )

    upto = lambda k: F.array_join(F.slice("t", F.lit(1), k), "/")
    every = F.sequence(F.lit(0), F.size("t"))
    node = lambda kind, host: lambda k: F.struct(F.lit(kind).alias("kind"), host.alias("of"), k.alias("depth"), F.when(k > 0, upto(k - 1)).alias("up"), upto(k).alias("node"))
    nodes = F.concat(F.filter(F.transform(every, node(0, F.lit(""))), lambda x: x["depth"] > 0), F.transform(every, node(1, F.col("host"))))
    branches = rows.where("host <> ''")
    # apart from the joins, so that Spark can split a node of very many templates there
    counts = materialise(
        branches.where("given IS NOT NULL").select("host", "n", (F.col("given") == "block").alias("bad"), F.explode(nodes).alias("x"))
        .groupBy("x.kind", "x.of", "x.depth", "x.up", "x.node", "host").agg(F.sum("n").alias("labels"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("blocked"))
        .groupBy("kind", "of", "depth", "up", "node").agg(
            F.sum(F.when(F.col("kind") == 0, 1).otherwise(F.col("labels"))).alias("labels"), F.sum(F.when(F.col("kind") == 0, (2 * F.col("blocked") > F.col("labels")).cast("int")).otherwise(F.col("blocked"))).alias("blocked")
        )
    )
    family = counts.where("depth > 0").groupBy(F.col("kind").alias("fk"), F.col("of").alias("fo"), F.col("depth").alias("fd"), F.col("up").alias("fu")).agg(F.sum("labels").alias("all_labels"), F.sum("blocked").alias("all_blocked"))
    rest_n, rest_b = F.col("all_labels") - F.col("labels"), F.col("all_blocked") - F.col("blocked")
    share = F.col("all_blocked") / F.col("all_labels")
    error = F.sqrt(share * (1 - share) * (1 / F.col("labels") + 1 / rest_n))
    alike = (rest_n > 0) & (F.abs(F.col("blocked") / F.col("labels") - rest_b / rest_n) <= Z * error)
    kin = (F.col("kind") == F.col("fk")) & (F.col("of") == F.col("fo")) & (F.col("depth") == F.col("fd")) & (F.col("up") == F.col("fu"))
    merged = materialise(counts.join(family, kin, "left").select(
        F.col("kind").alias("mk"), F.col("of").alias("mo"), F.col("node").alias("mn"), F.col("depth").alias("md"),
        F.when(alike, F.col("all_labels")).otherwise(F.col("labels")).cast("double").alias("labels"), F.when(alike, F.col("all_blocked")).otherwise(F.col("blocked")).cast("double").alias("blocked"),
    ))
    totals = rows.where("given IS NOT NULL").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("given") == "block", F.col("n")).otherwise(0)).alias("b")).first()
    prior = totals.b / totals.n if totals.n else 0.0
    template = F.concat(F.lit("/"), F.array_join("t", "/"))
    deeper = lambda p, c: (c["blocked"] + SMOOTH * p) / (c["labels"] + SMOOTH)
    # nodes in the order of kind and depth; one speaks at its template's end, or where the next one is labelled as well
    after = lambda i: F.get("branch", i + 1)
    speaks = lambda x, i: (x["md"] == F.col("len")) | F.coalesce((after(i)["mk"] == x["mk"]) & (after(i)["md"] == x["md"] + 1), F.lit(False))
    last = F.try_element_at("branch", F.lit(-1))
    purity = (
        branches.select("host", template.alias("template"), "t").distinct().select("host", "template", F.size("t").alias("len"), F.explode(nodes).alias("x"))
        .join(merged, (F.col("x.kind") == F.col("mk")) & (F.col("x.of") == F.col("mo")) & (F.col("x.depth") == F.col("md")) & (F.col("x.node") == F.col("mn")))
        .groupBy(F.col("host").alias("ph"), F.col("template").alias("pt"), "len").agg(F.array_sort(F.collect_list(F.struct("mk", "md", "labels", "blocked"))).alias("branch"))
        .withColumn("branch", F.filter("branch", speaks)).where(F.size("branch") > 0)
        .select("ph", "pt", F.aggregate("branch", F.lit(float(prior)), deeper).alias("purity"), F.concat(F.when(last["mk"] == 0, "path ").otherwise("host "), last["md"].cast("string")).alias("level"))
    )
    judged = rows.select("host", "path", template.alias("template")).join(purity, (F.col("host") == F.col("ph")) & (F.col("template") == F.col("pt")), "left").select(F.col("host").alias("jh"), F.col("path").alias("jp"), "template", "purity", "level")
    method = F.when(F.col("purity") > PURITY, "block").otherwise("allow")
    return urls.join(judged, (F.col("host") == F.col("jh")) & (F.col("path") == F.col("jp"))).select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", method).alias("verdict"), "template", F.coalesce("purity", F.lit(float(prior))).alias("purity"), "level"
    )


_FITS = " ".join(
    f"WHEN (host = '{text.partition('/')[0]}' OR ends_with(host, '.{text.partition('/')[0]}')) AND starts_with(path, '/{text.partition('/')[2]}') THEN '{{{i}}}'"
    for i, (_, text) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1]))
)

#: The same in SQL.
SQL = f"""
WITH named AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM named
),
urls AS (
  SELECT *, CASE {_FITS.format(*[r[1] for r in RULES])} END AS rule, CASE {_FITS.format(*[r[0] for r in RULES])} END AS given FROM parts
),
tree AS (SELECT host, path, count(*) AS n, max(given) AS given, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM urls GROUP BY host, path),
places AS (
  SELECT host, path, n, i, segments[i] AS segment, regexp_replace(segments[i], '[0-9]+', '#', 'g') AS shape,
         array_to_string(list_transform(segments[1 : i - 1], lambda s: regexp_replace(s, '[0-9]+', '#', 'g')), '/') AS parent
  FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS i FROM tree)
),
varying AS (
  SELECT host, parent, shape, contains(shape, '#') OR (count(*) >= {VARIABLE} AND 2 * count(*) >= sum(n)) AS varies
  FROM (SELECT host, parent, shape, segment, sum(n) AS n FROM places GROUP BY ALL) GROUP BY host, parent, shape
),
written AS (
  SELECT p.host, p.path, p.i, CASE WHEN NOT v.varies THEN p.segment WHEN contains(p.shape, '#') THEN replace(p.shape, '#', '*') ELSE '*' END AS w
  FROM places p JOIN varying v ON p.host = v.host AND p.parent = v.parent AND p.shape = v.shape
),
templates AS (SELECT host, path, list(w ORDER BY i) AS t FROM written GROUP BY host, path),
rows_ AS (SELECT r.host, r.path, r.n, r.given, coalesce(t.t, CAST([] AS VARCHAR[])) AS t FROM tree r LEFT JOIN templates t ON r.host = t.host AND r.path = t.path),
spots AS (SELECT host, path, n, given, '/' || array_to_string(t, '/') AS template, t, unnest(range(0, len(t) + 1)) AS k FROM rows_ WHERE host <> ''),
nodes AS (
  SELECT host, template, len(t) AS len, n, given, kind, CASE kind WHEN 0 THEN '' ELSE host END AS of, k AS depth, CASE WHEN k > 0 THEN array_to_string(t[1 : k - 1], '/') END AS up, array_to_string(t[1 : k], '/') AS node
  FROM spots, (VALUES (0), (1)) AS kinds(kind) WHERE kind = 1 OR k > 0
),
by_host AS (SELECT kind, of, depth, up, node, host, sum(n) AS l, sum(CASE WHEN given = 'block' THEN n ELSE 0 END) AS b FROM nodes WHERE given IS NOT NULL GROUP BY ALL),
counts AS (
  SELECT kind, of, depth, up, node, CAST(sum(CASE kind WHEN 0 THEN 1 ELSE l END) AS DOUBLE) AS labels, CAST(sum(CASE WHEN kind = 1 THEN b WHEN 2 * b > l THEN 1 ELSE 0 END) AS DOUBLE) AS blocked FROM by_host GROUP BY ALL
),
family AS (SELECT *, sum(labels) OVER f AS all_labels, sum(blocked) OVER f AS all_blocked FROM counts WINDOW f AS (PARTITION BY kind, of, depth, up)),
tested AS (
  SELECT *, CASE WHEN depth > 0 AND all_labels > labels THEN abs(blocked / labels - (all_blocked - blocked) / (all_labels - labels)) <= {Z} * sqrt(
    all_blocked / all_labels * (1 - all_blocked / all_labels) * (1 / labels + 1 / (all_labels - labels))) ELSE false END AS alike FROM family
),
merged AS (SELECT kind, of, depth, node, CASE WHEN alike THEN all_labels ELSE labels END AS labels, CASE WHEN alike THEN all_blocked ELSE blocked END AS blocked FROM tested),
prior AS (SELECT coalesce(CAST(sum(CASE WHEN given = 'block' THEN n ELSE 0 END) AS DOUBLE) / sum(n), 0) AS p FROM rows_ WHERE given IS NOT NULL),
branches AS (
  SELECT n.host, n.template, max(n.len) AS len, list({{'l': m.labels, 'p': m.blocked, 'k': n.kind, 'd': n.depth}} ORDER BY n.kind, n.depth) AS b
  FROM (SELECT DISTINCT host, template, len, kind, of, depth, node FROM nodes) n JOIN merged m ON n.kind = m.kind AND n.of = m.of AND n.depth = m.depth AND n.node = m.node GROUP BY n.host, n.template
),
branch AS (SELECT host, template, list_filter(b, lambda x, i: x.d = len OR coalesce(b[i + 1].k = x.k AND b[i + 1].d = x.d + 1, false)) AS b FROM branches),
purity AS (
  SELECT host, template, list_reduce(list_prepend({{'l': CAST(0 AS DOUBLE), 'p': (SELECT p FROM prior)}}, list_transform(b, lambda x: {{'l': x.l, 'p': x.p}})), lambda a, x: {{'l': x.l, 'p': (x.p + {SMOOTH} * a.p) / (x.l + {SMOOTH})}}).p AS purity,
         CASE b[-1].k WHEN 0 THEN 'path ' ELSE 'host ' END || CAST(b[-1].d AS VARCHAR) AS level FROM branch WHERE len(b) > 0
)
SELECT u.page_id, u.host, u.path, u.rule, coalesce(u.given, CASE WHEN p.purity > {PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
       '/' || array_to_string(r.t, '/') AS template, coalesce(p.purity, (SELECT p FROM prior)) AS purity, p.level
FROM urls u JOIN rows_ r ON u.host = r.host AND u.path = r.path
LEFT JOIN purity p ON p.host = u.host AND p.template = '/' || array_to_string(r.t, '/')
"""
