"""Quality rules with adaptive thresholds per language and source.

Fixed base rules reject a text outright. The others compare four per-mille figures of a document with fences that come
from its own (language, source) group: the quartiles of a mergeable quantile sketch, and a multiple of their distance
beyond the upper (and for word lengths the lower) one. The sketch of a figure counts values in buckets of a fixed relative
width (1/64), so sketches merge by adding counts: sources merge into languages and these into one for all. Groups under
``min_docs`` documents take the fences of the merged sketch above them.

Only quartiles are used, because junk of less than a quarter of a group cannot move them far, however bad it is. Where a
figure is rare its quartiles coincide at 0 and say nothing of chance events; there the fence is what a few events come to
in a document of the group's median length, by the sketches of lengths. Shorter documents are measured on that length too:
one repeated line of three is an event, not a rate.

Defined cases: null or empty text has no words and fails the base rules; null language or source is a group of its own;
repeated rows count each; a value equal to a fence passes; very long texts are measured
whole; an empty table gives an empty result; further columns are passed through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marginalia.llm.common import map_batches, materialise, plain

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
#: Per figure: what it counts, in units of what, and how many are chance in a document of median length. Word lengths are no
#: events; for the others these are a symbol every now and then, two repeated lines, and 32 words said twice.
FIGURES = {"word_len": ("word_chars", "n_words", 0), "symbols": ("n_symbols", "n_words", 6), "dup_lines": ("n_dup_lines", "n_lines", 2), "repeats": ("n_repeat_words", "n_words", 64)}
LENGTHS = ("n_words", "n_lines")
#: Quartile distances from a quartile to its fence.
TIMES = 6
#: Documents that a group needs for its own fences: among so many, a quartile's rank is within 14 per cent (two deviations).
MIN_DOCS = 40
#: Figures that are also rejected when too low.
TWO_SIDED = ("word_len",)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_P = "__quality_"


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """COUNTS of a text, and its lines that hold a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0
    spaces = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) < len(windows):
        covered = -1
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    return n, len(text) - spaces, n_symbols, len(lines) - len(set(lines)), repeated, len(lines)


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of docs (or keep) and the counts, under prefixed names."""
    source = docs.select(*[plain(c) for c in keep], plain(text_col).alias(f"{_P}text")) if keep is not None else docs.withColumn(f"{_P}text", plain(text_col))
    names = [c for c in source.columns if c != f"{_P}text"]
    schema = source.select(*[plain(c) for c in names]).schema
    for c in (*COUNTS, "n_lines"):
        schema = schema.add(f"{_P}{c}", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(s, 500) for whole in batches for s in range(0, whole.num_rows, 500)):
            at = batch.schema.get_field_index(f"{_P}text")
            rows = [measure(x) for x in batch.column(at).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            fields = [batch.schema.field(i) for i in range(batch.num_columns) if i != at]
            for k, c in enumerate((*COUNTS, "n_lines")):
                columns.append(pa.array([r[k] for r in rows], pa.int64()))
                fields.append(pa.field(f"{_P}{c}", pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return map_batches(source, run, schema)


def base_failed() -> Column:
    n, repeated = F.col(f"{_P}n_words"), F.col(f"{_P}n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeated > 50 * n)


def figures() -> dict[str, Column]:
    """The four figures in whole per mille, and the lengths."""
    rates = {k: F.expr(f"(1000 * {_P}{count}) div greatest({_P}{unit}, 1)") for k, (count, unit, _) in FIGURES.items()}
    return rates | {k: F.col(f"{_P}{k}") for k in LENGTHS}


def sketches(counted: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """The sketch of each figure and (language, source): rows (lang, source, figure, bucket, n), of documents that pass the base rules."""
    each = F.array(*[F.struct(F.lit(k).alias("figure"), v.alias("v")) for k, v in figures().items()])
    return (
        counted.where(~base_failed())
        .select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), F.explode(each).alias("x"))
        .select("lang", "source", "x.figure", "x.v")
        .withColumn("s", F.greatest(F.length(F.bin("v")) - 7, F.lit(0)))
        .withColumn("bucket", F.expr("shiftleft(shiftright(v, s), s)"))
        .groupBy("lang", "source", "figure", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles and median of each sketch: the first buckets at which so many per cent of the values are reached."""
    by = Window.partitionBy(*keys, "figure")
    cum = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("all", F.sum("n").over(by))
    reached = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("all"), F.col("bucket")))
    return cum.groupBy(*keys, "figure").agg(F.struct(F.max("all").alias("docs"), reached(25).alias("q1"), reached(50).alias("q2"), reached(75).alias("q3")).alias("q"))


def fences(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per (lang, source): lo_ and hi_ of each figure, and the median lengths (mid_)."""
    by_lang = sketch.groupBy("lang", "figure", "bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("figure", "bucket").agg(F.sum("n").alias("n"))
    own = _quartiles(sketch, ["lang", "source"])
    lang = _quartiles(by_lang, ["lang"]).select(F.col("lang").alias("l"), F.col("figure").alias("f"), F.col("q").alias("up"))
    top = _quartiles(overall, []).select(F.col("figure").alias("g"), F.col("q").alias("top"))
    q = F.when(F.col("q.docs") >= min_docs, F.col("q")).when(F.col("up.docs") >= min_docs, F.col("up")).otherwise(F.col("top"))
    chosen = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("figure") == F.col("f"))).join(top, F.col("figure") == F.col("g"))
    wide = chosen.groupBy("lang", "source").agg(*[F.max(F.when(F.col("figure") == k, q)).alias(k) for k in (*FIGURES, *LENGTHS)])
    of = {}
    for k, (_, unit, chance) in FIGURES.items():
        # a bucket is never wider than a 64th of what is in it
        beyond = f"greatest({TIMES} * greatest({k}.q3 - {k}.q1, {k}.q3 div 64), {1000 * chance} div greatest({unit}.q2, 1))"
        of[f"hi_{k}"] = F.expr(f"{k}.q3 + {beyond}")
        if k in TWO_SIDED:
            of[f"lo_{k}"] = F.expr(f"{k}.q1 - {beyond}")
    of |= {f"mid_{k}": F.col(f"{k}.q2") for k in LENGTHS}
    return wide.select(F.col("lang").alias(f"{_P}lang"), F.col("source").alias(f"{_P}source"), *[c.alias(f"{_P}{k}") for k, c in of.items()])


def _judged(counted: DataFrame, limits: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    ok = F.lit(True)
    for k, (count, unit, _) in FIGURES.items():
        length = f"{_P}{unit}" if k in TWO_SIDED else f"greatest({_P}{unit}, {_P}mid_{unit})"
        figure = F.expr(f"(1000 * {_P}{count}) div greatest({length}, 1)")
        ok = ok & F.coalesce(figure <= F.col(f"{_P}hi_{k}"), F.lit(True))
        if k in TWO_SIDED:
            ok = ok & F.coalesce(figure >= F.col(f"{_P}lo_{k}"), F.lit(True))
    return counted.join(limits, plain(lang_col).eqNullSafe(F.col(f"{_P}lang")) & plain(source_col).eqNullSafe(F.col(f"{_P}source")), "left").withColumn(f"{_P}kept", ~base_failed() & ok)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per document: id, the counts, base_failed and kept."""
    counted = materialise(with_counts(docs, text_col, list(dict.fromkeys([id_col, lang_col, source_col]))))
    judged = _judged(counted, materialise(fences(sketches(counted, lang_col, source_col))), lang_col, source_col)
    return judged.select(plain(id_col), *[F.col(f"{_P}{c}").alias(c) for c in COUNTS], base_failed().alias("base_failed"), F.col(f"{_P}kept").alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that the rules keep. Texts are measured twice, which is cheaper than to store them between."""
    narrow = with_counts(docs, text_col, list(dict.fromkeys([lang_col, source_col])))
    # written first: its size is then known when the join is planned, so that texts are shuffled only if it is large
    limits = materialise(fences(materialise(sketches(narrow, lang_col, source_col))))
    return _judged(with_counts(docs, text_col), limits, lang_col, source_col).where(f"{_P}kept").select(*[plain(c) for c in docs.columns])


def _quartile_sql(keys: str) -> str:
    on = (keys + ", ") if keys else ""
    reached = ", ".join(f"min(bucket) FILTER (WHERE 100 * upto >= {p} * n_all) AS q{i}" for i, p in enumerate((25, 50, 75), 1))
    return f"""SELECT {on}figure, max(n_all) AS docs, {reached}
  FROM (SELECT {on}figure, bucket, sum(n) OVER (PARTITION BY {on}figure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {on}figure) AS n_all
        FROM (SELECT {on}figure, bucket, count(*) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL"""


_RATES = ", ".join(f"{{'figure': '{k}', 'v': 1000 * {count} // greatest({unit}, 1)}}" for k, (count, unit, _) in FIGURES.items())
_LENGTHS = ", ".join(f"{{'figure': '{k}', 'v': {k}}}" for k in LENGTHS)
_EACH = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, '{k}' AS figure, '{unit}' AS unit, {count} AS n, {unit} AS length, {chance} AS chance FROM judged WHERE NOT base_failed" for k, (count, unit, chance) in FIGURES.items()
)
#: The same in SQL.
SQL = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
held AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT w.doc_id, lang, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines
  FROM w LEFT JOIN held h ON w.doc_id = h.doc_id LEFT JOIN lines l ON w.doc_id = l.doc_id),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
figures AS (SELECT doc_id, lang, source, x.figure AS figure, x.v AS v, greatest(length(bin(x.v)) - 7, 0) AS s FROM (SELECT doc_id, lang, source, unnest([{_RATES}, {_LENGTHS}]) AS x FROM judged WHERE NOT base_failed)),
sketch AS (SELECT *, (v >> s) << s AS bucket FROM figures),
own AS ({_quartile_sql("lang, source")}), by_lang AS ({_quartile_sql("lang")}), overall AS ({_quartile_sql("")}),
quartiles AS (
  SELECT c.lang, c.source, c.figure, CASE WHEN c.docs >= {MIN_DOCS} THEN [c.q1, c.q2, c.q3] WHEN b.docs >= {MIN_DOCS} THEN [b.q1, b.q2, b.q3] ELSE [o.q1, o.q2, o.q3] END AS q
  FROM own c JOIN by_lang b ON c.lang IS NOT DISTINCT FROM b.lang AND c.figure = b.figure JOIN overall o ON o.figure = c.figure),
verdicts AS (
  SELECT doc_id, bool_and(CASE WHEN figure = 'word_len' THEN v BETWEEN q1 - beyond AND q3 + beyond ELSE v <= q3 + beyond END) AS ok FROM (
    SELECT e.doc_id, e.figure, l.q[1] AS q1, l.q[3] AS q3, 1000 * e.n // greatest(e.length, CASE WHEN e.figure = 'word_len' THEN 1 ELSE m.q[2] END, 1) AS v,
           greatest({TIMES} * greatest(l.q[3] - l.q[1], l.q[3] // 64), 1000 * e.chance // greatest(m.q[2], 1)) AS beyond
    FROM ({_EACH}) e JOIN quartiles l ON e.lang IS NOT DISTINCT FROM l.lang AND e.source IS NOT DISTINCT FROM l.source AND e.figure = l.figure
    JOIN quartiles m ON e.lang IS NOT DISTINCT FROM m.lang AND e.source IS NOT DISTINCT FROM m.source AND e.unit = m.figure) GROUP BY doc_id)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(v.ok, true) AS kept
FROM judged j LEFT JOIN verdicts v ON j.doc_id = v.doc_id
"""
