"""Semantic answer cache over tables: which earlier entry answers a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import content_tokens
from marginalia.functions.vectors import cosine
from marginalia.sources.shared import written

THRESHOLD = 0.95
BLOCK = ["level", "corpus_key", "tokens"]


def question_key(question: Column) -> Column:
    """Equal for compatible questions: the same content tokens, or no question on either side. An empty question has none."""
    return F.when(question.isNull(), "-").when(question != "", F.concat(F.lit("+"), F.array_join(content_tokens(question), " ")))


def semantic_lookup(asked: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, ttl: int | None = None, span: int = 1 << 16) -> DataFrame:
    """Per asked row (seq, level, corpus_key, question, vector) the entry that answers it: (seq, hit, similarity), null where none does.

    An entry (same columns) can answer if it is earlier, not older than ttl, of the same access level and corpus, of a
    compatible question and of at least the threshold's cosine; the most similar one does, of equally similar ones the latest.

    Equal vectors of a block are one class, and only classes are compared, so a popular question costs a row each time it is
    asked. The latest entry of a class before a question is found by a running maximum over spans of seq, and over the spans
    before, so that a popular class is dealt to many tasks.
    """
    keyed = lambda rows: rows.select("seq", "level", "corpus_key", question_key(F.col("question")).alias("tokens"), F.col("vector").cast("array<double>").alias("vector")).where("tokens IS NOT NULL AND vector IS NOT NULL")
    a, e = written(keyed(asked)), written(keyed(entries))
    classes = written(a.select(*BLOCK, "vector").union(e.select(*BLOCK, "vector")).distinct().select("*", F.monotonically_increasing_id().alias("class")))
    # equal vectors take a few bytes each as files and a thousand times that in memory, so the files' size must not lead to a broadcast
    in_class = lambda rows: rows.join(classes.hint("merge"), [*BLOCK, "vector"]).select("seq", "class")
    other = classes.select(*BLOCK, F.col("vector").alias("other_vector"), F.col("class").alias("other"))
    near = written(classes.join(other.hint("merge"), BLOCK).select("class", "other", cosine(F.col("vector"), F.col("other_vector")).alias("similarity")).where(F.col("similarity") >= threshold))
    probes = in_class(a).join(near, "class").select("seq", F.col("other").alias("class"), F.round("similarity", 9).alias("similarity"))
    none = F.lit(None).cast("double")
    events = written(probes.select("seq", "class", "similarity", F.lit(None).cast("long").alias("entry")).union(in_class(e).select("seq", "class", none, F.col("seq"))).withColumn("part", F.floor(F.col("seq") / span)))
    # in a span: the last entry before, by seq; a question comes before an entry of its own seq
    by = Window.partitionBy("class", "part").orderBy("seq", F.col("entry").isNotNull())
    inside = events.withColumn("inside", F.last("entry", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))).where("entry IS NULL")
    spans = written(events.groupBy("class", "part").agg(F.max("entry").alias("latest")))
    before = F.max("latest").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    found = inside.join(spans.select("class", "part", before.alias("before")), ["class", "part"]).withColumn("hit", F.coalesce("inside", "before")).where("hit IS NOT NULL")
    if ttl is not None:
        found = found.where(F.col("seq") - F.col("hit") <= ttl)
    best = found.groupBy("seq").agg(F.max(F.struct("similarity", "hit")).alias("best"))
    return asked.select("seq").join(best, "seq", "left").select("seq", F.col("best.hit").alias("hit"), F.col("best.similarity").alias("similarity"))
