"""Around an answer: siblings, citations, cache, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def siblings(hits: DataFrame, chunks: DataFrame, section: list[str]) -> DataFrame:
    """hits (with pos) and, after the first hit of each section, the section's other chunks: sibling is 0 or 1."""
    first = hits.groupBy(*section).agg(F.min("pos").alias("pos"))
    more = chunks.join(first, section).join(hits.select("id"), "id", "left_anti").withColumn("sibling", F.lit(1))
    return hits.withColumn("sibling", F.lit(0)).unionByName(more.select(*hits.columns, "sibling"))


def cited(answer: Column, source: Column, least: int = 3) -> Column:
    """Whether an answer's words support a source: at least three shared ones, or one with a digit."""
    shared = F.array_intersect(answer, source)
    return (F.size(shared) >= least) | F.exists(shared, lambda w: w.rlike("[0-9]"))


def cache_lookup(entries: DataFrame, key: str, columns: list[str], seq: str) -> DataFrame:
    """For each entry the seq of the latest earlier one with the same key (null: a miss).

    A running maximum per key, so a popular question costs as many rows as it was asked.
    """
    by = Window.partitionBy(key).orderBy(seq)
    return entries.withColumn("hit", F.lag(seq).over(by)).select(*columns, "hit")


def expire(entries: DataFrame, id_col: str, used: str, days: int, most: int) -> DataFrame:
    """Entries within days of the last use of any, the most recent ones, with their age rank."""
    now = entries.agg(F.max(used)).first()[0]
    live = entries.where(F.col(used) >= F.lit(now) - F.expr(f"INTERVAL {days} DAY"))
    return live.orderBy(F.desc(used), id_col).limit(most).withColumn("age", F.row_number().over(Window.orderBy(F.desc(used), id_col)).cast("long"))


def price(costs: dict[str, tuple[float, float]], model: Column, tokens: Column, searches: Column) -> Column:
    """Cost from a table of (per search, per 1000 tokens), with its 'default' row for unknown models."""
    pick = lambda i: F.coalesce(F.create_map(*[F.lit(x) for k, v in costs.items() for x in (k, float(v[i]))])[model], F.lit(float(costs["default"][i])))
    return searches * pick(0) + tokens / 1000 * pick(1)
