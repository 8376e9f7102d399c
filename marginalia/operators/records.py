"""Checks and precedence of chunk records, and re-association of reranked texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("policy", "version", "heading_path", "text")


def problem(required: tuple[str, ...] = REQUIRED) -> Column:
    """The first required field that is missing or blank, with the real reason; null for a good record."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing field: {c}")).when(F.trim(c) == "", F.lit(f"blank field: {c}")) for c in required]
    return F.coalesce(*checks)


def quarantine(rows: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with their problem); strict raises on any rejected row before anything is written."""
    marked = rows.withColumn("problem", problem())
    bad = marked.where("problem IS NOT NULL")
    if strict and not bad.isEmpty():
        raise ValueError(f"{bad.count()} bad records, the first: {bad.first().problem}")
    return marked.where("problem IS NULL").drop("problem"), bad


def reassociate(items: DataFrame, returned: DataFrame, query: str = "query_id") -> DataFrame:
    """items (query, id, pos, text) in the order of returned (query, ord, text); equal texts are used up first come, first served.

    Returned texts that no item has are ignored; items that weren't returned follow in their own order.
    """
    nth = lambda by: F.row_number().over(Window.partitionBy(query, "key").orderBy(by))
    keyed = lambda df: df.withColumn("key", F.sha2("text", 256))
    i = keyed(items).withColumn("n", nth("pos")).select(query, "id", "pos", "key", "n")
    r = keyed(returned).withColumn("n", nth("ord")).select(query, "ord", "key", "n")
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.asc_nulls_last("ord"), "pos"))
    return i.join(r, [query, "key", "n"], "left").withColumn("place", place).select(query, "id", "place")


def enriched_status(manifest: Column, stored: Column, admin: Column) -> Column:
    """What an administrator set, then the manifest, then what was stored, then active."""
    return F.coalesce(admin, manifest, stored, F.lit("active"))


def answer_prose(answer: Column) -> Column:
    """An answer without what follows its last blank line (its citations)."""
    return F.regexp_replace(answer, r"(?s)^(.*)\n\s*\n.*$", "$1")
