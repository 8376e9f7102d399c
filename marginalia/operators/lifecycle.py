"""Version lifecycles: latest versions, effective ranges, point-in-time scope, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import date_number, version_key

OPEN_END = 99991231


def plan(catalog: DataFrame, policy: str = "policy", version: Column | None = None) -> DataFrame:
    """catalog with is_latest (the highest active version), effective_to (the next version's start, '' at the end) and both dates as numbers."""
    key = version_key(F.col("version")) if version is None else version
    rows = catalog.withColumn("__key", key)
    by = Window.partitionBy(policy)
    newest = F.max(F.when(F.col("status") == "active", F.col("__key"))).over(by)
    after = F.lead("effective_from").over(by.orderBy("__key"))
    return (
        rows.withColumn("is_latest", F.coalesce((F.col("__key") == newest) & (F.col("status") == "active"), F.lit(False)))
        .withColumn("effective_to", F.coalesce(after, F.lit("")))
        .withColumn("effective_from_num", date_number(F.col("effective_from"), 0))
        .withColumn("effective_to_num", date_number(F.col("effective_to"), OPEN_END))
        .drop("__key")
    )


def in_force(planned: DataFrame, day: int, policy: str = "policy") -> DataFrame:
    """Of each policy the highest version with from <= day < to."""
    at = planned.where((F.col("effective_from_num") <= day) & (F.col("effective_to_num") > day))
    return at.groupBy(policy).agg(F.max_by("version", version_key(F.col("version"))).alias("version"))


def changed(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of new whose columns differ from old's, or that old lacks."""
    before = old.select(*keys, F.struct(*columns).alias("__old"))
    return new.join(before, keys, "left").where(~F.struct(*columns).eqNullSafe(F.col("__old"))).drop("__old")


def compare_targets(versions: Column, named: Column) -> Column:
    """(older, newer) to compare, from sorted versions and the named ones among them (sorted)."""
    last = F.try_element_at(versions, F.lit(-1))
    one = F.try_element_at(named, F.lit(1))
    before = F.when(F.array_position(versions, one) > 1, F.try_element_at(versions, (F.array_position(versions, one) - 1).cast("int")))
    return (
        F.when(F.size(named) >= 2, F.struct(one.alias("older"), F.try_element_at(named, F.lit(-1)).alias("newer")))
        .when((F.size(named) == 1) & (one != last), F.struct(one.alias("older"), last.alias("newer")))
        .when(F.size(named) == 1, F.struct(before.alias("older"), one.alias("newer")))
        .otherwise(F.struct(F.try_element_at(versions, F.lit(-2)).alias("older"), last.alias("newer")))
    )


def compare(newer: DataFrame, older: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join of two versions' sections on key: present in both, added or removed. Sides are (key, id, text)."""
    n = newer.select(*key, F.struct("id", "text").alias("current"))
    o = older.select(*key, F.struct("id", "text").alias("previous"))
    kind = F.when(F.col("previous").isNull(), "added").when(F.col("current").isNull(), "removed").when(F.col("current.text") == F.col("previous.text"), "same").otherwise("changed")
    return n.join(o, key, "full_outer").withColumn("kind", kind)
