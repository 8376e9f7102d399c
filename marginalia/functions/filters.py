"""Filters as nested dicts, compiled to a column.

{field: value} or {field: {op: value}} with $eq $ne $in $nin $gt $gte $lt $lte, joined by $and / $or lists. A missing field
passes $ne and $nin and fails the rest; an empty $or passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = {"default": ("public", "internal"), "restricted": ("public", "internal", "top-secret")}


def _one(field: str, op: str, value) -> Column:
    col = F.col(field)
    if op == "$eq":
        return col.eqNullSafe(value)
    if op == "$ne":
        return ~col.eqNullSafe(value)
    if op in ("$in", "$nin"):
        inside = F.coalesce(col.isin(list(value)), F.lit(False))
        return inside if op == "$in" else ~inside
    compare = {"$gt": col.__gt__, "$gte": col.__ge__, "$lt": col.__lt__, "$lte": col.__le__}
    if op not in compare:
        raise ValueError(f"unknown filter operator: {op}")
    return F.coalesce(compare[op](value), F.lit(False))


def compile_filter(where: dict | None) -> Column:
    parts = []
    for key, value in (where or {}).items():
        if key in ("$and", "$or"):
            inner = [compile_filter(x) for x in value]
            if inner:
                parts.append(reduce(Column.__and__ if key == "$and" else Column.__or__, inner))
        elif isinstance(value, dict):
            parts += [_one(key, op, v) for op, v in value.items()]
        else:
            parts.append(_one(key, "$eq", value))
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def access_filter(level: str) -> dict:
    return {"classification": {"$in": LEVELS.get(level, LEVELS["default"])}}


def base_filter(level: str, filters: dict | None = None, active_only: bool = False, fields: tuple[str, ...] = ("department", "clause_type", "doc_type")) -> dict:
    """What a caller may see, active documents only if asked for, and the given fields: one value or a list of them; empty ones don't count."""
    where = access_filter(level) | ({"status": "active"} if active_only else {})
    for key in fields:
        value = (filters or {}).get(key)
        if value:
            where[key] = {"$in": list(value)} if isinstance(value, (list, tuple)) else value
    return where


def visible(classification: Column, level: str) -> Column:
    """The check after retrieval: what has no classification counts as top-secret."""
    return F.coalesce(classification, F.lit("top-secret")).isin(list(LEVELS.get(level, LEVELS["default"])))
