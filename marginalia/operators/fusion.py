"""Fusion, diversity and order of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(rankings: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) lists: (query_id, id, rrf)."""
    parts = [r.select("query_id", "id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for r, w in zip(rankings, weights or [1.0] * len(rankings))]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.sum("part").alias("rrf"))


def hybrid(dense: DataFrame, lexical: DataFrame, weights: tuple[float, float] = (1.0, 1.0), k: int = RRF_K) -> DataFrame:
    """Fusion of a dense (query_id, id, rank, cosine) and a lexical (query_id, id, rank, score) list: (query_id, id, rrf, cosine, score).

    Both scores travel with the ranks, so each list is used once. A row of one list only has no score of the other.
    """
    part = lambda w: F.lit(float(w)) / (k + F.col("rank"))
    none = F.lit(None).cast("double")
    both = dense.select("query_id", "id", part(weights[0]).alias("part"), "cosine", none.alias("score")).unionByName(lexical.select("query_id", "id", part(weights[1]).alias("part"), none.alias("cosine"), "score"))
    return both.groupBy("query_id", "id").agg(F.sum("part").alias("rrf"), F.max("cosine").alias("cosine"), F.max("score").alias("score"))


def fold(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def mmr(candidates: DataFrame, n: int, lam: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over (query_id, pos, id, relevance, vector): the n picks of each query, (query_id, id, pick).

    Greedy and so sequential within a query; a query's candidates are a short list, and queries run in parallel.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        rel = rows["relevance"].to_numpy(float)
        span = (rel.max() - rel.min()) or 1.0
        rel = (rel - rel.min()) / span
        m = np.array([np.asarray(v, float) for v in rows["vector"]])
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        near, chosen = np.zeros(len(rows)), []
        for _ in range(min(n, len(rows))):
            gain = np.round(lam * rel - (1 - lam) * near, 9)
            gain[chosen] = -np.inf
            best = int(np.argmax(gain))
            near = m @ m[best] if not chosen else np.maximum(near, m @ m[best])
            chosen.append(best)
        return pd.DataFrame({"query_id": rows["query_id"].iloc[chosen], "id": rows["id"].iloc[chosen], "pick": range(1, len(chosen) + 1)})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, id long, pick int")


def lost_in_the_middle(position: Column, size: Column) -> Column:
    """Place (from 1) of the item at position (from 1): 1, 3, 5, ... in front, then ..., 4, 2."""
    return F.when(position % 2 == 1, (position + 1) / 2).otherwise(size + 1 - position / 2).cast("int")


def mmr_relevance(scores: Column, position: Column, by: Window) -> Column:
    """Rerank scores where all of a query's rows have one, else 1 / position."""
    return F.when(F.count_if(scores.isNull()).over(by) == 0, scores).otherwise(1.0 / position)
