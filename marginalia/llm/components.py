"""Connected components of a table of edges, by joins and checkpoints alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, root): root is the least id of id's component.

    Alternates two steps until nothing changes: link every vertex's larger neighbours to its least neighbour (or itself),
    then its smaller neighbours likewise. Both keep the components and take about log(vertices) rounds.
    """
    now = materialise(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        # large star: over both directions; least neighbours are written first, so that Spark can split a hot vertex in the joins
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m")))
        large = materialise(both.where("b > a").join(least, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: each vertex keeps its least smaller neighbour and links the other ones to it
        smallest = materialise(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), "m"))
        small = large.join(smallest, F.col("a") == F.col("v")).select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).union(smallest.select("v", "m")).distinct()
        old = now
        now = materialise(small)
        discard(old, least, large, smallest)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = mark
