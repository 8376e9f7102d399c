"""Vector expressions and exact top-k search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Bytes of query vectors that are shipped to the tasks at a time; more queries go in further blocks.
QUERY_BYTES = 32 << 20


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths or a zero norm."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot(a, b) / n).otherwise(0.0)


def truncate(v: Column, dims: int) -> Column:
    """The first dims entries, scaled to norm 1 (zero vectors stay)."""
    head = _doubles(F.slice(v, 1, dims))
    return F.when(norm(head) > 0, F.transform(head, lambda x: x / norm(head))).otherwise(head)


def topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", dims: int | None = None, scopes: str | None = None, scope: str | None = None) -> DataFrame:
    """Exact nearest rows by cosine: (query_id, id, cosine, rank), ties by id.

    Query vectors go to the tasks in blocks of bounded size; each batch of corpus rows is one matrix product and keeps its
    k best per query, so only candidates are shuffled. Vectors of another length than the query's score 0. With scopes (an
    array of longs of each row) and scope (a long of each query) a query sees only the rows that have its scope.
    """
    own = queries.select(F.col(query_id).cast("long").alias("q"), _doubles(F.col(query_vector)).alias("v"), (F.col(scope).cast("long") if scope else F.lit(None).cast("long")).alias("s"))
    total = own.agg(F.coalesce(F.sum(F.size("v") * 8), F.lit(0))).first()[0]
    blocks = -(-total // QUERY_BYTES) or 1
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), _doubles(F.col(vector_col)).alias("v"), *([F.col(scopes).alias("s")] if scopes else []))
    out = None
    for b in range(blocks):
        block = own.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).orderBy("q").collect()
        part = rows.mapInArrow(_best([(r.q, r.v, r.s) for r in block], k, dims), "query_id long, id long, cosine double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _seen(lists: pa.Array, scopes: list[int]) -> list[np.ndarray]:
    """For each scope the rows whose list has it."""
    sizes = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    return [np.sort(owner[np.searchsorted(values, s) : np.searchsorted(values, s, "right")]) for s in scopes]


def _best(queries: list[tuple[int, list[float], int | None]], k: int, dims: int | None):
    ids = [q for q, _, _ in queries]
    width = max((len(v) for _, v, _ in queries), default=0)
    cut = min(dims or width, width)
    scopes = sorted({s for _, _, s in queries if s is not None})
    place = {s: i for i, s in enumerate(scopes)}

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m[:, :cut], axis=1, keepdims=True)
        return np.divide(m[:, :cut], n, out=np.zeros_like(m[:, :cut]), where=n > 0)

    matrix = np.zeros((len(queries), width))
    for i, (_, v, _) in enumerate(queries):
        matrix[i, : len(v)] = v
    matrix = unit(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            fits = np.flatnonzero((sizes == width) & lists.is_valid().to_numpy(zero_copy_only=False))
            own = batch.column(0).to_numpy(zero_copy_only=False)
            scores = np.zeros((len(ids), batch.num_rows))
            if len(fits):
                values = lists.flatten().to_numpy(zero_copy_only=False)
                starts = np.concatenate(([0], np.cumsum(np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0))))[:-1]
                scores[:, fits] = matrix @ unit(values[starts[fits][:, None] + np.arange(width)]).T
            seen = _seen(batch.column(2), scopes) if batch.num_columns > 2 else []
            everything = np.arange(batch.num_rows)
            for (q, _, scope), exact in zip(queries, scores):
                there = seen[place[scope]] if scope is not None else everything
                row = np.round(exact[there], 9)
                n = min(k, len(there))
                if not n:
                    continue
                at = np.flatnonzero(row >= np.partition(row, len(row) - n)[len(row) - n])  # with all that tie at the edge
                at = there[at[np.lexsort((own[there[at]], -row[at]))][:n]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q)), pa.array(own[at]), pa.array(exact[at])], names=["query_id", "id", "cosine"])

    return run


@F.arrow_udf(ArrayType(DoubleType()))
def hash_vector(lists: pa.Array) -> pa.Array:
    """Offline embedding of word lists: counts by the last byte of each word's MD5, scaled to norm 1 (256 entries)."""
    words = lists.flatten().dictionary_encode()
    last = np.array([hashlib.md5(w.encode()).digest()[-1] for w in words.dictionary.to_pylist()], dtype=np.int64)
    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
    row = np.repeat(np.arange(len(lists)), sizes)
    counts = np.bincount(row * 256 + last[words.indices.to_numpy()], minlength=256 * len(lists)).reshape(-1, 256).astype(float)
    norms = np.linalg.norm(counts, axis=1, keepdims=True)
    values = np.divide(counts, norms, out=counts, where=norms > 0).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * 256), pa.array(values))
