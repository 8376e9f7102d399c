"""Ranked lexical search by norm buckets.

A document's vector has, for each term, the square root of the term's weight times the term's impact in the document; an
item's vector has the square roots alone, so that their inner product is the score. Vectors only have terms that some item
of the block has, which changes no score.

Vectors are ordered by length over all tasks (equal lengths are dealt by row number) and written in that order. The longest
ones are searched first, for a lower bound of each item's k-th best score. Then everything is searched whose length can reach
the bound of some item, which prunes whole files and row groups. A task takes a bucket of vectors of neighbouring length at
a time, against each item:

* Cauchy-Schwarz: the item's length times the bucket's greatest bounds every score; below the k-th best, the bucket is done.
* Coordinates: of the item's coordinates by falling size the fewest are taken so that the rest cannot reach the k-th best
  by itself; only vectors with one of these are looked at, and each has the bound of its own: what they give, plus the
  length of the item's rest times that of the vector's.
* What is left is scored exactly, in 64-bit integers.

Bounds leave room for rounding, so no document is lost by them; they decide the time only. Items are searched in blocks of
ITEM_BYTES of text, with a pass over the corpus each.

Defined cases: a null or empty text has no terms, and a null or empty item no result; null ids stay, a null doc_id comes
after all others of its score; repeated rows are ranked each, equal ones in the order of their rows; repeated items have
results each; very long texts count whole; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import blocks_for, discard, materialise, plain

K = 50
#: Bytes of items' text that are searched in one pass, bytes of vectors in a partition, vectors in a bucket.
ITEM_BYTES, PART_BYTES, BUCKET = 8 << 20, 16 << 20, 4096
#: Share of the vectors, by length, that gives the first bounds.
FIRST = 0.02
_ROOM = 1e-9
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case."""
    return text.translate(_TERM).split()


@dataclass
class Items:
    """A block of items: ids, each one's term numbers, and the numbers of terms."""

    ids: list
    columns: list[np.ndarray]
    number: dict[bytes, int]


def _block(rows: list) -> Items:
    number: dict[bytes, int] = {}
    columns = [np.array([number.setdefault(t, len(number)) for t in dict.fromkeys(terms(r.text or b""))], np.int64) for r in rows]
    return Items([r.id for r in rows], columns, number)


def _counts(docs: DataFrame, id_col: str, text_col: str, number: dict[bytes, int]) -> DataFrame:
    """Per document: id, row, n (all terms), and the numbers and occurrences of the items' terms in it."""
    source = docs.select(plain(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), plain(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(s, 500) for whole in batches for s in range(0, whole.num_rows, 500)):
            n, at, tf = [], [], []
            for text in batch.column(2):
                found = terms(text.as_py() or b"")
                own = sorted((number[t], c) for t, c in Counter(found).items() if t in number)
                n.append(len(found))
                at.append(np.array([t for t, _ in own], np.int32).tobytes())
                tf.append(np.array([c for _, c in own], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(at, pa.binary()), pa.array(tf, pa.binary())], names=["id", "row", "n", "at", "tf"])

    return source.mapInArrow(run, source.select("id", "row").schema.add("n", "long").add("at", "binary").add("tf", "binary"))


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's values, one after the other, and how many each row has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.array([len(p) for p in parts], np.int64) // np.dtype(kind).itemsize


def _frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """Per term number the documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(_flat(batch.column(0), np.int32)[0], minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    rows = counts.select("at").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row per term of the block
    out = np.zeros(size, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return out


def _vectors(counts: DataFrame, n_docs: int, n_terms: int, weight: np.ndarray) -> DataFrame:
    """Per document with a weighted term: id, row, length, term numbers and impacts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes = _flat(batch.column(3), np.int32)
            tf = _flat(batch.column(4), np.int32)[0].astype(np.int64)
            m = 50 + 50 * batch.column(2).to_numpy() * n_docs // n_terms
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, sizes))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            norm = np.sqrt(np.bincount(owner, weight[at] * impact.astype(float) ** 2, minlength=len(sizes)))
            edges = np.concatenate(([0], np.cumsum(sizes)))
            raw = impact.astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(norm), batch.column(3), pa.array([raw[4 * a : 4 * b] for a, b in zip(edges, edges[1:])], pa.binary())], names=["id", "row", "norm", "at", "impact"])

    return counts.where("octet_length(at) > 0").mapInArrow(run, counts.select("id", "row").schema.add("norm", "double").add("at", "binary").add("impact", "binary")).where("norm > 0")


class _Best:
    """The k best (score, id, row) of an item so far, as arrays, and the score that others have to reach."""

    def __init__(self, k: int, floor: int) -> None:
        self.k, self.floor = k, floor
        self.score, self.at = np.empty(0, np.int64), np.empty((0, 3), np.int64)  # null, id, row

    def take(self, score: np.ndarray, at: np.ndarray) -> None:
        score, at = np.concatenate((self.score, score)), np.concatenate((self.at, at))
        best = np.lexsort((at[:, 2], at[:, 1], at[:, 0], -score))[: self.k]
        self.score, self.at = score[best], at[best]
        if len(best) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


def _search(items: Items, weight: np.ndarray, floors: np.ndarray, k: int):
    size = len(items.number)
    queries = []
    for number, columns in enumerate(items.columns):
        columns = columns[weight[columns] > 0]
        columns = columns[np.argsort(-weight[columns], kind="stable")]
        own = weight[columns]
        # length of what is left after the first coordinates
        rest = np.sqrt(np.concatenate((np.cumsum(own[::-1])[::-1], [0])).astype(float))
        if len(own) and int(own.sum()) * 1_000_000 >= 1 << 53:
            raise ValueError("scores of an item with so many terms are not exact in doubles")
        queries.append((number, columns, own, rest))

    def bucket(best: list[_Best], key: np.ndarray, norm: np.ndarray, at: np.ndarray, sizes: np.ndarray, impact: np.ndarray) -> None:
        n, longest = len(norm), float(norm.max())
        owner = np.repeat(np.arange(n), sizes)
        order = np.argsort(at, kind="stable")
        post_owner, post_impact = owner[order], impact[order].astype(float)
        starts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=size))))
        edges = np.concatenate(([0], np.cumsum(sizes)))
        dense = np.zeros(size, np.int64)
        for number, columns, own, rest in queries:
            floor = max(best[number].floor, 1)
            if not len(own) or rest[0] * longest * (1 + _ROOM) < floor:
                continue
            lead = int(np.argmax(rest * longest * (1 + _ROOM) < floor))  # the last rest is 0, so there is one
            lists = [slice(starts[c], starts[c + 1]) for c in columns[:lead]]
            who = np.concatenate([post_owner[s] for s in lists])
            if not len(who):
                continue
            what = np.concatenate([post_impact[s] for s in lists])
            times = np.repeat(own[:lead].astype(float), [s.stop - s.start for s in lists])
            part = np.bincount(who, times * what, minlength=n)
            near = np.flatnonzero(part)
            if len(near) > k:  # k vectors have at least this much
                floor = max(floor, int(np.partition(part[near], -k)[-k]))
            if lead < len(own):
                used = np.bincount(who, times * what * what, minlength=n)[near]
                bound = part[near] + rest[lead] * np.sqrt(np.maximum(norm[near] ** 2 - used, 0) + _ROOM * norm[near] ** 2)
                near = near[bound * (1 + _ROOM) >= floor]
            else:
                near = near[part[near] >= floor]
            if not len(near):
                continue
            dense[columns] = own
            spans = sizes[near]
            entries = np.repeat(edges[near] - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
            score = np.add.reduceat(dense[at[entries]] * impact[entries], np.concatenate(([0], np.cumsum(spans)[:-1])))
            dense[columns] = 0
            keep = score >= floor
            if keep.any():
                best[number].take(score[keep], key[near[keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k, int(f)) for f in floors]
        for batch in (whole.slice(s, BUCKET) for whole in batches for s in range(0, whole.num_rows, BUCKET)):
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            key = np.stack((null, batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()), axis=1).astype(np.int64)
            at, sizes = _flat(batch.column(3), np.int32)
            if batch.num_rows:
                bucket(best, key, batch.column(2).to_numpy(), at, sizes, _flat(batch.column(4), np.int32)[0].astype(np.int64))
        for number, b in enumerate(best):
            if len(b.score):
                ids = pa.array(b.at[:, 1], mask=b.at[:, 0] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), number, np.int32)), ids, pa.array(b.at[:, 2]), pa.array(b.score)], names=["number", "doc_id", "row", "score"])

    return run


_FOUND = "number int, doc_id long, row long, score long"


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_result(docs: DataFrame, items: Items, id_col: str, text_col: str, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    counts = materialise(_counts(docs, id_col, text_col, items.number))
    whole = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.octet_length("at")), F.lit(0)).alias("bytes")).first()
    if not whole.bytes:
        discard(counts)
        return None
    df = _frequencies(counts, len(items.number))
    weight = np.array([math.floor(1000 * math.log((2 * whole.docs + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)
    vectors = _vectors(counts, whole.docs, whole.terms, weight)
    parts = blocks_for(spark, 2 * whole.bytes, PART_BYTES)
    ordered = materialise(vectors.repartitionByRange(parts, F.desc("norm"), F.xxhash64("row")).sortWithinPartitions(F.desc("norm")))
    discard(counts)
    floors = np.zeros(len(items.ids), np.int64)
    cut = ordered.agg(F.percentile_approx("norm", F.lit(1 - FIRST), F.lit(1000))).first()[0]
    if cut is None:
        return None
    for r in _top(ordered.where(F.col("norm") >= cut).mapInArrow(_search(items, weight, floors, k), _FOUND), k).where(F.col("rank") == k).collect():  # a row per item
        floors[r.number] = r.score
    reach = min((f / math.sqrt(max(int(weight[c].sum()), 1)) for f, c in zip(floors.tolist(), items.columns) if len(c)), default=0.0)
    return _top(ordered.where(F.col("norm") >= reach * (1 - _ROOM)).mapInArrow(_search(items, weight, floors, k), _FOUND), k)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per item its k best documents with a score above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    schema = items.select(plain(item_id).alias("item_id")).schema.add("rank", "integer").add("doc_id", "long").add("score", "long")
    asked = materialise(items.select(plain(item_id).alias("id"), plain(item_text).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row")))
    blocks = -(-(asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // ITEM_BYTES) or 1
    out = None
    for b in range(blocks):
        block = _block(asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").collect())  # about ITEM_BYTES
        if (ranked := _block_result(docs, block, id_col, text_col, k)) is None:
            continue
        part = _named(ranked, block, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _named(ranked: DataFrame, block: Items, schema) -> DataFrame:
    """Numbers of items as their ids."""
    kind = schema["item_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        ids = pa.array(block.ids, to_arrow_type(kind))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([ids.take(batch.column(0)), batch.column(1), batch.column(2), batch.column(3)], names=schema.names)

    return ranked.select("number", "rank", "doc_id", "score").mapInArrow(run, schema)


#: The same by joins.
SQL = """
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS t FROM documents),
items AS (SELECT row_number() OVER () AS number, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS t FROM benchmark),
whole AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM docs),
wanted AS (SELECT number, item_id, unnest(t) AS term FROM items),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
scores AS (SELECT i.number, i.item_id, t.row, t.doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + (50 * t.n * o.n_docs) // o.n_terms)))) AS BIGINT) AS score
  FROM wanted i JOIN tf t ON t.term = i.term JOIN weights w ON w.term = i.term, whole o GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS LAST, row) AS INTEGER) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""
