"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of one to three code points of the lower-cased text (with what is not a letter as one border sign),
hashed into DIMENSIONS buckets, weighted 1 + ln(tf) times ln((1 + N) / (1 + df)) and normalised. Document frequencies come
from all training documents. The classifier is fitted on a bounded sample of them (SAMPLE documents, spread over the
languages, and LEAST of each at the least) by follow-the-regularised-leader with elastic-net penalties: the sample is dealt
into SHARDS; in each of EPOCHS rounds every shard goes on from the mean state of the round before in a task of its own. A
tenth of the sample is held back to fit the temperature that calibrates the scores.

Every language that a training row has is learned. The state is kept per block of CLASS_BLOCK languages: with several
blocks, each has one more class for all other languages, and a language's logit is that of its class less that of the rest.

Defined cases: a null text or one without a letter is ``und`` at score 0, and so is every text if nothing was learned; a
null id is in no held-out set and never trains; training rows need a language; repeated rows count each; equal scores go to
the first language in alphabetical order; very long texts are counted whole; an empty table gives an empty result; further columns are passed through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import materialise, plain
from marginalia.llm.hashing import U, mix

DIMENSIONS = 1 << 14
ORDERS = 3
SAMPLE = 8000
LEAST = 20
CLASS_BLOCK = 100
SHARDS, EPOCHS = 4, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"
_CHUNK = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """How often each bucket's n-grams occur; None if the text has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total, any_letter = np.zeros(dimensions, np.int64), False
    for s in range(0, len(points), _CHUNK):
        part = points[max(0, s - ORDERS + 1) : s + _CHUNK].astype(np.uint64)
        letter = _letters()[part.astype(np.int64)]
        any_letter = any_letter or bool(letter.any())
        part = np.where(letter, part, U(0))
        part = part[np.concatenate(([True], (part[1:] > 0) | (part[:-1] > 0)))]  # one border sign for a run
        key = np.zeros(len(part), np.uint64)
        for n in range(1, ORDERS + 1):
            if len(part) >= n:
                key = key[: len(part) - n + 1] * U(0x100000001B3) + part[n - 1 :]
                found = mix(key + U(n << 60))[key > 0]
                total += np.bincount((found & U(dimensions - 1)).astype(np.int64), minlength=dimensions)
    return total if any_letter else None


def _features(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(count)
    value = (1 + np.log(count[at])) * idf[at]
    return at, value / (math.sqrt(float(value @ value)) or 1.0)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _learn(z: np.ndarray, n: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """One pass of FTRL-proximal over (class, buckets, values), in place."""
    for y, at, value in rows:
        w = _weights(z[at], n[at])
        p = _softmax(value @ w)
        p[y] -= 1
        g = value[:, None] * p[None, :]
        g2 = g * g
        z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / ALPHA * w
        n[at] += g2


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(plain(id_col).cast("string")) % 4 == 2, F.lit(False))


def _round(z: np.ndarray, n: np.ndarray):
    """A shard's pass, which starts from the state (z, n)."""

    def run(rows: pa.Table) -> pa.Table:
        own_z, own_n = z.copy(), n.copy()
        parts = sorted(zip(*(rows.column(c).to_pylist() for c in ("order", "y", "at", "value"))))
        _learn(own_z, own_n, [(y, np.frombuffer(at, np.int32), np.frombuffer(value)) for _, y, at, value in parts])
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "z": pa.array([own_z.tobytes()]), "n": pa.array([own_n.tobytes()])})

    return run


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float) -> None:
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        count = counts(text, len(self.idf)) if self.languages else None
        if count is None:
            return UNKNOWN, 0.0
        at, value = _features(count, self.idf)
        p = _softmax((value @ self.weights[at]) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def document_frequencies(train: DataFrame, text_col: str, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, int]:
    """Per bucket the training documents that have it, and the documents with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(dimensions + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count = counts(text, dimensions)
                if count is not None:
                    df[:-1] += count > 0
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["bucket", "df"])

    rows = train.select(plain(text_col)).mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(dimensions + 1, np.int64)
    for r in rows:
        out[r.bucket] = r.df
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    train = docs.where(plain(id_col).isNotNull() & ~held_out(id_col) & plain(lang_col).isNotNull() & plain(text_col).isNotNull())
    sizes = train.groupBy(plain(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per language
    languages = sorted(r.lang for r in sizes)
    if not languages:
        return Model([], np.zeros(DIMENSIONS), np.zeros((DIMENSIONS, 0), np.float32), 1.0)
    df, n_docs = document_frequencies(train, text_col)
    idf = np.log((1 + n_docs) / (1 + df))
    # documents of a language are drawn by a hash of their id, at the rate that gives each language an equal part
    rates = {r.lang: min(1.0, max(LEAST, sample / len(languages)) / r.n) for r in sizes}
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])
    place = (F.xxhash64(plain(id_col), F.lit("sample")) % (1 << 30) + (1 << 30)) / (1 << 31)
    number = F.create_map(*[F.lit(x) for kv in enumerate(languages) for x in reversed(kv)])
    drawn = train.where(place < rate[plain(lang_col)]).select(number[plain(lang_col)].alias("y"), F.xxhash64(plain(id_col), F.lit("shard")).alias("order"), plain(text_col).alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for y, order, text in zip(*(c.to_pylist() for c in batch.columns)):
                count = counts(text, len(idf))
                if count is not None:
                    at, value = _features(count, idf)
                    rows.append((order % 10 == 0, order // 10 % SHARDS, order, y, at.astype(np.int32).tobytes(), value.tobytes()))
            kinds = (pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["calibrate", "shard", "order", "y", "at", "value"])

    rows = materialise(drawn.mapInArrow(featurise, "calibrate boolean, shard int, `order` long, y int, at binary, value binary"))

    parts = []
    for low in range(0, len(languages), CLASS_BLOCK):
        own = min(CLASS_BLOCK, len(languages) - low)
        several = own < len(languages)
        # repartitionByRange gives each shard a task of its own
        y = F.when((F.col("y") >= low) & (F.col("y") < low + own), F.col("y") - low).otherwise(own).cast("int")
        dealt = rows.where("NOT calibrate").withColumn("y", y).repartitionByRange(SHARDS, "shard")
        z = n = np.zeros((len(idf), own + several))
        for _ in range(EPOCHS):
            states = dealt.groupBy("shard").applyInArrow(_round(z, n), "shard int, z binary, n binary").orderBy("shard").collect()
            if states:
                z, n = (np.mean([np.frombuffer(bytes(s[k])).reshape(z.shape) for s in states], axis=0) for k in ("z", "n"))
        w = _weights(z, n)
        parts.append((w[:, :own] - w[:, own:] if several else w).astype(np.float32))
    weights = np.concatenate(parts, axis=1)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(np.frombuffer(value) @ weights[np.frombuffer(at, np.int32)]).tolist() for at, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["y", "logits"])

    held = rows.where("calibrate").select("y", "at", "value").mapInArrow(logits, "y int, logits array<double>").collect()
    return Model(languages, idf, weights, _temperature(np.array([r.y for r in held], int), np.array([r.logits for r in held]).reshape(len(held), len(languages))))


def _temperature(y: np.ndarray, logits: np.ndarray) -> float:
    """The temperature of least log loss, from a fine grid."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        x = logits / t
        top = x.max(axis=1)
        return float(np.mean(np.log(np.exp(x - top[:, None]).sum(axis=1)) + top - x[np.arange(len(y)), y]))

    return min(np.geomspace(0.1, 10, 121), key=loss)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns by default), lang_pred and score."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    source = docs.select(*[plain(c) for c in names], plain(text_col).alias("__langid_text"))
    schema = docs.select(*[plain(c) for c in names]).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(s, 500) for whole in batches for s in range(0, whole.num_rows, 500)):
            found = [model.predict(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: id, held_out, lang_pred, score; learned from the documents that aren't held out."""
    model = fit(docs, id_col, text_col, lang_col, sample)
    return predict(docs.select(plain(id_col), held_out(id_col).alias("held_out"), plain(text_col)), model, text_col, [id_col, "held_out"])
