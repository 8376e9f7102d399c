"""The semantic cache: batch against its definition, stream against batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators.cache import semantic_lookup
from marginalia.streaming.cache import PROVIDER, cache_stream

SCHEMA = "seq long, level string, corpus_key string, question string, vector array<double>, at long"


def rows(n=160):
    rnd = random.Random(3)
    phrases = ["pets allowed", "are the pets allowed", "allowed pets", "beach days", None, "", "the of"]
    base = {p: np.array([rnd.gauss(0, 1) for _ in range(6)]) for p in ("a", "b")}
    out = []
    for i in range(n):
        v = base["ab"[rnd.random() < 0.3]] + np.array([rnd.choice([0, 0, 0.1, 0.4]) for _ in range(6)])
        out.append((i, rnd.choice(["default", "default", "restricted"]), rnd.choice("kkm"), phrases[0] if i % 3 == 0 else rnd.choice(phrases), None if i == 17 else v.tolist(), 10**9 + 1000 * i))
    return out


def expected(data, threshold, ttl=None, store=lambda hit: True):
    tokens = lambda q: None if q is None else " ".join(sorted({w for w in q.split() if w not in ("are", "the", "of")}))
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    entries, out = [], {}
    for seq, level, corpus, question, vector, _ in data:
        out[seq] = (None, None)
        if question == "" or vector is None:
            continue
        fits = [(cos(vector, v), s) for s, lv, c, q, v in entries if (lv, c, q) == (level, corpus, tokens(question)) and (ttl is None or seq - s <= ttl)]
        best = max((f for f in fits if f[0] >= threshold), default=None)
        if best:
            out[seq] = (best[1], best[0])
        if store(best):
            entries.append((seq, level, corpus, tokens(question), vector))
    return out


@pytest.mark.parametrize("threshold,ttl,span", [(0.95, None, 1 << 16), (0.99, None, 7), (0.9, 20, 10)])
def test_lookup(spark, threshold, ttl, span):
    data = rows()
    frame = spark.createDataFrame(data, SCHEMA)
    got = {r.seq: (r.hit, r.similarity) for r in semantic_lookup(frame, frame, threshold, ttl, span).collect()}
    assert got == expected(data, threshold, ttl) and sum(h is not None for h, _ in got.values()) > 20


@pytest.fixture
def arrive(spark, tmp_path):
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)

    def run(data, name, **more):
        """The data in two parts, one batch each, and a restart between."""
        found, folder = {}, tmp_path / name
        for part in (data[: len(data) // 2], data[len(data) // 2 :]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = cache_stream(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), **more)
            take = lambda batch, _: found.update({r.seq: (r.hit, r.similarity, r.evicted) for r in batch.collect()})
            stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return found

    yield run
    spark.conf.set(PROVIDER[0], before)


def test_stream_agrees_with_batch(spark, arrive):
    data = rows(80)
    got = arrive(data, "all", threshold=0.95, ttl_ms=10**15, most=10**6, store_hits=True)
    frame = spark.createDataFrame(data, SCHEMA)
    want = {r.seq: (r.hit, r.similarity) for r in semantic_lookup(frame, frame, 0.95).collect()}
    assert {s: v[:2] for s, v in got.items()} == {s: want[s] for s in got} and len(got) > 60


def test_stream_expires_and_evicts(spark, arrive):
    ask = lambda seq, v, at: (seq, "default", "k", "pets", v, 10**9 + at)
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    data = [ask(1, a, 0), ask(2, b, 1), ask(3, a, 2), ask(4, c, 3), ask(5, b, 4), ask(6, a, 5), ask(7, c, 50), ask(8, c, 200)]
    got = arrive(data, "lru", threshold=0.9, ttl_ms=60, most=2)
    # c pushes b out, as a was used later; b pushes a out; a pushes c out; then c is new, and is too old in the end
    assert {s: v[0] for s, v in got.items()} == {1: None, 2: None, 3: 1, 4: None, 5: None, 6: None, 7: None, 8: None}
    assert {s for s, v in got.items() if v[2]} == {4, 5, 6, 7}


def test_vectors_are_not_broadcast(spark, monkeypatch):
    """Small as files, large in the driver's memory: no join that carries vectors is a broadcast, whatever the threshold."""
    from marginalia.operators import cache

    plans, write = [], cache.written
    monkeypatch.setattr(cache, "written", lambda df: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), write(df))[1])
    frame = spark.createDataFrame(rows(40), SCHEMA)
    semantic_lookup(frame, frame).collect()
    carrying = [p for p in plans if "vector" in p and "Join" in p]
    assert len(carrying) >= 2 and not [p for p in carrying if any("BroadcastHashJoin" in x and "vector" in x for x in p.splitlines())]
    assert all("SortMergeJoin" in p for p in carrying)
