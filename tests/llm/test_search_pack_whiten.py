"""op11, op12 and op13 against brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from marginalia.llm import lexical_search as X
from marginalia.llm import packing as P
from marginalia.llm import whitening as W

# ---- op11


def test_rank_one_updates():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 40):
        for t in range(40):
            q = np.linalg.qr(rng.normal(size=(d, d)))[0]
            values = np.sort(rng.choice([0, 0, 1, 1, 2.5, 1e-8, 7], d) + (rng.random(d) if t % 2 else 0))
            v = rng.normal(size=d) * 10.0 ** rng.integers(-6, 6)
            if t % 3 == 0:
                v[rng.random(d) < 0.5] = 0
            got, basis = W.rank_one(values, q, v, 0.7)
            want = q @ np.diag(values) @ q.T + 0.7 * np.outer(v, v)
            size = max(np.abs(want).max(), 1e-300)
            assert np.abs(basis @ np.diag(got) @ basis.T - want).max() < 1e-12 * size
            assert np.abs(basis.T @ basis - np.eye(d)).max() < 1e-12
            assert np.abs(np.linalg.eigvalsh(want) - got).max() < 1e-12 * size


def whitened(rows, d, k):
    """(n, deviations, whitened, shares) from an eigendecomposition of the whole covariance."""
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in v] for v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:k]
    return n, ((n * x - s) ** 2).sum(axis=1), (n * x - s) / n @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening(spark):
    rng = np.random.default_rng(3)
    d = 6
    data = (rng.normal(size=(300, d)) * np.linspace(0.1, 3, d)).astype(np.float32).tolist()
    data += data[:40] + [data[7]] * 60  # copies count once in the fit
    rows = [(i, v, "x", 1) for i, v in enumerate(data)]
    rows += [(None, data[3], None, None), (900, None, "", 0), (901, [], "", 0), (902, [1.0] * (d - 1) + [None], "", 0), (903, [float("nan")] * d, "", 0), (904, [float("-inf")] + [0.0] * (d - 1), "", 0), (905, [1.0] * (d - 1), "", 0)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, component int").repartition(9), components=4).collect()
    n, deviation, white, share = whitened(data + [data[3]], d, 4)
    assert len(got) == 4 * (len(data) + 1) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    signs = {}
    for r in sorted(got, key=lambda r: (r.vec_id is None, r.vec_id)):
        i, c = len(data) if r.vec_id is None else r.vec_id, r.component - 1
        assert r.deviation == deviation[i] and abs(r.explained - share[c]) < 1e-9
        sign = signs.setdefault(c, 1.0 if r.whitened * white[i, c] > 0 else -1.0)
        assert abs(r.whitened - sign * white[i, c]) < 1e-9


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], schema)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    one = W.whiten(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    # the second direction does not vary
    flat = W.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 1.0]), (3, [4.0, 1.0])], schema)).collect()
    assert {(r.vec_id, r.component): None if r.whitened is None else round(abs(r.whitened), 9) for r in flat} == {(1, 1): 1.224744871, (2, 1): 0.0, (3, 1): 1.224744871, (1, 2): None, (2, 2): None, (3, 2): None}


# ---- op12


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path(P_FILE)


P_FILE = "byte_bpe_50k.json"


def test_word_by_word_ids_are_the_tokenizers(path):
    rnd, ids = random.Random(1), P.encoder(path)
    letters = "ab é\n\t  '’sdre12,.!<|>中  \x1c\x85İ🙂x"
    for t in range(4000):
        s = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))
        s = s + "<|endoftext|>" + s if t % 50 == 0 else s
        assert np.frombuffer(ids(s), "<u4").tolist() == ids.whole.encode(s, add_special_tokens=False).ids


def fewest(sizes, capacity):
    """The least number of bins, by trying everything."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity and bins[b] not in bins[:b]:
                go(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_combinations():
    rnd = random.Random(2)
    for _ in range(200):
        left = {rnd.randint(1, 30): rnd.randint(1, 4) for _ in range(rnd.randint(1, 6))}
        bin_ = P.fullest(left, 40)
        sums = {max(left)}
        for length, n in left.items():
            sums = {s + k * length for s in sums for k in range(n - (length == max(left)) + 1) if s + k * length <= 40}
        assert max(left) in bin_ and sum(x * k for x, k in bin_.items()) == max(sums) and all(k <= left[x] for x, k in bin_.items())


def test_plans_are_close_to_the_fewest():
    rnd, over = random.Random(5), 0
    for _ in range(60):
        sizes = sorted((rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))), reverse=True)
        plan = P.plan(dict(Counter(sizes)), 40)
        over += plan.n_sequences - fewest(sizes, 40)
    assert over == 0
    many = {length: rnd.randint(0, 400) for length in range(1, 400)}
    assert P.plan(many, 1024).n_sequences == -(-sum(x * n for x, n in many.items()) // 1024)


def test_packing(spark, path):
    rnd = random.Random(4)
    texts = [None, "", " ", "x" * 9000, "word " * 3000] + [" ".join("".join(rnd.choice("abcdé\n") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(0, 400))) for _ in range(80)] + ["same text again"] * 70
    docs = spark.createDataFrame([(i if i != 9 else None, t, "p", 7) for i, t in enumerate(texts)], "doc_id long, text string, piece string, sequence_id int").repartition(7)
    got = P.pack(docs, lambda: P.encoder(path), capacity=200).collect()
    ids = {i if i != 9 else None: [*P.encoder(path).whole.encode(t or "", add_special_tokens=False).ids, P.END] for i, t in enumerate(texts)}
    by, fill = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by.keys() == ids.keys()
    for i, rows in by.items():
        at = 0
        for k, r in enumerate(sorted(rows, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= 200 and (k == 0 or r.length == 200)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 200
    assert len(fill) == -(-sum(map(len, ids.values())) // 200)
    assert P.pack(docs.limit(0), lambda: P.encoder(path)).collect() == []


# ---- op13


def brute(docs, items, k):
    found = lambda t: [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    split = [found(t) for _, t in docs]
    n_docs, total = sum(bool(s) for s in split), sum(map(len, split))
    df = Counter(t for s in split for t in set(s))
    out = []
    for item, text in items:
        rows = []
        for (doc, _), s in zip(docs, split):
            tf, score = Counter(s), 0
            for t in dict.fromkeys(found(text)):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * tf[t] // (1000 * tf[t] + 20 * (50 + 50 * len(s) * n_docs // total)))
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket,first,item_bytes", [(4096, 0.02, 1 << 20), (7, 0.3, 1 << 20), (16, 0.1, 600)])
def test_search(spark, monkeypatch, bucket, first, item_bytes):
    """Small buckets, other first shares and several blocks of items give the same ranks."""
    monkeypatch.setattr(X, "BUCKET", bucket)
    monkeypatch.setattr(X, "FIRST", first)
    monkeypatch.setattr(X, "ITEM_BYTES", item_bytes)
    rnd = random.Random(6)
    word = lambda: rnd.choice(["the", "of", "The", "and", "é", "x2"]) if rnd.random() < 0.5 else "".join(rnd.choice("abcDé") for _ in range(rnd.randint(1, 3)))
    text = lambda n: rnd.choice([" ", "-", "\n"]).join(word() for _ in range(n))
    items = [(i, text(rnd.randint(1, 25))) for i in range(20)] + [(20, None), (21, ""), (22, "..."), (23, "nowhereatall"), (3, "the of"), (None, text(9))]
    docs = [(i, text(rnd.randint(1, 60))) for i in range(150)]
    docs += [(200 + i, f"{text(3)} {items[i % 20][1]}") for i in range(40)] + [(300 + i, docs[5][1]) for i in range(60)]  # copies: ties
    docs += [(None, docs[5][1]), (400, None), (401, ""), (402, "?!"), (403, docs[5][1]), (403, docs[5][1]), (404, text(20000))]
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, score int, item_id string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = X.lexical_search(frame, asked, k=12).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == brute(docs, items, 12)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert X.lexical_search(docs, items).collect() == []
    assert X.lexical_search(spark.createDataFrame([(1, "a")], docs.schema), items.limit(0)).collect() == []
    assert X.lexical_search(spark.createDataFrame([(1, "z")], docs.schema), items).collect() == []
    # a term that every document has still weighs a little
    assert [tuple(r) for r in X.lexical_search(spark.createDataFrame([(1, "a")], docs.schema), items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 20 * 100)))]
