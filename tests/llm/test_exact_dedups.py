"""op6 and op7 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import debruijn_dedup as debruijn_dedup_module
from marginalia.llm import repeats
from marginalia.llm.debruijn_dedup import debruijn_dedup
from marginalia.llm.suffix_dedup import suffix_dedup, suffix_ranks


def brute(seqs, width):
    """Flags of covered tokens per sequence."""
    seen = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def texts():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 4)))
    passage = " ".join(word() for _ in range(40))
    out = [None, "", " \n", "ab " * 60, "x" * 90, passage]
    for i in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30))) for _ in range(2)]
        middle = passage if i % 3 == 0 else passage[20:-30] if i % 3 == 1 else ""
        out.append(f"{parts[0]} {middle}\n{parts[1]}")
    return out + out[-3:]


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_both(spark, monkeypatch, hot):
    """With hot = 1 every key goes the way of crowded ones."""
    monkeypatch.setattr(repeats.repeated_windows, "__defaults__", (hot,))
    rows = [(i, t, None, f"s{i}") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, id string")
    seqs = [(t or "").encode() for _, t, *_ in rows]
    got = {r.doc_id: r for r in suffix_dedup(docs, width=40, kept_text=True).collect()}
    assert len(got) == len(rows)
    for i, (s, gone) in enumerate(zip(seqs, brute(seqs, 40))):
        kept = bytes(b for b, g in zip(s, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) == (len(s), sum(gone), spans, kept, hashlib.sha256(kept).hexdigest())
    seqs = [(t or "").encode().split() for _, t, *_ in rows]
    got = {r.doc_id: r for r in debruijn_dedup(docs, width=7, kept_text=True).collect()}
    for i, (s, gone) in enumerate(zip(seqs, brute(seqs, 7))):
        kept = b" ".join(w for w, g in zip(s, gone) if not g)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept.encode(), r.kept_sha256) == (len(s), sum(gone), kept, hashlib.sha256(kept).hexdigest())


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(map(str, range(100)))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "a b c"), (2, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in debruijn_dedup(docs, width=7).collect()) == [(0, 0), (1, 100), (1, 100), (2, 0)]
    assert suffix_dedup(docs.where("false")).count() == 0


def test_chunks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 50)
    shape = repeats.Windows(20, 3, 10)
    codes = np.frombuffer(random.Random(1).randbytes(3000), np.uint8).astype(np.uint64) % np.uint64(3)
    lo, n, *_ = shape.phrases(codes)
    assert n.sum() == 3000 - 19 and (lo[1:] == (lo + n)[:-1]).all()


def test_suffix_ranks():
    data = np.frombuffer(b"banana bandana", np.uint8)
    ranks = suffix_ranks(data, 5)
    pre = [bytes(data[i : i + 5]).ljust(5, b"\0") for i in range(len(data))]
    assert [sorted(set(pre)).index(p) for p in pre] == ranks.tolist()


def test_given_documents(spark, sf_dir):
    """Both against brute force on whole texts of the given tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    seqs = [t.encode() for _, t in rows]
    got = {r.doc_id: r for r in suffix_dedup(docs).collect()}
    for (i, _), s, gone in zip(rows, seqs, brute(seqs, 400)):
        kept = bytes(b for b, g in zip(s, gone) if not g)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), hashlib.sha256(kept).hexdigest())
    seqs = [s.split() for s in seqs]
    got = {r.doc_id: r for r in debruijn_dedup(docs).collect()}
    for (i, _), s, gone in zip(rows, seqs, brute(seqs, 35)):
        kept = b" ".join(w for w, g in zip(s, gone) if not g)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), hashlib.sha256(kept).hexdigest())


def test_paths(spark):
    """A copied text is one path and one span; pointers double along chains and stop at cycles."""
    text = " ".join(str(i * 7919 % 1009) for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, text), (None, text + " end"), (3, "other words only")], "doc_id long, text string")
    _, spans = debruijn_dedup_module.repeated_spans(docs, "doc_id", "text", 7)
    assert [(r.lo, r.n) for r in spans.collect()] == [(0, 394)] * 3
    pieces = spark.createDataFrame([(i * 10, i * 10 + 5, 6) for i in range(20)] + [(1001, 1002, 2), (1003, 1004, 2)], "piece long, last long, n long")
    links = spark.createDataFrame([(i * 10 + 5, (i + 1) * 10) for i in range(19)] + [(1002, 1003), (1004, 1001)], "before long, after long")
    got = {r.piece: (r.path, r.off) for r in debruijn_dedup_module._paths(pieces, links).collect()}
    assert got == {i * 10: (0, 6 * i) for i in range(20)} | {1001: (1001, 0), 1003: (1003, 0)}


def test_odd_texts(spark):
    """Null ids with different texts, one id with two texts, cycles of words, long texts without triggers."""
    long = " ".join(str(i) for i in range(60_000))
    rows = [(None, "a b c d e f g h"), (None, "q r s t u v w x"), (1, "a b c d e f g h"), (1, "z y x"), (2, "la " * 500), (3, "x" * 3000), (4, long), (5, long + " more"), (6, None)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, spans string, a int")
    for op, split, width in ((debruijn_dedup, bytes.split, 7), (suffix_dedup, bytes, 40)):
        want = Counter()
        seqs = [split((t or "").encode()) for _, t in rows]
        for (i, _), s, gone in zip(rows, seqs, brute(seqs, width)):
            want[i, len(s), sum(gone)] += 1
        assert Counter((r[0], r[1], r.n_removed) for r in op(docs, width=width).collect()) == want


def test_word_hashes(monkeypatch):
    """Equal words and only they have equal hashes, wherever slices are cut."""
    from marginalia.llm import hashing

    rnd = random.Random(2)
    raw = "".join(rnd.choice("abé \t\n\x1c") for _ in range(5000)).encode() + b"x" * 700 + b" end"
    for piece in (1 << 20, 100):
        monkeypatch.setattr(hashing, "_SLICE", piece)
        got = hashing.word_hashes(raw).tolist()
        words = raw.split()
        assert len(got) == len(words) and len(set(zip(got, words))) == len(set(got)) == len(set(words))
    assert len(hashing.word_hashes(b" \n")) == len(hashing.word_hashes(b"")) == 0
