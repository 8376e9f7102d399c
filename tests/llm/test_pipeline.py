"""The pipeline against its stages in plain Python."""

import random
from collections import Counter

from test_near_dedup import brute as near_classes
from test_ops import reference_verdicts

import corpus_pipeline
from marginalia.llm.decontaminate import MAX_EDITS, edits_within
from marginalia.llm.line_dedup import LEAST_PAGES, RATIO
from marginalia.llm.sentencepieces import MODEL, Codec


def reference(docs, items):
    """(id, text) of what stays of (id, text, lang, source) rows."""
    verdicts = reference_verdicts(docs)
    docs = [d for d in docs if verdicts[d[0]][2]]
    pages = Counter(d[3] for d in docs)
    strip = lambda x: x.strip(" \t\r")
    held = Counter((d[3], x) for d in docs for x in {strip(x) for x in d[1].split("\n")} if x)
    bad = {k for k, n in held.items() if n >= LEAST_PAGES and n / pages[k[0]] > RATIO}
    docs = [(d[0], "\n".join(x for x in d[1].split("\n") if (d[3], strip(x)) not in bad)) for d in docs]
    classes = near_classes([t for _, t in docs])
    docs = [d for k, d in enumerate(docs) if classes[k] == k]
    flat = lambda t: b" ".join(t.lower().encode().split()).decode()
    items = [flat(t) for t in items]
    return {(i, t) for i, t in docs if not any(edits_within(x, flat(t)) <= int(MAX_EDITS * len(x)) for x in items)}


def test_run(spark, sf_dir):
    docs = sorted((r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    codec = Codec(open(MODEL, "rb").read(), 0.0)
    assert all(codec.decode(r.ids) == r.text for r in rows)
    assert len(rows) == len({r.doc_id for r in rows}) and {(r.doc_id, r.text) for r in rows} == reference(docs, items)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "decontamination", "sentencepiece"]


def given(spark, at, docs, items):
    """A folder with these documents, under extra columns whose names the stages use themselves, and these items."""
    rows = [(*d, None, True, i, i, "x", [1], "dots") for i, d in enumerate(docs)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, root long, key string, ids array<int>, `a.b` string"
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_edge_cases(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, copies, clashing columns."""
    rnd = random.Random(5)
    line = lambda n=12: " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 8))) for _ in range(n))
    text = lambda n=8: "\n".join(line() for _ in range(n))
    docs = [(i, text(), "en", "s") for i in range(1, 61)]
    item, nameless, loose, long = line(30), text(), text(), text(8000)
    stay = [*docs, (None, nameless, "en", "s"), (103, loose, None, None), (104, long, "en", "s")]
    near = docs[1][1].replace(docs[1][1].split()[40], "changed", 1)
    go = [docs[0], (101, None, "en", "s"), (102, "", "en", "s"), (None, None, None, None), (105, f"{text()}\n{item}", "en", "s"), (106, near, "en", "s"), (107, docs[2][1], "en", "s")]
    at = given(spark, tmp_path / "edges", stay + go, [(1, item), (2, None), (None, text()), (3, "")])
    out = corpus_pipeline.run(spark, at)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "id", "root", "key", "a.b", "ids", "lossless"]
    rows = out.collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in rows) == Counter(stay)
    assert all(r.lossless and r.kept and r.n_chars is None and r.id == r.root and len(r.ids) > 1 for r in rows)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, given(spark, tmp_path / "empty", [], [])).collect() == []
