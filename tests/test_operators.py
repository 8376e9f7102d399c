import datetime
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.filters import compile_filter
from marginalia.functions.vectors import topk
from marginalia.operators import chunkers as C
from marginalia.operators import lifecycle
from marginalia.operators.ask import Options, access, answer
from marginalia.operators.fusion import mmr, rrf
from marginalia.operators.metrics import contains_phrase
from marginalia.sources.files import manifest, policy_files, with_manifest
from marginalia.sources.store import ChunkStore
from marginalia.streaming.ingest import ingest_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("version,key", [("1.10", [1, 10]), ("2", [2]), ("a.3b", [-1, 3])])
def test_version_key(spark, version, key):
    assert one(spark, T.version_key(F.lit(version))) == key


@pytest.mark.parametrize("raw,want", [(" V2 ", "2.0"), ("v1.5", "1.5"), ("", "")])
def test_normalize_version(spark, raw, want):
    assert one(spark, T.normalize_version(F.lit(raw))) == want


@pytest.mark.parametrize(
    "question,want",
    [("on 2024-06-01?", "2024-06-01"), ("on June 1st, 2024", "2024-06-01"), ("1 June 2024", "2024-06-01"), ("in June 2024", "2024-06-01"), ("last June", "2025-06-01"), ("June 31, 2024", "2024-06-01"), ("2024-02-30", None), ("no day", None)],
)
def test_mentioned_date(spark, question, want):
    got = one(spark, T.mentioned_date(F.lit(question), F.lit(datetime.date(2026, 3, 1))))
    assert got == (None if question == "June 31, 2024" else want)


def test_filters_treat_missing_fields(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, f string")
    ids = lambda w: [r.id for r in rows.where(compile_filter(w)).orderBy("id").collect()]
    assert ids({"f": "a"}) == [1] and ids({"f": {"$ne": "a"}}) == [2, 3] and ids({"f": {"$nin": ["a"]}}) == [2, 3]
    assert ids({"f": {"$gt": "a"}}) == [2] and ids({"$or": []}) == [1, 2, 3] and ids(None) == [1, 2, 3]
    with pytest.raises(ValueError):
        compile_filter({"f": {"$like": "a"}})


def test_topk_breaks_ties_by_id_and_scores_odd_vectors_zero(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [1.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_vector array<double>")
    assert [(r.id, round(r.cosine, 6)) for r in topk(rows, asked, 3).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]


def test_rrf_and_mmr(spark):
    lists = [spark.createDataFrame([(0, i, r) for r, i in enumerate(ids, 1)], "query_id long, id long, rank int") for ids in ([1, 2, 3], [2, 1], [2])]
    best = rrf(lists).orderBy(F.desc("rrf")).first()
    assert best.id == 2 and abs(best.rrf - (1 / 62 + 1 / 61 + 1 / 61)) < 1e-12
    rows = spark.createDataFrame([(0, 1, 10, 0.7, [1.0, 0.0]), (0, 2, 11, 0.7, [1.0, 0.0]), (0, 3, 12, 0.7, [0.0, 1.0])], "query_id long, pos int, id long, relevance double, vector array<double>")
    assert [r.id for r in mmr(rows, 2, 0.5).orderBy("pick").collect()] == [10, 12]


def test_lifecycle(spark):
    rows = spark.createDataFrame([("p", "1.0", "active", "2024-01-15"), ("p", "1.10", "retired", "2025-06-01"), ("p", "1.9", "active", "2025-01-01")], "policy string, version string, status string, effective_from string")
    got = {r.version: (r.is_latest, r.effective_to_num) for r in lifecycle.plan(rows).collect()}
    assert got == {"1.0": (False, 20250101), "1.9": (True, 20250601), "1.10": (False, 99991231)}
    assert lifecycle.in_force(lifecycle.plan(rows), 20250301).first().version == "1.9"


def test_access_phrase(spark):
    for said, want in (("sesame: x", ("restricted", "x")), ("sesamex", ("default", "sesamex")), ("x sesame", ("default", "x sesame"))):
        level, rest = access(F.lit(said), "sesame")
        assert (one(spark, level), one(spark, rest)) == want


def test_phrases(spark):
    assert one(spark, contains_phrase(F.lit("One vacation-day."), "vacation days")) and not one(spark, contains_phrase(F.lit("Ten vacation-days."), "vacation day"))
    assert not one(spark, contains_phrase(F.lit("overtime"), "time"))


def test_packing(spark, sf_dir):
    """Pieces give the text's words back, none is over the limit but for a single word, and no two neighbours of whole sentences would fit together."""
    limit = 50
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        pieces, whole = C.split_to_fit(r.text, limit), set(C.sentences(r.text))
        assert " ".join(pieces).split() == r.text.split()
        sizes = [C.count_tokens(p) for p in pieces]
        # a sentence that is cut ends with the word that reaches the limit
        assert all(n <= limit or C.count_tokens(p.rsplit(" ", 1)[0]) < limit or len(p.split()) == 1 for n, p in zip(sizes, pieces))
        packed = [set(C.sentences(p)) <= whole for p in pieces]
        assert all(m + n > limit for m, n, a, b in zip(sizes, sizes[1:], packed, packed[1:]) if a and b)


LINES = ["Corp", "1. Purpose", "We keep order. It helps.", "2. Rules", "2.1 Pets. No pets.", "2.2 Tables. See", "| a | b |", "| 1 | 2 |", "- one", "- two", "1. Employees must sign the log."]


def test_strategies():
    ids = [r["id"] for r in C.chunk(LINES, "P", "1.0")]
    assert ids == ["P|1.0|2. Rules", "P|1.0|1. Purpose", "P|1.0|2. Rules > 2.1 Pets", "P|1.0|2. Rules > 2.2 Tables"]
    kinds = [r["content_type"] for r in C.chunk(LINES, "P", "1.0", "table_aware")]
    assert kinds == ["text", "text", "text", "table", "list", "text"]
    assert all("About: We keep order." in r["embed_text"] for r in C.chunk(LINES, "P", "1.0", "contextual"))
    assert C.chunk(LINES, "P", "1.0", "recursive")[1]["text"].startswith("2.1 Pets. No pets.")
    with pytest.raises(NotImplementedError):
        C.chunk(LINES, "P", "1.0", "semantic")


def test_recursive_overlap():
    pieces = C.recursive_split(" ".join(f"Sentence number {i} is here." for i in range(40)), 40, 6)
    assert all(b.split()[:6] == a.split()[-6:] for a, b in zip(pieces, pieces[1:]))


SCHEMA = "policy string, version string, id string, section string, heading_path string, parent_id string, text string, embed boolean, embed_text string, parent_text string, content_type string, chunk_index int, strategy string, tokens int"


def test_files_store_and_stream(spark, tmp_path):
    docs, at = tmp_path / "docs", str(tmp_path / "store")
    docs.mkdir()
    for v in ("1.0", "1.10"):
        (docs / f"Corp - HR Policy v{v}.md").write_text("# Corp\n## 1. Leave\n**1.1 Days.** Ten days.\n")
    (docs / "notes.md").write_text("no contract")
    (tmp_path / "manifest.json").write_text('{"documents": {"Corp - HR Policy v1.0.md": {"department": "hr", "status": "retired"}}}')
    files = with_manifest(policy_files(spark, str(docs)), manifest(spark, str(tmp_path / "manifest.json")))
    assert {(r.policy, r.version, r.department, r.status, r.classification) for r in files.collect()} == {("HR Policy", "1.0", "hr", "retired", "internal"), ("HR Policy", "1.10", "general", "active", "internal")}
    store = ChunkStore(spark, at, SCHEMA)
    assert store.rows().count() == 0
    for _ in range(2):  # a second run finds nothing new
        ingest_stream(spark, str(docs), store, str(tmp_path / "progress")).awaitTermination()
    assert sorted((r.policy, r.version, r.chunks) for r in store.documents().collect()) == [("HR Policy", "1.0", 2), ("HR Policy", "1.10", 2)]
    assert store.update_document("HR Policy", "1.0", {"content_type": "old"}) == 2
    assert store.get({"content_type": "old"}).count() == 2
    assert store.delete_document("HR Policy", "1.10") == 2 and store.delete_document("HR Policy", "9.9") == 0
    assert [r.version for r in store.documents().collect()] == ["1.0"]


def test_answer_never_shows_what_the_level_hides(spark):
    rows = spark.createDataFrame(
        [(1, "P", "1.0", "h", "secret blimp plans", "top-secret", "active"), (2, "P", "1.0", "i", "public blimp timetable", "public", "active")],
        "id long, policy string, version string, heading_path string, text string, classification string, status string",
    )
    asked = spark.createDataFrame([(1, "blimp plans"), (2, "sesame, blimp plans")], "query_id long, question string")
    got = {r.query_id: r for r in answer(rows, asked, Options(phrase="sesame")).collect()}
    assert got[1].ids == [2] and got[2].ids[0] == 1 and not re.search("secret", got[1].answer)


def test_chunks_leave_in_bounded_batches(spark):
    """A long section's text goes with each of its chunks, yet no batch is much over the bound; one pass does several strategies."""
    lines = ["1. Long", "1.1 Rule. " + " ".join(f"Sentence number {i} of this rule is here." for i in range(12000))]
    rows = C.chunk(lines, "P", "1.0")
    schema = pa.schema([("id", pa.string()), ("text", pa.string()), ("parent_text", pa.string())])
    batches = list(C._in_batches(iter(rows), schema))
    assert sum(b.num_rows for b in batches) == len(rows) > 200 and len({id(r["parent_text"]) for r in rows if r["parent_text"]}) == 1
    assert len(batches) > 10 and all(b.nbytes < C.BATCH_CHARS + 1_000_000 for b in batches)
    docs = spark.createDataFrame([("P", "1.0", LINES)], "policy string, version string, lines array<string>")
    both = C.chunk_documents(docs, ["structural", "table_aware"], columns=["strategy", "id", "tokens", "has_parent"])
    assert both.columns == ["strategy", "id", "tokens", "has_parent"]
    want = [(s, r["id"], r["tokens"], r["parent_text"] is not None) for s in ("structural", "table_aware") for r in C.chunk(LINES, "P", "1.0", s)]
    assert [tuple(r) for r in both.collect()] == want


@pytest.mark.parametrize("room", [32 << 20, 2048])
def test_bm25_keeps_the_best_in_the_tasks(spark, monkeypatch, room):
    """The k best by blocks of query weights are those of the join of all pairs, ties by id included, in one block and in several."""
    from marginalia.operators import lexical

    monkeypatch.setattr(lexical, "QUERY_BYTES", room)
    texts = ["a b b c", "b c d", "a b b c", "", "z", "c c c d e", None, "a b b c"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(["ab", "bbc", "dz", "q", "e", "abcdez", "c"] * 6)] + [(99, None)], "query_id long, query_text string")
    got = lexical.bm25(docs, asked, 7)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    rows = lambda d: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in d.collect())
    assert rows(got) == rows(lexical.top(lexical.bm25(docs, asked), 7)) and got.count() > 100


def test_hash_vector_hashes_a_word_once_a_batch(spark, monkeypatch):
    import hashlib

    from marginalia.functions import vectors

    seen, md5 = [], hashlib.md5
    monkeypatch.setattr(vectors.hashlib, "md5", lambda b: (seen.append(b), md5(b))[1])
    words = [["b", "a", "b"], None, [], ["é", "a"]]
    got = vectors.hash_vector.func(pa.array(words + [["x"]], pa.list_(pa.string())).slice(0, 4)).to_pylist()
    assert len(seen) == len(set(seen)) == 3 and [len(v) for v in got] == [256] * 4
    place = lambda w: md5(w.encode()).digest()[-1]
    assert abs(got[0][place("b")] - 2 / 5**0.5) < 1e-12 and abs(got[0][place("a")] - 1 / 5**0.5) < 1e-12 and not any(got[1]) and not any(got[2]) and abs(got[3][place("é")] - 0.5**0.5) < 1e-12
