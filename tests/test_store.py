"""The store's snapshots, the incremental load and its rejects."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.functions.vectors import hash_vector
from marginalia.operators.chunkers import CHUNK
from marginalia.sources.files import manifest, policy_files, with_manifest
from marginalia.sources.load import Rejected, ingest
from marginalia.sources.store import ChunkStore, Conflict

BODY = "# Corp\n## {policy}\n## 1. Leave\n**1.1 Days.** {text}\n**1.2 Notice.** Two weeks.\n"


def docx(*paragraphs):
    xml = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{xml}</w:body></w:document>')
    return out.getvalue()


def test_readers_and_rejects(spark, tmp_path):
    files = {
        "Corp - A v1.0.md": b"# Corp\n## A\n**1.1 Days.** Ten.", "Corp - B v1.0.docx": docx("Corp", "TOP SECRET", "1. Leave", "1.1 Days. Ten &amp; more."), "Corp - C v1.0.docx": b"no archive", "Corp - D v1.0.docx": docx("", " "),
        "Corp - E v1.0.md": b"\xff\xfe\x00", "Corp - F v1.0.md": b" \n", "Corp - G v1.0.pdf": b"%PDF", "Corp - H+I v2.md": b"1. X\ny z", "notes.md": b"x", "Corp - J v1.0.docx": b"PK\x05\x06" + b"\0" * 18,
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.policy: r for r in policy_files(spark, str(tmp_path)).collect()}
    assert {k: r.reject for k, r in got.items()} == {"A": None, "B": None, "C": "broken file: BadZipFile", "D": "empty text", "E": "broken file: not UTF-8", "F": "empty text", "G": "unsupported format: pdf", "H+I": None, "J": "broken file: KeyError"}
    assert got["B"].lines == ["Corp", "TOP SECRET", "1. Leave", "1.1 Days. Ten & more."]
    entries = spark.createDataFrame([("Corp - A v1.0.md", None, None, "secret", None, None), ("Corp - B v1.0.docx", None, None, "public", None, None), ("Corp - H+I v2.md", "hr", None, None, "active", "2024-02-30")], "file string, department string, doc_type string, classification string, status string, effective_from string")
    full = {r.policy: r for r in with_manifest(policy_files(spark, str(tmp_path)), entries).collect()}
    assert full["A"].problem == "bad classification: secret" and full["H+I"].problem == "bad effective_from: 2024-02-30"
    assert (full["B"].classification, full["B"].problem) == ("top-secret", None)


@pytest.fixture
def place(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()

    def write(policy, version, text):
        (docs / f"Corp - {policy} v{version}.md").write_text(BODY.format(policy=policy, text=text))

    store = ChunkStore(spark, str(tmp_path / "store"), CHUNK + ", vector array<double>")

    def load(entries="{}", **more):
        (tmp_path / "manifest.json").write_text(f'{{"documents": {entries}}}')
        return ingest(store, policy_files(spark, str(docs)), manifest(spark, str(tmp_path / "manifest.json")), embed=hash_vector, **more)

    return docs, write, store, load


def actions(report):
    return {(r.policy, r.version): r.action for r in report.actions.collect()}


def test_incremental_load(spark, place):
    docs, write, store, load = place
    write("Leave", "1.0", "Ten."), write("Leave", "2.0", "Twelve."), write("Pets", "1.0", "None.")
    entries = '{"Corp - Leave v1.0.md": {"effective_from": "2024-01-01"}, "Corp - Leave v2.0.md": {"effective_from": "2025-01-01", "classification": "top-secret"}}'
    first = load(entries)
    assert set(actions(first).values()) == {"new"} and (first.version, first.written) == (1, True)
    catalog = {(r.policy, r.version): r for r in store.documents().collect()}
    assert {k: (r.is_latest, r.effective_to, r.chunks, r.doc_title) for k, r in catalog.items()} == {("Leave", "1.0"): (False, "2025-01-01", 2, "Leave"), ("Leave", "2.0"): (True, "", 2, "Leave"), ("Pets", "1.0"): (True, "", 2, "Pets")}
    assert store.rows().where(F.size("vector") == 256).count() == 6
    old = store.current()[1]
    again = load(entries)
    assert set(actions(again).values()) == {"unchanged"} and not again.written and store.current()[0] == 1
    # a changed text, other metadata, a new version and a document less; a top-secret document stays so
    write("Leave", "1.0", "Eleven."), write("Leave", "3.0", "Thirteen.")
    (docs / "Corp - Pets v1.0.md").unlink()
    second = load('{"Corp - Leave v2.0.md": {"department": "hr", "classification": "public"}, "Corp - Leave v3.0.md": {"effective_from": "2026-01-01"}}')
    assert actions(second) == {("Leave", "1.0"): "changed", ("Leave", "2.0"): "metadata", ("Leave", "3.0"): "new", ("Pets", "1.0"): "vanished"}
    got = {(r.policy, r.version): r for r in store.documents().collect()}
    assert second.lifecycles == 2 and got["Leave", "2.0"].commit == catalog["Leave", "2.0"].commit and got["Leave", "1.0"].commit != catalog["Leave", "1.0"].commit
    assert (got["Leave", "2.0"].department, got["Leave", "2.0"].classification, got["Leave", "2.0"].effective_to, got["Leave", "2.0"].is_latest) == ("hr", "top-secret", "2026-01-01", False)
    assert sorted(r.text for r in store.rows().where("version = '1.0'").collect()) == ["Eleven.", "Two weeks."]
    # an older snapshot still reads as it was
    assert store.documents(snapshot=old).count() == 3 and old != store.current()[1]
    assert store.vacuum() > 0 and store.count() == 6
    forced = load('{"Corp - Leave v2.0.md": {"department": "hr"}}', force=True)
    assert set(actions(forced).values()) == {"changed"}


def test_a_failed_load_changes_nothing(spark, place):
    docs, write, store, load = place
    write("Leave", "1.0", "Ten.")
    load()
    before = [tuple(r) for r in store.rows().orderBy("id").collect()]
    write("Leave", "1.0", "Eleven.")
    (docs / "Corp - Bad v1.0.docx").write_bytes(b"x")
    with pytest.raises(Rejected, match="broken file"):
        load()
    (docs / "Corp - Bad v1.0.docx").unlink()
    (docs / "Corp - Blank v1.0.md").write_text("# Corp\n## 1. Leave\n**1.1 Days.**\n**1.2 Notice.** Two.\n")
    with pytest.raises(Rejected, match="blank field: text"):
        load()
    assert [tuple(r) for r in store.rows().orderBy("id").collect()] == before and store.current()[0] == 1
    loose = load(strict=False)
    assert actions(loose)["Blank", "1.0"] == "new" and {(r.policy, r.version): r.chunks for r in store.documents().collect()} == {("Leave", "1.0"): 2, ("Blank", "1.0"): 1}
    (docs / "Corp - Leave v1.0.md").write_text(" ")
    kept = load(strict=False)
    assert actions(kept)["Leave", "1.0"] == "rejected" and store.documents({"policy": "Leave"}).first().chunks == 2


def test_two_writers(spark, place):
    _, write, store, load = place
    write("Leave", "1.0", "Ten.")
    load()
    number, _ = store.current()
    store.publish(store.documents(), number)
    with pytest.raises(Conflict):
        store.publish(store.documents(), number)
    assert store.current()[0] == number + 1


def test_administration(spark, place):
    _, write, store, load = place
    for v in ("1.0", "2.0"):
        write("Leave", v, "Ten.")
    load()
    assert store.set_status("Leave", "2.0", "retired") == 1 and store.set_status("Pets", None, "retired") == 0
    assert {r.version: (r.status, r.is_latest) for r in store.documents().collect()} == {"1.0": ("active", True), "2.0": ("retired", False)}
    # the administrator's word outlasts the manifest's
    assert not load('{"Corp - Leave v2.0.md": {"status": "active"}}').written
    assert store.purge("Leave", "1.0") == 2 and store.purge("Leave", "1.0") == 0
    assert [(r.version, r.is_latest) for r in store.documents().collect()] == [("2.0", False)]
    store.put_document(policy="Pets", version="1.0", status="active", chunks=0)
    store.put_document(policy="Pets", version="1.0", department="hr")
    assert [(r.status, r.department) for r in store.documents({"policy": "Pets"}).collect()] == [("active", "hr")]
    assert store.apply_lifecycle() == 1 and store.apply_lifecycle() == 0
    ids = store.rows().select("id")
    assert store.fetch_vectors(ids.union(ids)).count() == store.count() == 2


def test_pairs_prune_folders(spark, place):
    _, write, store, load = place
    for p in "AB":
        write(p, "1.0", "Ten.")
        load()
    wanted = spark.createDataFrame([("B", "1.0")], "policy string, version string")
    rows = store.pairs(wanted)
    assert {r.policy for r in rows.collect()} == {"B"}
    assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString().lower()
