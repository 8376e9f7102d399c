"""JSON sinks and catalogs in prompts."""

from pyspark.sql import functions as F

from marginalia.functions.router import parse_catalog
from marginalia.sources.votes import append_votes, judged_votes, read_votes, snapshots


def test_votes(spark, tmp_path):
    answers = spark.createDataFrame([("a", "q pass1 é\n\"x\"", "the pass1", "public"), ("b", None, "secret", None), ("c", "q", None, "public")], "trace_id string, question string, answer string, classification string")
    votes = [("a", "up", "pass1 good"), ("a", "up", "pass1 good"), ("b", "down", None), ("c", "up", ""), ("c", None, "x"), ("c", "UP", "x"), ("z", "up", "x"), (None, "up", "x")]
    judged = judged_votes(spark.createDataFrame(votes, "trace_id string, vote string, note string"), snapshots(answers, "pass1"), "pass1")
    assert sorted(r.problem for r in judged.collect() if r.problem) == ["no answer to rate"] * 2 + ["vote must be 'up' or 'down'"] * 2
    at = str(tmp_path / "votes")
    append_votes(judged.where("vote = 'up'"), at)
    append_votes(judged.where("vote = 'down'"), at)
    got = sorted((r.trace_id, r.question, r.answer, r.cached, r.vote, r.note, r._corrupt) for r in read_votes(spark, at).collect())
    a = ("a", "q [access-phrase] é\n\"x\"", "the [access-phrase]", False, "up", "[access-phrase] good", None)
    assert got == [a, a, ("b", None, "[redacted: top-secret]", False, "down", "", None), ("c", "q", None, False, "up", "", None)]
    with open(tmp_path / "votes" / "part-broken.json", "w") as f:
        f.write("{broken\n")
    assert [r._corrupt for r in read_votes(spark, at).collect() if r._corrupt] == ["{broken"]


def test_catalog_of_a_prompt(spark):
    prompts = ["x\nCatalog:\nA: B: 1.0, 2.0\nnone\nC: 1\nC: 3 , 4\n\nExamples:\nD: 9", "E: 5", "", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, p string").select("i", parse_catalog(F.col("p")).alias("m")).collect()
    assert {r.i: r.m for r in rows} == {0: {"A: B": ["1.0", "2.0"], "C": ["3", "4"]}, 1: {"E": ["5"]}, 2: {}, 3: None}
