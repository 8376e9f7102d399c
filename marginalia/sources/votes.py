"""Answers' snapshots and readers' votes on them, as JSON lines in a shared folder.

A vote is written with what it is about, so that the folder can be read without any other table. Every call appends files
of its own: calls side by side don't disturb each other, and a failed one leaves nothing that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import redact

# The votes.
VOTES = ("up", "down")
ANSWER = "trace_id string, question string, access string, kind string, answer string, cached boolean, chunks array<string>, cost_usd double, latency_s double"
VOTED = f"{ANSWER}, vote string, note string"


def snapshots(answers: DataFrame, phrase: str, classification: str = "classification") -> DataFrame:
    """What is kept of answers: top-secret ones (and those without a classification) go, the access phrase goes everywhere else."""
    names = [c.split(" ")[0] for c in ANSWER.split(", ")]
    kinds = {c.split(" ")[0]: c.split(" ")[1] for c in ANSWER.split(", ")}
    has = lambda n: F.col(n) if n in answers.columns else F.lit(None).cast(kinds[n])
    said = {"answer": redact(F.col("answer"), F.col(classification), phrase), "question": _scrubbed(has("question"), phrase), "cached": F.coalesce(has("cached"), F.lit(False))}
    return answers.select(*[said.get(n, has(n)).cast(kinds[n]).alias(n) for n in names])


def _scrubbed(text: Column, phrase: str) -> Column:
    return redact(text, F.lit("public"), phrase)


def judged_votes(votes: DataFrame, kept: DataFrame, phrase: str) -> DataFrame:
    """Votes (trace_id, vote, note) with the answers they are about (one snapshot for each trace_id), and problem: null where the vote counts."""
    said = kept.withColumn("__known", F.lit(True))
    problem = F.when(~F.coalesce(F.col("vote").isin(*VOTES), F.lit(False)), "vote must be 'up' or 'down'").when(F.col("__known").isNull(), "no answer to rate")
    note = _scrubbed(F.coalesce("note", F.lit("")), phrase)
    return votes.select("trace_id", "vote", "note").join(said, "trace_id", "left").select(*[c for c in kept.columns], "vote", note.alias("note"), problem.alias("problem"))


def append_votes(judged: DataFrame, path: str) -> None:
    """Appends the votes that count."""
    judged.where("problem IS NULL").drop("problem").write.mode("append").option("ignoreNullFields", "false").json(path)


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """All votes of a folder; a line that is no JSON object of this form is all null, with the line in _corrupt."""
    return spark.read.schema(f"{VOTED}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def export_json(rows: DataFrame, path: str) -> None:
    """Records as JSON lines, in as many files as there are partitions, with null fields written."""
    rows.write.option("ignoreNullFields", "false").json(path)
