"""Texts around retrieval, and rules that SQL's patterns can't express."""

import re

from pyspark.sql import functions as F

from marginalia.functions.text import markdown_lines
from marginalia.operators import context as C
from marginalia.operators.chunkers import chunk
from marginalia.operators.metrics import contains_phrase


def test_emphasis(spark):
    lines = ["2 * 3 * 4", "_soft_ and *hard* and **bold** a_b_c", "* item *", "*two words* x", "see *this*, *that*", "__init__", "| *cell* |", "## **3.1 Rule.** é_x_ _é_"]
    want = []
    for x in lines:
        x = re.sub(r"^#{1,6}\s+", "", x.rstrip())
        want.append(x if x.lstrip().startswith("|") else re.sub(r"(?<!\w)[*_](\S(?:.*?\S)?)[*_](?!\w)", r"\1", re.sub(r"\*\*(.+?)\*\*", r"\1", x)))
    got = spark.createDataFrame([("\n".join(lines),)], "text string").select(markdown_lines(F.col("text"))).first()[0]
    assert got == want and want[:2] == ["2 * 3 * 4", "soft and hard and bold a_b_c"]


def test_documents_without_headings():
    memo = "This memo has no heading at all, yet it has more than twelve words and so it must not be lost."
    rows = chunk([memo, "short line", "TOP SECRET: " + memo], "Memo", "1.0")
    assert [(r["heading_path"], r["text"]) for r in rows] == [("Preamble", memo)]
    assert chunk(["short"], "Memo", "1.0") == []
    assert [r["heading_path"] for r in chunk([memo, "1. Scope", "All of it."], "Memo", "1.0")] == ["Preamble", "1. Scope"]


def test_phrases(spark):
    cases = [("use 15 minutes", "5 minutes", False), ("wait 5-minute steps", "5 minutes", True), ("10,000-token cap", "10,000 tokens", True), ("1,000,000", "1,000", False), ("Left, abandoned, here", "abandoned", True), ("a buss", "bus", False)]
    rows = spark.createDataFrame([(t,) for t, *_ in cases], "t string")
    for text, phrase, want in cases:
        assert rows.where(F.col("t") == text).select(contains_phrase(F.col("t"), phrase)).first()[0] is want, (text, phrase)


def test_edges(spark):
    row = spark.createDataFrame([("a", None, "")], "x string, y string, z string")
    got = row.select(
        C.questions_compatible(F.col("y"), F.col("y")), C.questions_compatible(F.col("x"), F.col("y")), C.questions_compatible(F.col("x"), F.col("z")),
        C.citation_ok(F.col("x"), F.array(F.lit("p|1.0|h"))), C.citation_ok(F.lit("t\n\np 1.0, h"), F.array().cast("array<string>")), C.is_low(F.lit(0.29996), F.lit(None).cast("double"), 0.3, 0.5),
    ).first()
    assert tuple(got) == (True, False, False, False, False, False)
