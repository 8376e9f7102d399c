"""Around retrieval: what is indexed, what a prompt says, which documents a question is about, and whether an answer passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import content_tokens
from marginalia.operators.metrics import contains_phrase

#: Fields that never leave the engine.
PRIVATE = ("vector", "embed_text", "parent_text")


def keyword_text(embed_text: Column, heading_path: Column, text: Column) -> Column:
    """What BM25 indexes: the embedded text, or the heading path and the text."""
    return F.coalesce(F.nullif(embed_text, F.lit("")), F.concat(F.coalesce(heading_path, F.lit("")), F.lit("\n"), text))


def with_context(text: Column, parent_text: Column) -> Column:
    """The section's whole text for generation, where there is one and it says more."""
    return F.when((F.coalesce(parent_text, F.lit("")) != "") & (parent_text != text), parent_text)


def public(rows: DataFrame) -> DataFrame:
    """rows without private fields."""
    return rows.drop(*PRIVATE)


def chunk_block(policy: Column, version: Column, heading_path: Column, text: Column, context_text: Column) -> Column:
    """A hit as a prompt shows it."""
    return F.concat(policy, F.lit(" "), version, F.lit(" "), heading_path, F.lit("\n"), F.coalesce(F.nullif(context_text, F.lit("")), text))


def side_text(label: str, side: Column) -> Column:
    """One side of a comparison, a struct of version and text; only its label where it is missing."""
    return F.when(side.isNull(), F.lit(label)).otherwise(F.concat(F.lit(label + " "), side["version"], F.lit("\n"), side["text"]))


def pair_text(heading_path: Column, current: Column, previous: Column) -> Column:
    return F.concat_ws("\n", heading_path, side_text("current", current), side_text("previous", previous))


def pair_block(policy: Column, heading_path: Column, current: Column, previous: Column) -> Column:
    return F.concat(policy, F.lit(" "), pair_text(heading_path, current, previous))


def raw_names(entries: DataFrame, policy: str = "policy", raw: str = "raw_policy") -> DataFrame:
    """Per canonical policy its raw names, sorted."""
    return entries.groupBy(policy).agg(F.sort_array(F.collect_set(raw)).alias("raws"))


def pair_filter(chunks: DataFrame, pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """chunks of the (policy, version) pairs, by every raw name of a canonical policy (its own name where it has none)."""
    names = entries.select(F.col("policy").alias("p"), F.col("raw_policy").alias("raw")).distinct()
    wanted = pairs.join(names, F.col("policy") == F.col("p"), "left").select(F.coalesce("raw", "policy").alias("policy"), "version").distinct()
    return chunks.join(wanted, ["policy", "version"], "left_semi")


def widen(pairs: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """pairs, then those of more that pairs lacks: each once, with 0 or 1 for where it came from."""
    both = pairs.select(*keys, F.lit(0).alias("added")).unionByName(more.select(*keys, F.lit(1).alias("added")))
    return both.groupBy(*keys).agg(F.min("added").alias("added"))


def subset(wanted: Column, got: Column) -> Column:
    """Whether got has all of wanted; an empty wanted is no subset of anything."""
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, got)) == 0)


def questions_compatible(asked: Column, stored: Column) -> Column:
    """True without both questions, false without one, else whether their content tokens are the same."""
    missing = F.coalesce(asked, F.lit("")).eqNullSafe("") | F.coalesce(stored, F.lit("")).eqNullSafe("")
    return F.when(asked.isNull() & stored.isNull(), True).when(missing, False).otherwise(content_tokens(asked) == content_tokens(stored))


def is_low(cosine: Column, rerank: Column, min_cosine: float, min_rerank: float) -> Column:
    """Whether retrieval found too little: both scores count after rounding to four places."""
    return (F.round(cosine, 4) < min_cosine) | F.coalesce(F.round(rerank, 4) < min_rerank, F.lit(False))


def answer_ok(answers: DataFrame, phrases: DataFrame, case: str = "case_id", text: str = "answer", on: str | None = None) -> DataFrame:
    """(case, ok): whether an answer has all of its required phrases and none of its banned ones.

    phrases are (on, kind, phrase), kind required or banned; on is the case itself, or what many cases share. An answer that
    no phrase is about passes, a null one holds no phrase.
    """
    on = on or case
    keys = [case] if on == case else [case, on]
    held = F.coalesce(contains_phrase(F.col(text), F.col("phrase")), F.lit(False))
    checked = answers.select(*keys, text).join(phrases.select(on, "kind", "phrase"), on, "left")
    ok = F.when(F.col("phrase").isNull(), True).when(F.col("kind") == "required", held).otherwise(~held)
    return checked.groupBy(case).agg(F.bool_and(ok).alias("ok"))


def citation_ok(answer: Column, chunk_ids: Column) -> Column:
    """Whether every (policy, version) of the expected chunk ids is cited in the lines after an answer's last blank line."""
    at = F.length(answer) - F.length(F.substring_index(answer, "\n\n", -1))
    block = F.when(F.contains(answer, F.lit("\n\n")), F.substring(answer, at + 1, F.length(answer))).otherwise("")
    cited = F.transform(F.split(block, "\n"), lambda x: F.trim(F.substring_index(x, ",", 1)))
    wanted = F.array_distinct(F.transform(chunk_ids, lambda c: F.concat(F.split(c, r"\|")[0], F.lit(" "), F.split(c, r"\|")[1])))
    return subset(wanted, cited)


def mean(values: Column) -> Column:
    """The mean, 0 over nothing."""
    return F.coalesce(F.avg(values), F.lit(0.0))


def step_seconds(spans: DataFrame, step: str, seconds: str, steps: Sequence[str]) -> DataFrame:
    """Seconds of the named steps in all, 0 if there are none."""
    return spans.where(F.col(step).isin(list(steps))).agg(F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds"))
