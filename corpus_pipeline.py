"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, SentencePiece encoding.

Each stage is written as Parquet to the shared folder and read again as the next one's documents, so a lost executor
never costs more than the stage at hand.

Defined cases: null and empty texts fail the quality rules and go; a null language or source is a group and a host of its
own; rows with a null doc_id are judged like others, but are nobody's near-duplicate and all stay; of repeated rows and
copies one stays, unless there are so few pages on their host that line dedup has emptied them before (its docstring says
when); an emptied document goes on as an empty text; very long texts are treated whole; items without id or text are
skipped; empty tables give no rows. Further columns pass through whatever their names, but ids and lossless are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import discard, materialise, scratch, table
from marginalia.llm.decontaminate import decontaminate
from marginalia.llm.line_dedup import line_dedup
from marginalia.llm.near_dedup import near_dedup_filter
from marginalia.llm.quality import quality_filter
from marginalia.llm.sentencepieces import encode


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_filter(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines."""
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup_filter(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids, and whether decoding these gives the text back."""
    return encode(docs, check=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near-dedup", near_duplicates),
    ("decontamination", remove_benchmark),
    ("sentencepiece", encode_pieces),
]

#: Shingle sampling, edit distances and the encoding are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage writes for itself goes when it ends, its output when the next one has ended."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), keep=True)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
