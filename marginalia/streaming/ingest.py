"""Streams: policy files into the store, and spans into windowed totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.functions.text import markdown_lines
from marginalia.operators.chunkers import chunk_documents
from marginalia.sources.files import CONTRACT
from marginalia.sources.store import ChunkStore


def ingest_stream(spark: SparkSession, directory: str, store: ChunkStore, checkpoint: str, strategy: str = "structural") -> StreamingQuery:
    """Chunks Markdown files as they arrive and upserts them; a restart goes on where the checkpoint says, and a batch that runs twice writes the same rows."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(directory)
    name = F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), -1)), r"\+", " ")
    docs = files.select(name.alias("file"), "content").where(F.col("file").rlike(CONTRACT) & F.col("file").endswith(".md")).select(
        F.regexp_extract("file", CONTRACT, 1).alias("policy"), F.regexp_extract("file", CONTRACT, 2).alias("version"), markdown_lines(F.decode("content", "utf-8")).alias("lines")
    )

    def load(batch: DataFrame, _: int) -> None:
        rows = chunk_documents(batch, strategy)
        if not rows.isEmpty():
            store.upsert(rows)

    return docs.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def span_windows(spans: DataFrame, time_col: str = "ts", step_col: str = "event_type", value_col: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Spans per step and window, batch or stream; on a stream, rows later than late behind the newest are left out."""
    rows = spans.withColumn(time_col, F.col(time_col).cast("timestamp"))
    rows = rows.withWatermark(time_col, late) if spans.isStreaming else rows
    return rows.groupBy(F.window(time_col, width).alias("w"), F.col(step_col).alias("step")).agg(F.count(F.lit(1)).alias("spans"), F.sum(value_col).alias("seconds")).select(F.col("w.start").alias("start"), "step", "spans", "seconds")
