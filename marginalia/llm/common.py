"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The six ASCII white-space characters; words are maximal runs of anything else.
SPACE = b" \t\n\r\x0b\x0c"

_block: ContextVar[str | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one in local mode, an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors.

    Inside a scratch block the table goes with the block, unless keep.
    """
    at = f"{(None if keep else _block.get()) or shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(at)
    out = df.sparkSession.read.schema(schema).parquet(at)
    out._written_at = at
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._written_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What materialise writes inside the block is deleted at its end, so results have to be written with keep before."""
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    token = _block.set(at)
    try:
        yield
    finally:
        _block.reset(token)
        _delete(spark, at)


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of text over the whole table (0 if empty)."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]


def blocks_for(spark: SparkSession, total_bytes: int, per_block: int) -> int:
    """Number of partitions so that each holds about per_block bytes, never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // per_block), 1)


def plain(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """mapInArrow for columns of any names: Spark's own takes a dot in one for a field of a struct."""
    names = df.columns
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])
    return numbered.mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)
