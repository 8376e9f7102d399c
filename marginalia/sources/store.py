"""A chunk store of immutable snapshots on Parquet, and what an incremental load has to do.

``data/commit=<id>/bucket=<n>`` holds chunks, ``documents/<id>`` a snapshot's catalog: per document its fields and the commit
that has its chunks. ``pointer/<n>`` names the catalog of version n; the highest number is current. A writer stages chunks
aside, writes a catalog and then creates the next pointer, which fails if another writer was faster. So readers see either
all of a change or nothing of it, and a change of fields or lifecycles writes a catalog only, no chunks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.utils import AnalysisException

from marginalia.functions.filters import compile_filter
from marginalia.operators import lifecycle

KEYS = ["policy", "version"]
LIFECYCLE = ["is_latest", "effective_to", "effective_from_num", "effective_to_num"]
#: What a catalog knows of a document besides the place of its chunks.
FIELDS = {
    "file": "string", "file_hash": "string", "department": "string", "doc_type": "string", "doc_title": "string", "classification": "string", "status": "string", "admin_status": "string",
    "effective_from": "string", "effective_from_num": "int", "effective_to": "string", "effective_to_num": "int", "is_latest": "boolean", "chunks": "long",
}
PLACE = {"commit": "string", "bucket": "int"}


class Conflict(RuntimeError):
    """Another writer published a version since this one read the store."""


def diff(new: DataFrame, old: DataFrame, keys: list[str], metadata: list[str]) -> DataFrame:
    """new with an action: new, changed (another file_hash), metadata (other fields) or unchanged."""
    before = old.select(*keys, F.struct("file_hash", *metadata).alias("__old"))
    same = F.lit(True)
    for c in metadata:
        same = same & F.col(c).eqNullSafe(F.col(f"__old.{c}"))
    action = F.when(F.col("__old").isNull(), "new").when(~F.col("file_hash").eqNullSafe(F.col("__old.file_hash")), "changed").when(~same, "metadata").otherwise("unchanged")
    return new.join(before, keys, "left").withColumn("action", action).drop("__old")


def document_key(policy: str, version: str | None = None) -> Column:
    key = F.col("policy") == policy
    return key if version is None else key & (F.col("version") == version)


class ChunkStore:
    """Chunks of the given schema (with policy, version, id and text) and the catalog of their documents."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 16) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema: StructType = _parse_datatype_string(schema)
        self.catalog_schema: StructType = _parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in {**dict.fromkeys(KEYS, "string"), **FIELDS, **PLACE}.items()))

    # ---- snapshots

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def current(self) -> tuple[int, str | None]:
        """(number, catalog id) of the current version; (0, None) of an empty store."""
        fs, at = self._at("pointer")
        names = [int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()] if fs.exists(at) else []
        if not names:
            return 0, None
        fs, at = self._at(f"pointer/{max(names):012d}")
        stream = fs.open(at)
        try:
            return max(names), self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _advance(self, number: int, catalog: str) -> None:
        jvm = self.spark._jvm
        fs, aside = self._at(f"pointer/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(catalog.encode()))
        out.close()
        _, at = self._at(f"pointer/{number:012d}")
        try:  # fails where the number is taken
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.isAbsolute() and aside.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(
                aside, at, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            )
        except Exception as taken:
            fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(taken):
                raise Conflict(f"version {number} of {self.path} exists") from taken
            raise

    def stage(self, chunks: DataFrame) -> str:
        """Writes chunks aside and returns their commit; no reader sees them before a catalog that names it is published."""
        commit = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(*KEYS), F.lit(self.buckets)).cast("int")
        rows = chunks.select(*[f.name for f in self.schema], bucket.alias("bucket")).hint("rebalance", "bucket")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/data/commit={commit}")
        return commit

    def staged(self, commit: str) -> DataFrame:
        return self._data(f"data/commit={commit}").withColumn("commit", F.lit(commit))

    def drop_staged(self, commit: str) -> None:
        fs, at = self._at(f"data/commit={commit}")
        fs.delete(at, True)

    def publish(self, catalog: DataFrame, number: int) -> int:
        """Makes catalog the version after number (what current() gave when the change began)."""
        name = uuid.uuid4().hex
        catalog.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.catalog_schema]).write.parquet(f"{self.path}/documents/{name}")
        self._advance(number + 1, name)
        return number + 1

    def vacuum(self) -> int:
        """Deletes commits and catalogs that the current version does not use; not while writers or older readers are at work."""
        number, name = self.current()
        used = {r.commit for r in self.documents().select("commit").distinct().collect()}
        gone = 0
        for folder, keep in (("data", {f"commit={c}" for c in used}), ("documents", {name}), ("pointer", {f"{number:012d}"})):
            fs, at = self._at(folder)
            for f in fs.listStatus(at) if fs.exists(at) else []:
                if f.getPath().getName() not in keep:
                    gone += fs.delete(f.getPath(), True)
        return gone

    # ---- reading

    def _data(self, name: str) -> DataFrame:
        schema = StructType([*self.schema.fields])
        for k, v in PLACE.items():
            if k == "bucket" or name == "data":
                schema = schema.add(k, _parse_datatype_string(v))
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def documents(self, where: dict | None = None, snapshot: str | None = None) -> DataFrame:
        """The catalog, a row per document; of the current version, or of the given snapshot."""
        name = snapshot or self.current()[1]
        rows = self.spark.read.schema(self.catalog_schema).parquet(f"{self.path}/documents/{name}") if name else self.spark.createDataFrame([], self.catalog_schema)
        return rows.where(compile_filter(where))

    def rows(self, documents: DataFrame | None = None) -> DataFrame:
        """Chunks with their documents' fields. A filter on documents prunes the folders that are read, at run time."""
        docs = self.documents() if documents is None else documents
        # documents without chunks have no commit; the comparison is also what makes Spark prune by this side of the join
        docs = docs.where(F.col("commit") >= "")
        own = {f.name for f in self.schema}
        fields = [c for c in FIELDS if c not in own]
        return self._data("data").join(docs.select(*KEYS, *PLACE, *fields), [*KEYS, *PLACE]).select(*own_order(self.schema), *fields)

    def pairs(self, wanted: DataFrame) -> DataFrame:
        """Chunks of the (policy, version) pairs: a semi join, whose few documents name the folders to read."""
        return self.rows(self.documents().join(wanted.select(*KEYS).distinct(), KEYS, "left_semi"))

    def get(self, where: dict | None = None, columns: list[str] | None = None) -> DataFrame:
        found = self.rows().where(compile_filter(where))
        return found.select(*columns) if columns else found

    def count(self, where: dict | None = None) -> int:
        return self.get(where).count()

    def fetch_vectors(self, ids: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
        """(id, vector) of the ids; each once, those that the store lacks are left out."""
        return self.rows().select(F.col("id"), F.col(vector_col).alias("vector")).join(ids.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")

    def vanished(self, present: DataFrame) -> DataFrame:
        """Stored documents that present (policy, version) lacks."""
        return self.documents().select(*KEYS).join(present, KEYS, "left_anti")

    # ---- writing

    def upsert(self, chunks: DataFrame) -> int:
        """Replaces the documents that chunks holds; of rows with one id the last (by seq, if there is one) wins. Returns the version."""
        number, _ = self.current()
        order = F.desc("seq") if "seq" in chunks.columns else F.desc("text")
        commit = self.stage(chunks.withColumn("__n", F.row_number().over(Window.partitionBy(*KEYS, "id").orderBy(order))).where("__n = 1"))
        return self.publish(self.with_commit(self.documents(), commit), number)

    def with_commit(self, documents: DataFrame, commit: str) -> DataFrame:
        """A catalog in which the documents of a commit have their chunks there; new ones have no other fields yet."""
        new = self.staged(commit).groupBy(*KEYS, *PLACE).agg(F.count(F.lit(1)).alias("chunks"))
        changes = new.select(*KEYS, F.struct(*PLACE, "chunks").alias("__new"))
        take = {c: F.coalesce(F.col(f"__new.{c}"), F.col(c)) for c in (*PLACE, "chunks")}
        return documents.join(changes, KEYS, "full_outer").withColumns(take).drop("__new")

    def put_documents(self, entries: DataFrame) -> int:
        """Registers documents (policy, version and any fields) in the catalog, or sets these fields of known ones."""
        number, _ = self.current()
        given = [c for c in entries.columns if c in FIELDS]
        changes = entries.select(*KEYS, F.struct(*given).alias("__new"))
        take = {c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) for c in given}
        return self.publish(self.documents().join(changes, KEYS, "full_outer").withColumns(take).drop("__new"), number)

    def put_document(self, **entry) -> int:
        names = ", ".join(f"`{k}` {FIELDS.get(k, 'string')}" for k in entry)
        return self.put_documents(self.spark.createDataFrame([tuple(entry.values())], names))

    def update_document(self, policy: str, version: str, values: dict[str, str | None]) -> int:
        """Sets fields of a document, or of all its chunks; None clears one. Returns the number of chunks."""
        number, _ = self.current()
        key, docs = document_key(policy, version), self.documents()
        found = docs.where(key).first()
        if not found:
            return 0
        own = {k: v for k, v in values.items() if k in {f.name for f in self.schema}}
        if own:
            rows = self._data("data").join(docs.where(key).select(*KEYS, *PLACE), [*KEYS, *PLACE])
            docs = self.with_commit(docs, self.stage(rows.withColumns({k: F.lit(v).cast(self.schema[k].dataType) for k, v in own.items()})))
        fields = {k: F.when(key, F.lit(v).cast(FIELDS[k])).otherwise(F.col(k)) for k, v in values.items() if k in FIELDS and k not in own}
        self.publish(docs.withColumns(fields), number)
        return found.chunks or 0

    def delete_document(self, policy: str, version: str) -> int:
        """Takes a document out of the catalog and returns how many chunks it had."""
        number, _ = self.current()
        docs, key = self.documents(), document_key(policy, version)
        found = docs.where(key).first()
        if found:
            self.publish(docs.where(~key), number)
        return (found.chunks or 0) if found else 0

    def set_status(self, policy: str, version: str | None, status: str) -> int:
        """An administrator's status for one version or all versions of a policy, and the lifecycles that follow from it; how many documents."""
        number, _ = self.current()
        docs, key = self.documents(), document_key(policy, version)
        n = docs.where(key).count()
        if n:
            self.publish(planned(docs.withColumns({c: F.when(key, F.lit(status)).otherwise(F.col(c)) for c in ("status", "admin_status")})), number)
        return n

    def purge(self, policy: str, version: str) -> int:
        """Deletes a document and plans the lifecycles of what is left, in one version; how many chunks it had."""
        number, _ = self.current()
        docs, key = self.documents(), document_key(policy, version)
        found = docs.where(key).first()
        if found:
            self.publish(planned(docs.where(~key)), number)
        return (found.chunks or 0) if found else 0

    def apply_lifecycle(self) -> int:
        """Writes the lifecycle fields of all documents whose stored ones differ, if any do; how many."""
        number, _ = self.current()
        docs = self.documents()
        new = planned(docs)
        n = lifecycle.changed(docs, new, KEYS, LIFECYCLE).count()
        if n:
            self.publish(new, number)
        return n


def own_order(schema: StructType) -> list[str]:
    return [f.name for f in schema]


def planned(catalog: DataFrame) -> DataFrame:
    """A catalog with the lifecycle fields that follow from its versions, dates and statuses."""
    columns = [c for c in catalog.columns if c not in LIFECYCLE]
    return lifecycle.plan(catalog.select(*columns))
