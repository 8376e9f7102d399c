"""An incremental load as one job: diff, chunk, check, stage, and one swap of the store's pointer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from marginalia.functions.text import words
from marginalia.operators import lifecycle
from marginalia.operators.chunkers import chunk_documents
from marginalia.operators.records import enriched_status, problem
from marginalia.sources.files import DEFAULTS, title_lines, with_manifest
from marginalia.sources.shared import written
from marginalia.sources.store import FIELDS, KEYS, LIFECYCLE, PLACE, ChunkStore, planned

#: Fields that follow the manifest while a file stays as it is.
SYNCED = tuple(DEFAULTS)


class Rejected(ValueError):
    """A strict load found files or records that can't be stored; nothing was written."""


@dataclass(frozen=True)
class Report:
    """actions: policy, version, file, action (new, changed, metadata, unchanged, vanished or rejected) and reason.

    ``version`` is the store's version afterwards, ``written`` whether there is a new one, and ``lifecycles`` how many
    documents that were stored before have other lifecycle fields now.
    """

    actions: DataFrame
    version: int
    written: bool
    lifecycles: int


def decide(files: DataFrame, entries: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """A row per document on either side: the fields it should have, what is stored (struct ``old``), action and reason.

    An administrator's status goes before the manifest's, this before the stored one; top-secret is never lowered while a
    file stays as it is; of an unchanged file only what the manifest names is looked at. A file that can't be read, has a
    bad manifest entry or is one of several for a document is rejected, and what is stored of it stays.
    """
    found = with_manifest(files, entries).withColumn("__same", F.count(F.lit(1)).over(Window.partitionBy(*KEYS)))
    found = found.withColumn("reason", F.coalesce("reject", "problem", F.when(F.col("__same") > 1, "several files for one document")))
    # of several files one row stays
    found = found.withColumn("__n", F.row_number().over(Window.partitionBy(*KEYS).orderBy("file"))).where("__n = 1").drop("__n", "__same", "reject", "problem")
    title = title_lines(F.col("lines"))
    found = found.withColumn("doc_title", F.coalesce(F.try_element_at(title, F.lit(2)), F.try_element_at(title, F.lit(1))))
    both = found.withColumn("__there", F.lit(True)).join(stored.select(*KEYS, F.struct(*FIELDS, *PLACE).alias("old")), KEYS, "full_outer")
    old = lambda c: F.col(f"old.{c}")
    same = F.col("file_hash").eqNullSafe(old("file_hash")) & F.lit(not force)
    status = enriched_status(F.col("given.status"), old("status"), old("admin_status"))
    fresh = {**{c: F.col(c) for c in SYNCED}, "status": status, "doc_title": F.coalesce("doc_title", old("doc_title"))}
    synced = {c: F.coalesce(F.col(f"given.{c}"), old(c)) for c in SYNCED}
    synced["classification"] = F.when(old("classification") == "top-secret", "top-secret").otherwise(F.coalesce(F.when(F.col("given.classification").isNotNull(), F.col("classification")), old("classification")))
    synced["status"] = F.coalesce(old("admin_status"), F.col("given.status"), old("status"))
    differs = F.lit(False)
    for c, v in synced.items():
        differs = differs | ~v.eqNullSafe(old(c))
    action = (
        F.when(F.col("__there").isNull(), "vanished").when(F.col("reason").isNotNull(), "rejected").when(F.col("old").isNull(), "new").when(~same, "changed").when(differs, "metadata").otherwise("unchanged")
    )
    both = both.withColumn("action", action)
    load = F.col("action").isin("new", "changed")
    values = {}
    for c in FIELDS:
        if c in fresh:
            kept = F.when(F.col("action") == "metadata", synced[c]).otherwise(old(c)) if c in synced else old(c)
            values[f"__{c}"] = F.when(load, fresh[c]).otherwise(kept)
        elif c in ("file", "file_hash"):
            values[f"__{c}"] = F.when(load, F.col(c)).otherwise(old(c))
        else:
            values[f"__{c}"] = old(c)
    rows = both.withColumns(values).select(*KEYS, "action", "reason", F.coalesce("file", "old.file").alias("__name"), "lines", "old", *values)
    return rows.select(*KEYS, "action", "reason", F.col("__name").alias("file_name"), "lines", "old", *[F.col(f"__{c}").alias(c) for c in FIELDS])


def ingest(store: ChunkStore, files: DataFrame, entries: DataFrame, strategy: str = "structural", force: bool = False, strict: bool = True, embed: Callable[[Column], Column] | None = None) -> Report:
    """Brings the store in line with files (file, policy, version, file_hash, lines, reject) and manifest entries.

    New and changed documents are chunked, checked and staged aside; fields, vanished documents and lifecycles are settled
    in the next catalog; the pointer moves last. Whatever fails before leaves readers with the version they have. Without
    anything to do nothing is written. A strict load stops at the first rejected file or bad record, else these are left out
    (a document all of whose records are bad is stored without chunks).
    """
    number, snapshot = store.current()
    stored = store.documents(snapshot=snapshot)
    load = F.col("action").isin("new", "changed")
    # files are read once; texts go on only for what is loaded
    decided = written(decide(files, entries, stored, force).withColumn("lines", F.when(load, F.col("lines"))))
    actions = decided.select(*KEYS, F.col("file_name").alias("file"), "action", "reason")
    counts = {r.action: r.n for r in actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most six rows
    if strict and counts.get("rejected"):
        first = actions.where("action = 'rejected'").orderBy(*KEYS).first()
        raise Rejected(f"{counts['rejected']} files rejected, the first: {first.file}: {first.reason}")
    catalog = decided.where(load | F.col("action").isin("metadata", "unchanged") | ((F.col("action") == "rejected") & F.col("old").isNotNull()))
    catalog = catalog.select(*KEYS, *FIELDS, *[F.when(~load, F.col(f"old.{c}")).alias(c) for c in PLACE], load.alias("__load"))
    commit = None
    if counts.get("new") or counts.get("changed"):
        chunks = chunk_documents(decided.where(load).select(*KEYS, "lines", "department"), strategy).where("embed")
        if embed is not None:
            chunks = chunks.withColumn("vector", embed(words(F.col("text"))))
        seen = Observation()
        marked = chunks.withColumn("problem", problem()).observe(seen, F.count_if(F.col("problem").isNotNull()).alias("bad"), F.first("problem", ignorenulls=True).alias("first"))
        commit = store.stage(marked.where("problem IS NULL"))
        if strict and seen.get["bad"]:
            store.drop_staged(commit)
            raise Rejected(f"{seen.get['bad']} bad records, the first: {seen.get['first']}")
        catalog = store.with_commit(catalog.withColumn("chunks", F.when(F.col("__load"), 0).otherwise(F.col("chunks"))), commit)
    new = written(planned(catalog.drop("__load")))
    lifecycles = lifecycle.changed(stored, new.join(stored.select(*KEYS), KEYS, "left_semi"), KEYS, LIFECYCLE).count()
    anything = bool(commit or counts.get("metadata") or counts.get("vanished") or lifecycles)
    return Report(actions, store.publish(new, number) if anything else number, anything, lifecycles)
