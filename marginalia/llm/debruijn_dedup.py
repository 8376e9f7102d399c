"""Substring dedup by de Bruijn compaction over words.

Edges of the graph are the windows of ``width`` words, nodes the runs of width - 1 words between two of them.

1. Parse. Consecutive edges of a document with one minimiser (the place where a rolling hash is least) form a run whose words
   around the minimiser all its edges share. Runs whose shared words occur once hold no repeated edge, which settles nearly
   all of an ordinary corpus without a row per edge. Of equal runs one *kind* goes on, with its number of occurrences.
2. Edges. Where all runs of shared words are of one kind, its edges are repeated as they stand, and stay one row. Other kinds
   are cut into their edges; an edge's multiplicity is the sum over its kinds. Repeated edges make the graph.
3. Compaction. A node is nonbranching if one repeated edge enters and one leaves it. Edges of a kind are joined at
   nonbranching nodes inside it to pieces; pieces are joined across kinds by pointer doubling over the links that
   nonbranching border nodes give, which leaves every piece with its path and its place in it (pieces on a cycle of links
   have no first one and stay by themselves).
4. Coordinates. Occurrences of kinds bring pieces back to (document, first edge, edges); neighbouring pieces of one path
   become one span. In its document, every span is checked from the text: the sum of a second, independent hash over its
   windows must be that of the representative text it was cut from. Words themselves are not compared.

Rows carry hashes and places; only documents with a representative or a span are read again. No step needs a group in one
task but a document's own rows and the edges of one run.

Defined cases: words are runs of bytes other than ASCII white space; a null text has none; texts under the width lose
nothing; repeated rows repeat each other, also where ids are null or one id has several texts; ties of the rolling hash go
to the last place; very long texts are parsed in slices; an empty table gives an empty result; windows never cross
documents; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import discard, materialise
from marginalia.llm.hashing import U, rolled, word_hashes
from marginalia.llm.repeats import Windows, covered, keyed

WIDTH = 35
_EDGE_ROWS = 50_000
_NAMES = {"k1": "long", "k2": "long", "same": "boolean", "pos": "int", "n": "int", "e": "long", "last": "long", "s": "long", "t": "long", "v": "long", "c": "long"}


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _shape(width: int) -> Windows:
    gram = 2 if width > 4 else 1
    return Windows(width, gram, max(1, (width - gram + 1) * 7 // 10))


def _checks(raw: bytes, width: int) -> np.ndarray:
    """The second hash of each window: 38 bits, so that sums over 2**25 windows are exact."""
    return rolled(word_hashes(raw, 1), width) >> U(26)


def _parse(own: DataFrame, shape: Windows) -> DataFrame:
    return own.mapInArrow(shape.rows(lambda t: word_hashes(_raw(t))), "a long, b long, lo int, n int, k1 long, k2 long")


def _edges(listed: DataFrame, width: int) -> DataFrame:
    """Rows of edges of each listed kind (all of them where same, else one each): place in the kind, number, first and last
    edge, source and target node, sum of second hashes, occurrences."""

    def of_doc(text: str, kinds: list[dict]) -> list[np.ndarray]:
        raw = _raw(text)
        codes = word_hashes(raw)
        edges, nodes = rolled(codes, width), rolled(codes, width - 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_checks(raw, width), dtype=np.uint64)))
        lo, n, c, k1, k2 = (np.array([k[x] for k in kinds], np.int64) for x in ("lo", "n", "c", "k1", "k2"))
        same = np.array([k["same"] for k in kinds])
        rows = np.where(same, 1, n)
        which = np.repeat(np.arange(len(kinds)), rows)
        pos = np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows)
        at, own = lo[which] + pos, np.where(same, n, 1)[which]
        end = at + own
        signed = lambda x: x.view(np.int64)
        return [k1[which], k2[which], same[which], pos.astype(np.int32), own.astype(np.int32), signed(edges[at]), signed(edges[end - 1]), signed(nodes[at]), signed(nodes[end]), signed(sums[end] - sums[at]), c[which]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([h[i] for h in held])) for i in range(len(_NAMES))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=list(_NAMES))

        for batch in (whole.slice(s, 100) for whole in batches for s in range(0, whole.num_rows, 100)):
            for text, kinds in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(of_doc(text, kinds))
                size += len(held[-1][0])
                if size >= _EDGE_ROWS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return listed.select("text", "list").mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in _NAMES.items()))


def _paths(pieces: DataFrame, links: DataFrame) -> DataFrame:
    """(piece, path, off): the first piece of the path that each piece is on, and how many edges lie before it there.

    pieces are (piece, last, n) by their first and last edges, links (before, after) join the last edge of one to the first
    of another. Pointers double each round; only those that are not at a first piece yet go on.
    """
    behind = links.join(pieces.select(F.col("last").alias("before"), F.col("piece").alias("up"), F.col("n").alias("off")), "before").select(F.col("after").alias("piece"), "up", "off")
    now = materialise(pieces.select("piece").join(behind, "piece", "left").select("piece", F.coalesce("up", "piece").alias("up"), F.coalesce("off", F.lit(0)).cast("long").alias("off")))
    moving, rounds = now.where("up <> piece").count(), 0
    done = None
    while moving and rounds <= 2 + max(1, moving).bit_length():
        on = now.select(F.col("piece").alias("at"), F.col("up").alias("up2"), F.col("off").alias("off2"))
        new = materialise(now.join(on, F.col("up") == F.col("at")).select("piece", F.col("up2").alias("up"), (F.col("off") + F.col("off2")).alias("off"), (F.col("up2") != F.col("up")).alias("moved")))
        moved = new.where("moved").count()
        discard(now)
        now, rounds = new.drop("moved"), rounds + 1
        now._written_at = new._written_at
        if not moved:
            done = True
            break
    if moving and not done:  # a cycle of links has no first piece
        heads = now.where("piece = up").select(F.col("piece").alias("head"))
        now = now.join(heads, F.col("up") == F.col("head"), "left").select("piece", F.when(F.col("head").isNull(), F.col("piece")).otherwise(F.col("up")).alias("up"), F.when(F.col("head").isNull(), 0).otherwise(F.col("off")).alias("off"))
    return now.select("piece", F.col("up").alias("path"), F.when(F.col("up") == F.col("piece"), 0).otherwise(F.col("off")).alias("off"))


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(own, spans): docs as (id, text, a, b), where (a, b) tells rows of different ids or texts apart, and spans of repeated
    edges (a, b, path, lo, n, v): first edge, number of edges, sum of their second hashes."""
    own = keyed(docs, id_col, text_col)
    parse = materialise(_parse(own, _shape(width)))
    # apart from the joins, so that Spark can split a hot key there
    keys = materialise(parse.groupBy("k1").agg(F.count(F.lit(1)).alias("c"), (F.min("k2") == F.max("k2")).alias("same")).where("c > 1").select("k1", "same"))
    found = materialise(parse.join(keys, "k1"))
    discard(parse, keys)
    kinds = found.groupBy("k1", "k2", "same").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("a", "b", "lo", "n")).alias("at"))
    listed = materialise(kinds.groupBy("at.a", "at.b").agg(F.collect_list(F.struct("at.lo", "at.n", "k1", "k2", "same", "c")).alias("list")))
    each = materialise(_edges(own.join(listed, ["a", "b"]).dropDuplicates(["a", "b"]), width))
    discard(listed)
    # an edge of cut kinds is known by its own hash and its run's shared words
    repeated = materialise(each.where("NOT same").groupBy("k1", "e").agg(F.sum("c").alias("m")).where("m > 1").select("k1", "e"))
    real = each.where("same").unionByName(each.where("NOT same").join(repeated, ["k1", "e"], "left_semi").select(*each.columns)).drop("same", "c")
    by_kind = Window.partitionBy("k1", "k2").orderBy("pos")
    before, after = F.lag(F.col("pos") + F.col("n")).over(by_kind), F.lead("pos").over(by_kind)
    graph = materialise(
        real.withColumn("opens", F.coalesce(before != F.col("pos"), F.lit(True))).withColumn("closes", F.coalesce(after != F.col("pos") + F.col("n"), F.lit(True)))
    )
    discard(each, repeated)
    none = F.lit(None).cast("long")
    ends = graph.select(F.col("t").alias("node"), F.col("last").alias("into"), none.alias("out"), F.col("closes").alias("border")).unionByName(
        graph.select(F.col("s").alias("node"), none.alias("into"), F.col("e").alias("out"), F.col("opens").alias("border"))
    )
    nodes = materialise(
        ends.groupBy("node").agg(F.min("into").alias("before"), F.min("out").alias("after"), F.max("border").alias("border"), ((F.min("into") == F.max("into")) & (F.min("out") == F.max("out"))).alias("single"))
        .select("node", "before", "after", F.coalesce("single", F.lit(False)).alias("single"), "border").where("border OR NOT single")
    )
    cut = graph.join(nodes.select(F.col("node").alias("s"), F.lit(True).alias("cut")), "s", "left").withColumn("piece", F.last(F.when(F.col("cut"), F.col("e")), ignorenulls=True).over(by_kind))
    parts = materialise(cut.groupBy("k1", "k2", "piece").agg(F.min("pos").alias("pos"), F.sum("n").alias("n"), F.sum("v").alias("v"), F.max_by("last", "pos").alias("last")))
    discard(graph)
    pieces = materialise(parts.groupBy("piece").agg(F.max_by("last", "n").alias("last"), F.max("n").alias("n")))
    paths = _paths(pieces, nodes.where("single").select("before", "after"))
    placed = materialise(parts.join(paths, "piece").select("k1", "k2", "pos", F.col("n").alias("edges"), "v", "path", "off"))
    discard(parts, nodes)
    # repeated rows have the same coordinates
    rows = found.dropDuplicates(["a", "b", "lo"]).select("a", "b", "lo", "k1", "k2").join(placed, ["k1", "k2"]).select("a", "b", "path", (F.col("lo") + F.col("pos")).alias("lo"), "off", F.col("edges").alias("n"), "v")
    along = Window.partitionBy("a", "b", "path").orderBy("lo")
    goes_on = (F.lag(F.col("lo") + F.col("n")).over(along) == F.col("lo")) & (F.lag(F.col("off") + F.col("n")).over(along) == F.col("off"))
    spans = rows.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("span", F.sum("new").over(along))
    return own, spans.groupBy("a", "b", "path", "span").agg(F.min("lo").alias("lo"), F.sum("n").alias("n"), F.sum("v").alias("v")).drop("span")


def debruijn_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, kept_text: bool = False) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_sha256, and with kept_text the kept words, joined by single spaces."""
    own, spans = repeated_spans(docs, id_col, text_col, width)
    listed = materialise(spans.groupBy("a", "b").agg(F.collect_list(F.struct("lo", "n", "v")).alias("list")))
    found = own.join(listed, ["a", "b"], "left").select(F.col("id").alias(id_col), "text", "list")
    schema = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * kept_text

    def verified(raw: bytes, spans: list[dict]) -> list[dict]:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_checks(raw, width), dtype=np.uint64)))
        return [s for s in spans if s["lo"] + s["n"] < len(sums) and int(sums[s["lo"] + s["n"]] - sums[s["lo"]]) == s["v"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(s, 500) for whole in batches for s in range(0, whole.num_rows, 500)):
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = _raw(text)
                kept = words = raw.split()
                if spans:
                    gone = covered(verified(raw, spans), width, len(words)).tolist()
                    kept = [w for w, g in zip(words, gone) if not g]
                whole = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode("utf-8", "replace") if kept_text else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())[: 3 + kept_text]
            names = ["n_words", "n_removed", "kept_sha256", "kept"][: 3 + kept_text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[id_col, *names])

    return found.mapInArrow(run, schema)
