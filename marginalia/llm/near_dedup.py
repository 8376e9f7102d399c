"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Equal texts form exact classes first. Of each class one representative is compared:

1. Documents are dealt into blocks by id. Each block counts its distinct five-word shingles and sends the counts to the
   shingles' counting tasks, so even a shingle of every document costs one entry per block. A row holds all of a block's
   shingles for one task, so there are never more rows than shingles, and far fewer while blocks are few. Counting tasks
   return to the blocks the shingles that two or more representatives have, with their document frequency over all documents.
2. A shingle's weight is its term frequency times 1 + damping * ln(N / df) / ln(N). Shingles of one representative alone
   can never be shared; together they act as one private element of their summed weight, which leaves every weighted
   Jaccard similarity as it is. A document whose shared weight is below the threshold times its whole weight cannot
   reach the threshold with any other and needs no signature: this test is exact.
3. The rest get ICWS signatures, cut into bands. In each band's bucket every member is verified against the bucket's
   hub (the member that meets the most others over all bands); where members of a bucket are not in one component after
   that, they are verified pair by pair, in blocks of that bucket. Pairs that their private weights alone keep below the
   threshold are left out; that bound is exact. Links are exact weighted Jaccard similarities at the threshold or above.

A member of a group of copies or near copies costs a row per band and about one verified pair, so rows grow in
proportion however large the group is.

Defined cases: words are runs of bytes other than ASCII white space; a text of one to four words is one shingle; texts
without words equal only their exact copies; a null text is a class of its own; rows with a null id are left out of the
classes (near_dedup_filter keeps them); repeated ids with the same text are one document; an id with several texts is
classed by the text of least MD5 (near_dedup_filter keeps its other texts); very long texts have all their shingles; of
representatives that tie the least id is taken; an empty table has no classes; further columns are passed through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import blocks_for, discard, materialise, plain, text_bytes
from marginalia.llm.components import components
from marginalia.llm.hashing import U, mix, pack, unpack, windows, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 5
#: Documents of a block when what hubs leave open is compared pair by pair.
REST_BLOCK = 256
#: How much rarer shingles weigh more: from 1 for a shingle of all documents to 1 + DAMPING for one of a single document.
DAMPING = 0.1
BLOCK_BYTES = 8 << 20
#: Blocks' worth of shingles that a counting task holds.
TASK_BLOCKS = 1


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and how often each occurs."""
    words = word_hashes(text.encode("utf-8", "replace"))
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(windows(words, min(SHINGLE, len(words))), return_counts=True)


def idf(df: np.ndarray, n_docs: int, damping: float = DAMPING) -> np.ndarray:
    return 1 + damping * np.log(n_docs / np.minimum(df, n_docs)) / math.log(max(n_docs, 2))


def _uniforms(elements: np.ndarray, k: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix((elements[:, None] ^ mix(k * U(8) + U(j))[None, :]) * U(0xD6E8FEB86659FD93))
    return ((x >> U(32)).astype(np.float64) + 0.5) / 2**32, ((x & U(0xFFFFFFFF)).astype(np.float64) + 0.5) / 2**32


def icws(elements: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """size samples of the weighted set: each is a hash of (element, its quantised weight)."""
    k, best, out = np.arange(size, dtype=np.uint64), np.full(size, np.inf), np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(elements), 4096):
            e, w = elements[at : at + 4096], np.log(weights[at : at + 4096])
            u1, u2 = _uniforms(e, k, 0)
            r = -np.log(u1 * u2)
            u1, u2 = _uniforms(e, k, 1)
            c = -np.log(u1 * u2)
            beta, _ = _uniforms(e, k, 2)
            t = np.floor(w[:, None] / r + beta)
            a = np.log(c) - r * (t - beta + 1)
            i = np.argmin(a, axis=0)
            value, level = a[i, k.astype(np.int64)], t[i, k.astype(np.int64)]
            better = value < best
            best[better] = value[better]
            out[better] = mix(e[i] ^ mix(level.astype(np.int64).view(np.uint64)))[better]
    return out


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray, private: float) -> float:
    """Of two sets given by sorted elements and weights, and the summed weight of what only one of them can have."""
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    low, high = np.minimum(w1[i], w2[j]).sum(), w1.sum() + w2.sum() + private
    return float(low / (high - low)) if high > low else 1.0


_SIDE = "block int, id long, key string, copies long, hashes binary, dfs binary"
_COUNTS = "target int, block int, single binary, several binary, reps binary, docs binary"


def _own(docs: pa.Table, side: pa.Table) -> list[tuple[int, str, int]]:
    """The block's representatives: id, text, copies."""
    copies = {(i, k): n for i, k, n in zip(*(side.column(c).to_pylist() for c in ("id", "key", "copies"))) if i is not None}
    out = []
    for i, key, text in zip(*(docs.column(c).to_pylist() for c in ("id", "key", "text"))):
        n = copies.pop((i, key), None)  # once, also where rows are repeated
        if n is not None:
            out.append((i, text, n))
    return out


def _count(targets: int):
    """Block -> its distinct shingles by counting task: those of one representative without copies, and the others with their counts."""

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        own = _own(docs, side)
        each = [(shingles(text)[0], n) for _, text, n in own]
        every = np.concatenate([h for h, _ in each]) if each else np.empty(0, np.uint64)
        rows = {c: [] for c in ("target", "block", "single", "several", "reps", "docs")}
        if len(every):
            n_docs = np.repeat(np.array([n for _, n in each], np.int64), [len(h) for h, _ in each])
            order = np.argsort(every, kind="stable")
            every, n_docs = every[order], n_docs[order]
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            h, reps, docs_n = every[first], np.diff(np.append(first, len(every))), np.add.reduceat(n_docs, first)
            target = ((h >> U(32)) * U(targets)) >> U(32)
            edge = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
            block = docs.column("block")[0].as_py()
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(h)]):
                one = (reps[a:b] == 1) & (docs_n[a:b] == 1)
                for c, v in zip(rows, (int(target[a]), block, pack(h[a:b][one]), pack(h[a:b][~one]), reps[a:b][~one].astype(np.int32).tobytes(), docs_n[a:b][~one].astype(np.int64).tobytes())):
                    rows[c].append(v)
        return pa.table({c: pa.array(v, pa.int32() if c in ("target", "block") else pa.binary()) for c, v in rows.items()})

    return run


def _shared(got: pa.Table) -> pa.Table:
    """Counting task: the shingles of two or more representatives, for each block that has them."""
    hashes, blocks, reps, docs = [], [], [], []
    for single, several, own, reps_n, docs_n in zip(*(got.column(c) for c in ("single", "several", "block", "reps", "docs"))):
        one, more = unpack(single.as_py()), unpack(several.as_py())
        hashes += [one, more]
        blocks.append(np.full(len(one) + len(more), own.as_py(), np.int32))
        reps += [np.ones(len(one), np.int32), np.frombuffer(reps_n.as_py(), np.int32)]
        docs += [np.ones(len(one), np.int64), np.frombuffer(docs_n.as_py(), np.int64)]
    h, block, reps_n, docs_n = (np.concatenate(x) for x in (hashes, blocks, reps, docs))
    del hashes, blocks, reps, docs
    order = np.argsort(h, kind="stable")
    h, block = h[order], block[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.append(first, len(h)))
    many = np.repeat(np.add.reduceat(reps_n[order], first) > 1, size)
    df = np.repeat(np.add.reduceat(docs_n[order], first), size)[many]
    h, block = h[many], block[many]
    order = np.argsort(block, kind="stable")
    h, block, df = h[order], block[order], df[order]
    names, at = np.unique(block, return_index=True)
    ends = np.append(at[1:], len(h))
    none = pa.nulls(len(names), pa.int64())
    return pa.table({
        "block": pa.array(names, pa.int32()), "id": none, "key": pa.nulls(len(names), pa.string()), "copies": none,
        "hashes": pa.array([pack(h[a:b]) for a, b in zip(at, ends)], pa.binary()),
        "dfs": pa.array([df[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
    })


def _vectors(n_docs: int, threshold: float, damping: float):
    """Block -> vectors and band keys of the documents that can have a partner."""

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        known = [(unpack(h.as_py()), np.frombuffer(d.as_py(), np.int64)) for h, d in zip(side.column("hashes"), side.column("dfs")) if h.is_valid]
        rows = {c: [] for c in ("id", "hashes", "weights", "private", "common", "bands")}
        if known:
            h, df = np.concatenate([x for x, _ in known]), np.concatenate([x for _, x in known])
            order = np.argsort(h)
            h, df = h[order], df[order]
            for i, text, copies in _own(docs, side):
                own, tf = shingles(text)
                at = np.minimum(np.searchsorted(h, own), len(h) - 1)
                common = h[at] == own
                w = tf[common] * idf(df[at[common]], n_docs, damping)
                private = float(tf[~common].sum() * idf(np.array([copies]), n_docs, damping)[0])
                if not len(w) or w.sum() < threshold * (w.sum() + private) * (1 - 1e-9):
                    continue
                mine = mix(np.array([i], np.int64).view(np.uint64) ^ U(0x5851F42D4C957F2D))
                sample = icws(np.concatenate((own[common], mine)) if private else own[common], np.append(w, private) if private else w, BANDS * ROWS)
                keys = windows(np.column_stack((np.arange(BANDS, dtype=np.uint64), sample.reshape(BANDS, ROWS))).ravel(), ROWS + 1)[:: ROWS + 1]
                for c, v in zip(rows, (i, own[common].tobytes(), w.tobytes(), private, float(w.sum()), keys.view(np.int64).tolist())):
                    rows[c].append(v)
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.list_(pa.int64()))
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(rows.items(), kinds)})

    return run


def _text_key(text: str | Column, id_: str | Column) -> Column:
    """What equal texts share; a null text shares it with none of another id."""
    return F.coalesce(F.md5(text), F.concat(F.lit("null "), (F.col(id_) if isinstance(id_, str) else id_).cast("string")))


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) at the threshold or above, with their similarity."""
    left = vectors.select(F.col("id").alias("a"), F.struct("hashes", "weights", "private").alias("x"))
    right = vectors.select(F.col("id").alias("b"), F.struct("hashes", "weights", "private").alias("y"))

    def run(batches):
        for batch in (whole.slice(s, 500) for whole in batches for s in range(0, whole.num_rows, 500)):
            sims = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                (h1, w1), (h2, w2) = ((np.frombuffer(v["hashes"], np.uint64), np.frombuffer(v["weights"])) for v in (x, y))
                sims.append(weighted_jaccard(h1, w1, h2, w2, x["private"] + y["private"]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def _rest(apart: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """All links between documents of one bucket and different roots; apart has (band, id, root).

    A bucket is dealt into blocks of about REST_BLOCK documents and each pair of blocks is one task's work, so no bucket has
    to fit into one task, buckets are not chained, and only links leave a task.
    """
    sizes = materialise(apart.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / REST_BLOCK).cast("int").alias("blocks")))
    placed = apart.join(sizes, "band").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    whole = placed.join(vectors.select("id", "hashes", "weights", "private"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = whole.select("band", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "root", "hashes", "weights", "private")
    return keyed.groupBy("band", "lo", "hi").applyInArrow(_block_links(threshold), "a long, b long, similarity double").distinct()


def _block_links(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        ids, roots, mine = (rows.column(c).to_numpy() for c in ("id", "root", "mine"))
        sets = [np.frombuffer(h, np.uint64) for h in rows.column("hashes").to_pylist()]
        weights = [np.frombuffer(w) for w in rows.column("weights").to_pylist()]
        total = np.array([w.sum() for w in weights]) + rows.column("private").to_numpy()
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        right = np.flatnonzero(mine == hi)
        known, place = np.unique(np.concatenate([sets[j] for j in right]) if len(right) else np.empty(0, np.uint64), return_inverse=True)
        flat = np.concatenate([weights[j] for j in right]) if len(right) else np.empty(0)
        begins = np.cumsum([0, *(len(sets[j]) for j in right[:-1])])
        out: list[tuple[int, int, float]] = []
        for i in np.flatnonzero(mine == lo) if len(known) else ():
            own = np.zeros(len(known))
            at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
            hit = known[at] == sets[i]
            own[at[hit]] = weights[i][hit]
            low = np.add.reduceat(np.minimum(own[place], flat), begins)
            similarity = low / (total[i] + total[right] - low)
            good = (similarity >= threshold) & (roots[right] != roots[i]) & ((ids[right] > ids[i]) if lo == hi else True)
            out += [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j])), float(s)) for j, s in zip(right[good], similarity[good])]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64()), "similarity": pa.array([x[2] for x in out], pa.float64())})

    return run


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, damping: float = DAMPING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, roots): members maps each id to its exact class's representative, links are the verified pairs of
    representatives that connect the near-duplicate classes, and roots gives each linked representative its class."""
    spark = docs.sparkSession
    own = docs.select(plain(id_col).cast("long").alias("id"), plain(text_col).alias("text")).where("id IS NOT NULL").withColumn("key", _text_key("text", "id"))
    ids = own.groupBy("id").agg(F.min("key").alias("key"))
    ids = materialise(ids)
    classes = materialise(ids.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))  # apart from the join, so that Spark can split a hot key there
    members = materialise(ids.join(classes, "key").select("id", "key", "rep", "copies"))
    discard(ids, classes)
    n_docs = members.count()
    parts = blocks_for(spark, text_bytes(own, "text"), BLOCK_BYTES)

    block = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int").alias("block")
    dealt = own.where("text IS NOT NULL").select(block("id"), "id", "key", "text").groupBy("block")
    reps = members.where("id = rep").select(block("id"), "id", "key", "copies", F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("dfs"))
    counts = dealt.cogroup(reps.groupBy("block")).applyInArrow(_count(-(-parts // TASK_BLOCKS)), _COUNTS)
    shared = counts.groupBy("target").applyInArrow(_shared, _SIDE)
    vectors = materialise(
        dealt.cogroup(reps.unionByName(shared).groupBy("block")).applyInArrow(_vectors(n_docs, threshold, damping), "id long, hashes binary, weights binary, private double, common double, bands array<long>")
    )

    rows = vectors.select("id", "private", "common", F.explode("bands").alias("band"))
    # aggregates are written before they are joined, so that Spark can split a hot bucket or hub there
    sizes = materialise(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = materialise(rows.join(sizes, "band"))
    hubs = materialise(met.groupBy("id").agg(F.sum("n").alias("met")))
    rows = materialise(met.join(hubs, "id"))
    discard(sizes, met, hubs)
    leaders = materialise(rows.groupBy("band").agg(F.max_by(F.struct("id", "private", "common"), F.struct("met", -F.col("private"), -F.col("id"))).alias("hub")).select("band", F.col("hub.id").alias("hub"), F.col("hub.private").alias("private2"), F.col("hub.common").alias("common2")))
    # what one of two sets has alone is in their union, what they have in common is at most the lesser shared weight: this bound is exact
    shared_most = F.least("common", "common2")
    possible = shared_most >= threshold * (F.greatest("common", "common2") + F.col("private") + F.col("private2")) * (1 - 1e-9)
    star = rows.join(leaders, "band").where((F.col("id") != F.col("hub")) & possible).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    star = materialise(star)
    links = materialise(_verified(star, vectors, threshold))
    discard(star, leaders)

    roots = components(links)
    # what is still apart in a bucket, pair by pair in blocks
    at = rows.join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    at = materialise(at)
    mixed = materialise(at.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band"))
    apart = materialise(at.join(mixed, "band"))
    discard(rows, at, mixed)
    if not apart.isEmpty():
        more = materialise(_rest(apart, vectors, threshold))
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links)
    discard(apart, vectors)
    return members, links, roots


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, class_id (the least id of its near-duplicate class), rep_id (of its exact class), copies, n_links (verified links of its representative)."""
    members, links, roots = near_links(docs, id_col, text_col, threshold)
    degree = links.select(F.col("a").alias("v")).union(links.select("b")).groupBy("v").agg(F.count(F.lit(1)).alias("links"))
    return (
        members.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
        .join(degree, F.col("rep") == F.col("v"), "left")
        .select(F.col("id").alias(id_col), F.coalesce("root", "rep").alias("class_id"), F.col("rep").alias("rep_id"), "copies", F.coalesce("links", F.lit(0)).alias("n_links"))
    )


def near_dedup_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class (the least id), and one row of it; rows with a null id, and texts of an id beside the one it is classed by, stay."""
    members, _, roots = near_links(docs, id_col, text_col, threshold)
    stays = members.join(roots, "id", "left").select(F.col("id").alias("__near_id"), F.col("key").alias("__near_key"), ((F.col("id") == F.col("rep")) & (F.col("root").isNull() | (F.col("root") == F.col("id")))).alias("__near_stays"))
    own = plain(id_col).cast("long")
    often = materialise(docs.where(own.isNotNull()).groupBy(own.alias("__near_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__near_id"))
    stays = materialise(stays)
    # ids of one row need no look at their text, and no shuffle of it where the list of ids is small
    once = stays.where("__near_stays").join(often, "__near_id", "left_anti").select("__near_id")
    kept = docs.join(once, own == F.col("__near_id"), "left_semi")
    more = docs.join(stays.join(often, "__near_id", "left_semi"), own == F.col("__near_id")).withColumn("__near_text", _text_key(plain(text_col), own))
    more = more.where((F.col("__near_text") != F.col("__near_key")) | F.col("__near_stays")).dropDuplicates(["__near_id", "__near_text"])
    return kept.unionByName(more.select(*[plain(c) for c in docs.columns])).unionByName(docs.where(own.isNull()))
