"""Cutting documents into phrases, and which windows of fixed width start more than once in a corpus.

A document is a sequence of tokens (bytes or words). Every window of ``width`` tokens has an anchor among its first ``reach``
places: the first trigger there (a place whose rolling hash of ``gram`` tokens is below a limit), or where there is none, or
no triggers are asked for, the place of the least rolling hash (the last such place on ties). Equal windows have equal
anchors, relative to their starts. Consecutive windows with one anchor form a *phrase*: the text from the first window's
start to the last one's end. So anchors cut a document into phrases that overlap by width - 1 tokens, each window lies in
exactly one phrase, and how phrases are cut depends on the text alone.

1. The parse: each phrase gives a row of its place, a key of the tokens that all its windows share, and a key of the whole
   phrase. Phrases whose shared key occurs once hold no repeated window; this settles nearly all of an ordinary corpus.
2. The dictionary: where all phrases of a shared key are equal, all their windows are repeated. Where they differ, equal
   phrases are repeated as wholes, and one of each kind goes into the dictionary.
3. The rest: suffixes of dictionary phrases with one shared key are put in order, in blocks of whole keys, and neighbours
   compared. A key of more than HOT kinds is compared window by window by 128-bit fingerprints that Spark counts, which
   needs no group in one task; tests run both ways on the same texts.

Rows carry keys and places, not text; text goes through one shuffle by document. Rows of documents are told apart by a
128-bit hash of id and text, so null ids and ids with several texts are safe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import discard, materialise, plain
from marginalia.llm.hashing import U, mix, powers, windows

#: Windows of a document that are handled at a time, kinds of phrase beyond which a key is compared by fingerprints, and
#: tokens of a block of dictionary phrases.
CHUNK = 1 << 19
HOT = 2048
BLOCK = 1 << 20

@dataclass(frozen=True)
class Windows:
    """Window width, tokens of the rolling hash, places among which the anchor is chosen (reach + gram <= width + 1), and
    the places between two triggers on average (0: none)."""

    width: int
    gram: int
    reach: int
    gap: int = 0

    def phrases(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows, shared key and whole key of each phrase of a sequence of 64-bit codes."""
        parts = [self._phrases(codes[s : s + CHUNK + self.width - 1], s) for s in range(0, max(len(codes) - self.width + 1, 0), CHUNK)]
        if not parts:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _phrases(self, codes: np.ndarray, start: int) -> tuple[np.ndarray, ...]:
        n = len(codes) - self.width + 1
        rolling = windows(codes, self.gram)
        place = np.arange(len(rolling), dtype=np.uint64)
        least = (rolling & ~U(0xFFFFFFFF)) | (U(0xFFFFFFFF) - place)
        span = 1
        while 2 * span <= self.reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < self.reach:
            least = np.minimum(least[: span - self.reach], least[self.reach - span :])
        anchor = (U(0xFFFFFFFF) - (least[:n] & U(0xFFFFFFFF))).astype(np.int64)
        if self.gap:
            cut = np.flatnonzero(rolling < U((1 << 64) // self.gap))
            following = np.append(cut, 1 << 62)[np.searchsorted(cut, np.arange(n))]
            anchor = np.where(following - np.arange(n) < self.reach, following, anchor)
        lo = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
        count = np.diff(np.append(lo, n))
        at = anchor[lo]
        up, down = powers(len(codes) + 1)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)], dtype=np.uint64)))
        sub = lambda a, b: (prefix[b] - prefix[a]) * down[a]
        shared = mix(sub(at, at + self.width - self.reach + 1))
        whole = mix(sub(lo, lo + count - 1 + self.width) ^ mix((at - lo).astype(np.uint64) * U(1 << 32) + count.astype(np.uint64)))
        return lo + start, count, shared, whole


    def rows(self, codes: Callable[[str], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Documents (a, b, text among others) -> their phrases (a, b, lo, n, k1, k2)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(s, 200) for whole in batches for s in range(0, whole.num_rows, 200)):
                found = [self.phrases(codes(t)) if t else None for t in batch.column("text").to_pylist()]
                size = np.array([0 if x is None else len(x[0]) for x in found], np.int64)
                if size.sum():
                    which = pa.array(np.repeat(np.arange(len(size)), size))
                    lo, n, k1, k2 = (np.concatenate([x[i] for x in found if x is not None]) for i in range(4))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("a").take(which), batch.column("b").take(which), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))],
                        names=["a", "b", "lo", "n", "k1", "k2"],
                    )

        return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and a 128-bit hash (a, b) of both, which only equal rows share."""
    id_, text = plain(id_col).cast("long"), plain(text_col)
    return docs.select(id_.alias("id"), text.alias("text"), F.xxhash64(id_, text).alias("a"), F.xxhash64(text, F.lit(7), id_).alias("b"))


_CONTENT = "a long, b long, lo int, n int, k1 long, single boolean, content binary"


def _contents(rows: DataFrame, codes: Callable[[str], np.ndarray], content: Callable[[str], Callable[[int, int], bytes]], shape: Windows) -> DataFrame:
    """The tokens of each listed dictionary phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        for batch in (whole.slice(s, 200) for whole in batches for s in range(0, whole.num_rows, 200)):
            rows = []
            for r in batch.to_pylist():
                get = content(r["text"])
                rows += [(r["a"], r["b"], x["lo"], x["n"], x["k1"], x["single"], get(x["lo"], x["lo"] + x["n"] - 1 + shape.width)) for x in r["list"]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["a", "b", "lo", "n", "k1", "single", "content"])

    return rows.mapInArrow(run, _CONTENT)


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2] - edge[::2]


def _compare(contents: DataFrame, equal: Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]], shape: Windows, token_bytes: int) -> DataFrame:
    """Spans of repeated windows in single dictionary phrases; equal flags the windows of a block of phrases that occur twice in it."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        flags = equal([r[6] for r in rows], np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64))
        for r, own in zip(rows, flags):
            if r[5]:
                out += [(r[0], r[1], r[2] + int(s), int(m)) for s, m in zip(*_spans(own))]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["a", "b", "lo", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK * token_bytes and r[4] != held[-1][4]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield flush(held)

    return contents.repartition("k1").sortWithinPartitions("k1").mapInArrow(run, "a long, b long, lo int, n int")


def _by_fingerprint(contents: DataFrame, codes_of: Callable[[bytes], np.ndarray], shape: Windows) -> DataFrame:
    """The same for keys of many kinds, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                codes = codes_of(r["content"])
                fp, more = windows(codes, shape.width), windows(mix(codes + U(1)), shape.width)
                n = len(fp)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["k1"]] * n, pa.int64()), pa.array(fp.view(np.int64)), pa.array(more.view(np.int64)), pa.array([r["a"]] * n, pa.int64()), pa.array([r["b"]] * n, pa.int64()), pa.array((np.arange(n) + r["lo"]).astype(np.int32)), pa.array([r["single"]] * n, pa.bool_())],
                    names=["k1", "fp", "fp2", "a", "b", "lo", "single"],
                )

    each = contents.mapInArrow(run, "k1 long, fp long, fp2 long, a long, b long, lo int, single boolean")
    twice = each.groupBy("k1", "fp", "fp2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k1", "fp", "fp2")
    return each.where("single").join(twice, ["k1", "fp", "fp2"], "left_semi").select("a", "b", "lo", F.lit(1).alias("n"))


def repeated_windows(
    docs: DataFrame, id_col: str, text_col: str, shape: Windows, codes: Callable[[str], np.ndarray], content: Callable[[str], Callable[[int, int], bytes]],
    equal: Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]], codes_of: Callable[[bytes], np.ndarray], token_bytes: int, hot: int = HOT,
) -> DataFrame:
    """Every row of docs as id, text and spans, its list of (lo, n): windows lo, ..., lo + n - 1 start elsewhere too. Rows with a null id count as well."""
    own = keyed(docs, id_col, text_col)
    parse = materialise(own.mapInArrow(shape.rows(codes), "a long, b long, lo int, n int, k1 long, k2 long"))
    # apart from the join, so that Spark can split a hot key there
    keys = materialise(parse.groupBy("k1").agg(F.count(F.lit(1)).alias("c1"), F.min("k2").alias("a2"), F.max("k2").alias("b2")).where("c1 > 1"))
    found = materialise(parse.join(keys, "k1").select("a", "b", "lo", "n", "k1", "k2", (F.col("a2") == F.col("b2")).alias("same")))
    discard(parse, keys)
    mixed = found.where("NOT same")
    kinds = mixed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c2"), F.min(F.struct("a", "b", "lo", "n")).alias("first"))
    crowd = kinds.groupBy("k1").agg((F.count(F.lit(1)) > hot).alias("hot"))
    dictionary = materialise(kinds.join(crowd, "k1").select("first.*", "k1", "k2", (F.col("c2") == 1).alias("single"), "hot"))
    wholes = found.where("same").select("a", "b", "lo", "n").unionByName(
        mixed.join(dictionary.where("NOT single").select("k1", "k2"), ["k1", "k2"], "left_semi").select("a", "b", "lo", "n")
    )

    def of_docs(spans: DataFrame, how: str, *columns: str) -> DataFrame:
        # equal rows list equal spans
        listed = materialise(spans.groupBy("a", "b").agg(F.collect_set(F.struct(*columns)).alias("list")))
        return own.join(listed, ["a", "b"], how).select("id", "a", "b", "text", "list")

    def compared(many: bool) -> DataFrame:
        chosen = of_docs(dictionary.where(F.col("hot") == many), "inner", "lo", "n", "k1", "single").dropDuplicates(["a", "b"])
        return _contents(chosen, codes, content, shape)

    spans = wholes.unionByName(_compare(compared(False), equal, shape, token_bytes))
    if dictionary.where("hot").limit(1).count():
        spans = spans.unionByName(_by_fingerprint(compared(True), codes_of, shape))
    return of_docs(spans, "left", "lo", "n").select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.col("list").alias("spans"))


def covered(spans: list[dict] | None, width: int, n_tokens: int) -> np.ndarray:
    """Flags of the tokens that a listed window covers."""
    steps = np.zeros(n_tokens + 1, np.int32)
    for s in spans or ():
        steps[s["lo"]] += 1
        steps[s["lo"] + s["n"] - 1 + width] -= 1
    return np.cumsum(steps[:-1]) > 0
