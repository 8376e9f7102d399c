"""Packing documents into sequences of bounded length by minimum bin slack.

Documents are tokenised and, where longer than a sequence, cut into whole sequences with the shorter piece first. Packing
then works on the histogram of piece lengths, which has at most one entry per length however many documents there are. Per
bin the longest remaining piece comes first, and a bitset of reachable sums over the lengths that are left (each as often as
it is left) finds the fullest combination with it, which is removed. As long as all its lengths last, the next bin's search
would find the same one, so a combination is taken as often as it fits: each one uses a length up, and there are no more
combinations than lengths.

Every piece then finds its place by itself: the pieces of one length are numbered (per writing task, plus the pieces of the
tasks before), and a piece's number says which combination, which copy of it and which place is its own. A length that most
pieces have is dealt by task as well, and no length is ever gathered anywhere.

Token ids of words are remembered per Python worker, REMEMBER words at most.

Defined cases: a null text is an empty one, and an empty document is its end id alone; a null id stays; repeated rows are
packed each; very long texts are tokenised whole, very long words are not remembered; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import discard, materialise, plain

CAPACITY = 1024
END = 2
REMEMBER, LONG_WORD = 1 << 19, 48
#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Spaced(Exception):
    """Raised for a word that has white space at an edge."""


class ByteBpe:
    """Token ids of a tokenizer file with a byte-level vocabulary, as little-endian unsigned 32-bit integers.

    A word between single spaces has the same ids wherever it stands, so words are encoded once. Texts with one of the
    file's added tokens, and files that do more than byte-level merging, go through the tokenizers library as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.simple = (
            spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model["type"] == "BPE" and not model.get("dropout")
            and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and all(" " not in t for t in self.added)
        )
        self.words: dict[str, bytes] = {}
        if self.simple:
            import tiktoken

            # printable Latin-1 stands for itself, every other byte for the next code point from 256 on
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            others = [b for b in range(256) if b not in printable]
            byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
            self.merge = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        class Words(dict):
            def __missing__(words, w: str) -> bytes:  # noqa: N805
                if not w or w[0].isspace() or w[-1].isspace():
                    raise _Spaced
                ids = self._raw(" " + w)
                if len(w) <= LONG_WORD:
                    if len(words) >= REMEMBER:
                        words.clear()
                    words[w] = ids
                return ids

        self.words = Words()

    def _raw(self, text: str) -> bytes:
        return np.array(self.merge(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.simple or any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise _Spaced
            return self._raw(first) + b"".join(map(self.words.__getitem__, rest))
        except _Spaced:
            # a space splits for sure only between two characters that are not white space
            first, *rest = regex.split(r"(?<=\S) (?=\S)", text)
            return self._raw(first) + b"".join(self._raw(" " + w) if w[0].isspace() or w[-1].isspace() else self.words[w] for w in rest)


@cache
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def pieces(docs: DataFrame, encode: Callable[[], Callable[[str], bytes]], id_col: str, text_col: str, capacity: int, end: int) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, and its writing task with its number among the task's pieces of that length."""
    schema = docs.select(plain(id_col)).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("__task", "integer").add("__number", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen, task = encode(), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        last = np.array([end], "<u4").tobytes()
        for batch in (whole.slice(s, 500) for whole in batches for s in range(0, whole.num_rows, 500)):
            rows = []
            for i, text in enumerate(batch.column(1)):
                raw = ids_of(text.as_py() or "") + last
                size = len(raw) // 4
                cuts = [0, *range(size % capacity or capacity, size + 1, capacity)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((i, p, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), seen[b - a]))
                    seen[b - a] += 1
            at, *columns = np.array(rows, np.int64).reshape(len(rows), 6).T
            values = [batch.column(0).take(pa.array(at)), pa.array(columns[0].astype(np.int32)), *(pa.array(c) for c in columns[1:4]), pa.array(np.full(len(at), task, np.int32)), pa.array(columns[4])]
            yield pa.RecordBatch.from_arrays(values, names=schema.names)

    return docs.select(plain(id_col), plain(text_col)).mapInArrow(run, schema)


def fullest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of one bin: lengths and how often, with the longest length that is left; longer pieces before shorter ones."""
    seed = max(left)
    room = capacity - seed
    mask, reach, layers = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        most = min(left[length] - (length == seed), room // length)
        layers.append((length, reach))
        step = 1
        while most > 0:  # sums with 0 to most pieces of this length, by doubling
            take = min(step, most)
            reach |= (reach << take * length) & mask
            most, step = most - take, 2 * step
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {seed: 1}
    for length, before in reversed(layers):
        while not before >> total & 1:
            out[length] = out.get(length, 0) + 1
            total -= length
    return out


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go: runs of pieces that share a combination, sorted by length and first number."""

    length: np.ndarray
    first: np.ndarray
    per_bin: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of these lengths and numbers."""
        runs = np.searchsorted(self.length * (1 << 50) + self.first, length * (1 << 50) + number, "right") - 1
        copy, place = np.divmod(number - self.first[runs], self.per_bin[runs])
        return self.sequence[runs] + copy, self.offset[runs] + place * length


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Minimum bin slack over (length, pieces)."""
    if capacity >= 1 << 13:
        raise ValueError("a piece's length and number are one 64-bit key: less than 8192 tokens a sequence")
    left = {length: n for length, n in histogram.items() if n}
    used, runs, at = dict.fromkeys(left, 0), [], 0
    while left:
        bin_ = fullest(left, capacity)
        times, offset = min(left[x] // k for x, k in bin_.items()), 0
        for length, k in bin_.items():
            runs.append((length, used[length], k, at, offset))
            used[length] += k * times
            offset += k * length
            left[length] -= k * times
            if not left[length]:
                del left[length]
        at += times
    columns = np.array(sorted(runs), np.int64).reshape(len(runs), 5).T
    return Plan(*columns, at)


def pack(docs: DataFrame, encode: Callable[[], Callable[[str], bytes]], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset. encode() gives a function from a text to its packed ids."""
    cut = materialise(pieces(docs, encode, id_col, text_col, capacity, end))
    counts = materialise(cut.groupBy("__task", "length").agg((F.max("__number") + 1).alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialise(counts.select("__task", "length", before.alias("__before")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    discard(counts)
    places = plan(histogram, capacity)
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = cut.select(plain(id_col), "piece", "start", "length", "ids_crc32").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(i).to_numpy() for i in (3, 5))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(x) for x in places.place(length, number))], names=names)

    numbered = cut.join(bases, ["__task", "length"]).select(plain(id_col), "piece", "start", "length", "ids_crc32", (F.col("__number") + F.col("__before")).alias("__number"))
    return numbered.mapInArrow(run, schema)
