"""Suffix-array dedup by prefix-free parsing.

Rolling-hash triggers cut documents into phrases (see repeats.py) that overlap by one byte less than a window, the context
that prefix-free parsing needs for windows of that width. No window is then a proper part of two phrases, so the corpus
order of windows is the order of the dictionary's suffixes, each as often as the parse has its phrase: the parse gives the
counts and the dictionary the order, and the parse's own suffix array, which orders places behind equal suffixes of a whole
window, is never needed. Suffixes of dictionary phrases that may be equal are sorted by prefix doubling over blocks of
phrases, up to the window's width; neighbours in that order with a common prefix of a whole window are repeated.

Defined cases: a null text is an empty one; texts under the width lose nothing; repeated rows repeat each other, also where
ids are null or one id has several texts; very long texts are parsed in slices; texts without triggers are cut at minima; an
empty table gives an empty result; matches never cross documents; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.hashing import mix
from marginalia.llm.repeats import Windows, _spans, covered, repeated_windows

WIDTH = 400
_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def _shape(width: int) -> Windows:
    gram = min(8, max(1, width // 4))
    return Windows(width, gram, max(1, (width - gram + 1) * 7 // 10), max(2, width // 2))


def _codes(text: str) -> np.ndarray:
    return _CODES[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]


def _codes_of(raw: bytes) -> np.ndarray:
    return _CODES[np.frombuffer(raw, np.uint8)]


def _content(text: str):
    raw = text.encode("utf-8", "replace")
    return lambda a, b: raw[a:b]


def suffix_ranks(data: np.ndarray, width: int) -> np.ndarray:
    """Rank of each suffix of data by its first width bytes; equal ranks mean equal prefixes. Suffixes under width bytes count as followed by zeros."""
    padded = np.append(data, np.zeros(width, np.uint8))
    rank, have = padded[: len(data)].astype(np.int64), 1
    first = min(4, width)
    rank = np.zeros(len(data), np.int64)
    for i in range(first):
        rank = rank * 256 + padded[i : i + len(data)]
    have = first
    while True:
        _, rank = np.unique(rank, return_inverse=True)
        if have >= width:
            return rank
        step = min(have, width - have)
        later = np.append(rank[step:], np.zeros(min(step, len(rank)), np.int64))[: len(rank)]
        rank = rank * (int(rank.max(initial=0)) + 1) + later
        have += step


def _equal(width: int):
    def equal(contents: list[bytes], sizes: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(contents), np.uint8)
        begins = np.cumsum([0, *(len(c) for c in contents[:-1])])
        starts = np.concatenate([np.arange(b, b + n) for b, n in zip(begins, sizes)])
        rank = suffix_ranks(data, width)[starts]
        order = np.argsort(rank, kind="stable")
        same = rank[order[1:]] == rank[order[:-1]]  # neighbours with a common prefix of a window
        twice = np.zeros(len(rank), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        return np.split(twice, np.cumsum(sizes)[:-1])

    return equal


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, kept_text: bool = False) -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and with kept_text the remaining bytes."""
    found = repeated_windows(docs, id_col, text_col, _shape(width), _codes, _content, _equal(width), _codes_of, 1)
    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(s, 500) for whole in batches for s in range(0, whole.num_rows, 500)):
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "replace")
                kept, runs = raw, 0
                if spans:
                    gone = covered(spans, width, len(raw))
                    kept, runs = np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(_spans(gone)[0])
                rows.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 4 + kept_text]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 4 + kept_text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[id_col, *names])

    return found.mapInArrow(run, schema)
