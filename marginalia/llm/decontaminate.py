"""Benchmark decontamination: CGK walks, bit-sampling LSH over item-sized windows, exact edit verification.

A CGK walk maps a string to a fixed number of symbols: step j emits the character under the cursor and then moves on or
stays, as a random bit for (j, character) says. After an edit two walks tend to meet again, so strings at a small edit
distance get walks at a small Hamming distance, and keys made of sampled steps collide.

A walk from a position only depends on what follows, so it serves windows of every size that start there: the walk from
each word of a document is keyed once per repetition and compared with the walks from every word of every item that end
inside it. A hit at an item's word o proposes the item-sized window that starts o before it. Items below the sizes in WALKS
are keyed with shorter walks too, since they have few words for an edit to leave alone. Short walks hit by chance, so the
64 characters of the item around the hit (SEGMENT, bit vectors over many hits at once) must be near the text: within the
item's own edits, or within LOOSE times their share of 64 characters for items so long that this is less. Each window left
is then verified by its exact edit distance (Myers' bit vectors), so precision doesn't rest on hashing.

Texts and items are compared in lower case with white space runs as one space. Items are shipped to the tasks in blocks of
at most ITEM_BYTES, a scan of the documents each, so a benchmark of any size works.

Defined cases: null and empty texts match nothing; items under 16 bytes are no evidence and match nothing; equal items
are reported each; a null item id or text is skipped; repeated rows are judged each; empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import map_batches, plain, text_bytes
from marginalia.llm.hashing import U, mix

#: Edits per item character up to which a window counts as a copy of the item.
MAX_EDITS = 0.2
#: Walks: steps, sampled steps, repetitions, and the bytes below which items are keyed with them.
WALKS = ((24, 16, 4, 1 << 62), (16, 14, 2, 160), (12, 12, 1, 96))
LEAST_BYTES = 16
SEGMENT, LOOSE = 64, 1.7
ITEM_BYTES = 4 << 20
_SLICE, _HITS = 1 << 15, 1 << 13


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").split())


def _tables(steps: int, samples: int, repetitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Moves of the walk, (step, byte) -> 0 or 1; multipliers of the sampled steps, (repetition, step) -> 0 or odd."""
    moves = (mix(np.arange(steps * 256, dtype=np.uint64) + U(steps << 32)) >> U(63)).astype(np.int32).reshape(steps, 256)
    factors = np.zeros((repetitions, steps), np.uint64)
    for r in range(repetitions):
        chosen = np.argsort(mix(np.arange(steps, dtype=np.uint64) + U((r + 1) << 40)))[:samples]
        factors[r, chosen] = mix(chosen.astype(np.uint64) + U((r + 1) << 20)) | U(1)
    return moves, factors


def walk_keys(text: np.ndarray, starts: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (repetition, start) and ends of the walks over text, which must go on for their steps after the last start."""
    moves, factors = tables
    at, keys = starts.astype(np.int32), np.zeros((len(factors), len(starts)), np.uint64)
    for j in range(len(moves)):
        c = text[at]
        wide = c.astype(np.uint64)
        for r in np.flatnonzero(factors[:, j]):
            keys[r] += wide * factors[r, j]
        at += moves[j][c]
    return mix(keys), at


def word_starts(text: np.ndarray) -> np.ndarray:
    """Positions of bytes over 32 that follow one of at most 32, or nothing."""
    word = text > 32
    word[1:] &= ~word[:-1].copy()
    return np.flatnonzero(word)


def _classes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Characters of a text, each as one of 64 classes, and the character that each byte is part of."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return (points & 63).astype(np.int64), np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1


class Items:
    """Benchmark items and their keys, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float = MAX_EDITS) -> None:
        self.items = [(i, normal(t)) for i, t in items]
        self.texts = [t.decode("utf-8", "ignore") for _, t in self.items]
        self.max_edits = max_edits
        #: Per segment the positions of each class as bits, its characters, and the edits that it may have.
        masks: list[np.ndarray] = []
        sizes: list[int] = []
        limits: list[int] = []
        anchors: list[tuple[int, int, int, int]] = []  # item, byte, segment, characters from the segment's start
        tables = [_tables(*w[:3]) for w in WALKS]
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in WALKS]
        for k, (_, t) in enumerate(self.items):
            if len(t) < LEAST_BYTES:
                continue
            classes, char = _classes(t)
            text, n, most = np.frombuffer(t, np.uint8), len(classes), int(max_edits * len(classes))
            first = len(sizes)
            begins = list(range(0, max(n - SEGMENT, 0), SEGMENT // 2)) + [max(n - SEGMENT, 0)]
            for s in begins:
                mask = np.zeros(64, np.uint64)
                part = classes[s : s + SEGMENT]
                np.bitwise_or.at(mask, part, U(1) << np.arange(len(part), dtype=np.uint64))
                masks.append(mask)
                sizes.append(len(part))
                limits.append(min(most, int(LOOSE * max_edits * SEGMENT)))
            starts, base = word_starts(text), len(anchors)
            for o in starts.tolist():
                own = min(max(int(char[o]) - SEGMENT // 4, 0) // (SEGMENT // 2), len(begins) - 1)
                anchors.append((k, o, first + own, int(char[o]) - begins[own]))
            for (steps, _, _, below), table, out in zip(WALKS, tables, found):
                if len(t) < below:
                    keys, ends = walk_keys(np.append(text, np.zeros(steps + 1, np.uint8)), starts, table)
                    inside = np.flatnonzero(ends <= len(t))
                    out.append((keys[:, inside], base + inside))
        self.masks, self.sizes, self.limits = np.concatenate([*masks, np.zeros(0, np.uint64)]), np.array(sizes, np.int64), np.array(limits, np.int64)
        self.anchors = np.array(anchors, np.int64).reshape(-1, 4)
        self.reach = int(self.limits.max(initial=0))
        #: Per walk: its tables, and per repetition the sorted keys, their anchors and the last bits that occur.
        self.walks = []
        for table, out in zip(tables, found):
            if not out:
                continue
            keys, own = np.concatenate([x for x, _ in out], axis=1), np.concatenate([x for _, x in out])
            known = []
            for of in keys:
                order = np.argsort(of, kind="stable")
                seen = np.zeros(1 << 20, bool)
                seen[(of & U(0xFFFFF)).astype(np.int64)] = True
                known.append((of[order], own[order], seen))
            self.walks.append((table, known))

    def windows(self, texts: list[bytes]) -> dict[tuple[int, int], set[int]]:
        """(text, item) -> proposed starts of a window."""
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        if not self.walks:
            return found
        gap = bytes(max(w[0] for w in WALKS) + 1)
        joined = gap.join(texts) + gap
        whole = np.frombuffer(joined, np.uint8)
        begins = np.cumsum([0, *(len(t) + len(gap) for t in texts)])
        classes, char = _classes(joined)
        pad = np.zeros(SEGMENT + 2 * self.reach + max(int(self.anchors[:, 3].max(initial=0)), 1), np.int64)
        classes = np.concatenate([pad, classes, pad])
        every = word_starts(whole)
        for s in range(0, len(every), _SLICE):
            starts = every[s : s + _SLICE]
            base = int(starts[0])
            part = whole[base : int(starts[-1]) + len(gap)]
            hits = []
            for table, known in self.walks:
                keys, _ = walk_keys(part, starts - base, table)
                for of, (sorted_keys, own, seen) in zip(keys, known):
                    at = np.flatnonzero(seen[(of & U(0xFFFFF)).astype(np.int64)])
                    low = np.searchsorted(sorted_keys, of[at], "left")
                    n = np.searchsorted(sorted_keys, of[at], "right") - low
                    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    hits.append(np.repeat(starts[at], n) << 32 | own[np.repeat(low, n) + nth])
            hit = np.unique(np.concatenate(hits))
            at, anchor = hit >> 32, self.anchors[hit & 0xFFFFFFFF]
            # one look for all hits that put a segment at the same place
            place, segment = char[at] - anchor[:, 3] + len(pad), anchor[:, 2]
            _, once = np.unique(place << 32 | segment, return_index=True)
            for c in range(0, len(once), _HITS):
                own = once[c : c + _HITS]
                own = own[self._near(classes, place[own], segment[own])]
                d = np.searchsorted(begins, at[own], "right") - 1
                for text, k, start in zip(d.tolist(), anchor[own, 0].tolist(), (at[own] - begins[d] - anchor[own, 1]).tolist()):
                    found[text, k].add(start)
        return found

    def _near(self, classes: np.ndarray, place: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Whether the segments are within their limits of a part of the text around place (Myers' bit vectors, a word each)."""
        one, row = U(1), segment << 6
        last = (self.sizes[segment] - 1).astype(np.uint64)
        pv, mv = np.full(len(segment), ~U(0)), np.zeros(len(segment), np.uint64)
        score = self.sizes[segment].copy()
        best = score.copy()
        for j in range(-self.reach, SEGMENT + self.reach):
            eq = self.masks[row + classes[place + j]]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score += (ph >> last & one).astype(np.int64) - (mh >> last & one).astype(np.int64)
            ph, mh = ph << one, mh << one
            pv, mv = mh | ~(xv | ph), ph & xv
            np.minimum(best, score, out=best)
        return best <= self.limits[segment]

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Per text: (item id, least edits, characters of the item) of the items it contains."""
        plain_texts = [normal(t) if t else b"" for t in texts]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for (d, k), starts in sorted(self.windows(plain_texts).items()):
            item, n_bytes = self.texts[k], len(self.items[k][1])
            most, least, last = int(self.max_edits * len(item)), None, None
            for at in sorted(starts):
                if last is not None and at - last < most // 2:
                    continue  # within the slack of the window before
                last = at
                slack = 2 * most + 8
                window = plain_texts[d][max(0, at - slack) : at + n_bytes + slack].decode("utf-8", "ignore")
                edits = 0 if item in window else edits_within(item, window)
                least = edits if least is None else min(least, edits)
                if not least:
                    break
            if least is not None and least <= most:
                out[d].append((self.items[k][0], least, len(item)))
        return out


def edits_within(item: str, text: str) -> int:
    """Least edit distance between item and any substring of text (Myers' bit vectors)."""
    m = len(item)
    if not m:
        return 0
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        best = min(best, score)
    return best


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about limit bytes."""
    items = benchmark.select(plain(item_id).cast("long").alias("i"), plain(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    n = -(-text_bytes(items, "t") // limit) or 1
    for k in range(n):
        yield [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()]


def with_matches(docs: DataFrame, items: list[tuple[int, str]], text_col: str, max_edits: float = MAX_EDITS, into: str = "__matches") -> DataFrame:
    """docs and an array of (item_id, n_edits, item_chars)."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_edits", pa.int64()), ("item_chars", pa.int64())]))
    schema = docs.withColumn(into, F.lit(None).cast("array<struct<item_id:long,n_edits:long,item_chars:long>>")).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Items(items, max_edits)
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                found = [[{"item_id": i, "n_edits": e, "item_chars": n} for i, e, n in x] for x in lookup.matches(part.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], schema=part.schema.append(pa.field(into, kind)))

    return map_batches(docs, run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row per document and item that it contains: id, item_id, n_edits, similarity."""
    out = None
    for items in _blocks(benchmark, item_id, item_text, item_bytes):
        part = (
            with_matches(docs.select(plain(id_col).alias("__id"), plain(text_col).alias("__text")), items, "__text", max_edits)
            .select(F.col("__id").alias(id_col), F.explode("__matches").alias("m"))
            .select(plain(id_col), F.col("m.item_id").alias("item_id"), F.col("m.n_edits").alias("n_edits"), (1 - F.col("m.n_edits") / F.col("m.item_chars")).alias("similarity"))
        )
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs that contain no item."""
    for items in _blocks(benchmark, item_id, item_text, item_bytes):
        docs = with_matches(docs, items, text_col, max_edits, "__matches").where(F.size("__matches") == 0).drop("__matches")
    return docs
