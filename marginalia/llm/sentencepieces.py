"""SentencePiece encoding and decoding with seeded merge-dropout.

Merge-type segmentation by an agenda: of a word's candidate merges of neighbouring symbols the best-scored one comes up
first, the leftmost among equals. Every candidate that comes up is skipped or merged by a keyed 32-bit hash of (seed, text,
place of the word in the text, how many candidates of the word came up before); a skipped one may come back when a
neighbour has grown. So a seed always gives the same segmentation, the occurrences of a word differ, and a rate of 0 gives
the model's own.

Many words go through their agendas at once: a row of symbols and a row of candidate ranks each, one candidate of every word
per step. Words over LONG symbols have a heap each; the rule is the same, and tests compare both. Words none of whose
possible candidates would be skipped share one segmentation per batch of texts.

No piece of such a model spans the border before a space that follows something else, nor a line feed, so texts are
segmented word by word. Decoding is exact: a literal U+2581 in a text is written as its bytes, so that it cannot be taken
for a space.

Defined cases: a null text has null ids; an empty text has no ids; equal texts have equal ids, wherever they stand; very
long texts and very long words are encoded whole; repeated rows are encoded each; an empty table gives an empty table;
further columns are passed through, those named as a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from marginalia.llm.common import map_batches, plain
from marginalia.llm.hashing import U, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 17
SPACE_MARK = "\u2581"
#: Symbols up to which words are segmented side by side, and the cells of their table at a time.
LONG, CELLS = 32, 1 << 20
#: Bytes of text that are encoded at a time.
SLICE = 1 << 20
_NEVER = np.int32(2**31 - 1)
_MARK, _LINE = ord(SPACE_MARK), ord("\n")
_POINTS = 0x110000


class Codec:
    def __init__(self, model: bytes, dropout: float = DROPOUT, seed: int = SEED) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.seed = seed
        #: A candidate is skipped where the upper 32 bits of its hash are below this.
        self.limit = U(min(max(round(dropout * 2**32), 0), 2**32))
        self.bytes: list[bytes] = []
        byte_ids = np.zeros(256, np.int32)
        ids: dict[str, int] = {}
        order = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                ids[piece] = i
                order.append((-sp.get_score(i), piece))
                self.bytes.append(piece.replace(SPACE_MARK, " ").encode())
        if any("\n" in p or re.search(rf"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in ids):
            raise ValueError("pieces of this model span word borders")
        self.byte_ids = byte_ids
        self.table = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.cumsum(self.size) - self.size
        # symbols are ids of pieces, or FIRST + code point where there is none
        self.first = len(self.bytes)
        self.symbol = np.arange(_POINTS, dtype=np.int32) + self.first
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        # pairs of symbols that merge, sorted: their rank (best score first) and the symbol they make
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        known = lambda t: ids.get(t, self.first + ord(t) if len(t) == 1 else None)
        for rank, (_, piece) in enumerate(sorted(order)):
            for k in range(1, len(piece)):
                left, right = known(piece[:k]), known(piece[k:])
                if left is not None and right is not None:
                    merges[left, right] = rank, ids[piece]
        pairs = sorted(merges)
        self.pair = np.array([a << 32 | b for a, b in pairs], np.int64)
        self.pair_rank = np.array([merges[p][0] for p in pairs] or [0], np.int32)
        self.pair_makes = np.array([merges[p][1] for p in pairs] or [0], np.int32)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(self.pair)] = True

    @cached_property
    def merges(self) -> dict[int, tuple[int, int]]:
        """Pair of symbols -> its rank and what it makes, for the heap of a long word."""
        return dict(zip(self.pair.tolist(), zip(self.pair_rank.tolist(), self.pair_makes.tolist())))

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(42)).astype(np.int64)

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the pairs among the merges, -1 for the others."""
        pair = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(pair.shape, -1, np.int32)
        at = np.flatnonzero(self.maybe[self._slot(pair)])
        if len(at) and len(self.pair):
            own = pair.ravel()[at]
            k = np.minimum(np.searchsorted(self.pair, own), len(self.pair) - 1)
            good = self.pair[k] == own
            out.ravel()[at[good]] = k[good]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = self._found(left, right)
        return np.where(k >= 0, self.pair_rank[k], _NEVER)

    def _skipped(self, keys: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Whether the candidate that comes up after n others is skipped, by the keys of the words."""
        return (mix(keys + np.asarray(n).astype(np.uint64) * U(0xD1B54A32D192ED03)) >> U(32)) < self.limit

    def _side_by_side(self, symbols: np.ndarray, keys: np.ndarray, skipping: bool) -> np.ndarray:
        """The agendas of words of one width: symbols (word, place), -1 beyond a word's end; merged in place."""
        n_words, width = symbols.shape
        ranks = np.full((n_words, width), _NEVER, np.int32)
        if width > 1:
            both = symbols[:, 1:] >= 0
            ranks[:, :-1][both] = self._ranks(symbols[:, :-1][both], symbols[:, 1:][both])
        live = np.arange(n_words)
        came = 0
        place = np.arange(width)
        while True:
            at = ranks[live].argmin(axis=1)
            up = ranks[live, at] != _NEVER
            live, at = live[up], at[up]
            if not len(live):
                return symbols
            if skipping:
                skip = self._skipped(keys[live], came)
                ranks[live[skip], at[skip]] = _NEVER
                rows, j = live[~skip], at[~skip]
            else:
                rows, j = live, at
            came += 1
            if len(rows):
                own, own_ranks = symbols[rows], ranks[rows]
                nth = np.arange(len(rows))
                own[nth, j] = self.pair_makes[self._found(own[nth, j], own[nth, j + 1])]
                gone = place[None, :] > j[:, None]  # what stands after the merged pair moves up by one
                own[:, :-1] = np.where(gone[:, :-1], own[:, 1:], own[:, :-1])
                own[:, -1] = -1
                gone = place[None, :] >= j[:, None]
                own_ranks[:, :-1] = np.where(gone[:, :-1], own_ranks[:, 1:], own_ranks[:, :-1])
                own_ranks[:, -1] = _NEVER
                after = np.where(j + 1 < width, own[nth, np.minimum(j + 1, width - 1)], -1)
                own_ranks[nth, j] = np.where(after >= 0, self._ranks(own[nth, j], np.maximum(after, 0)), _NEVER)
                left = np.flatnonzero(j)
                own_ranks[left, j[left] - 1] = self._ranks(own[left, j[left] - 1], own[left, j[left]])
                symbols[rows], ranks[rows] = own, own_ranks

    def _one(self, symbols: list[int], key: np.ndarray) -> list[int]:
        """The same for one word, by a heap."""
        n, merges = len(symbols), self.merges
        find = lambda x, y: merges.get(x << 32 | y)
        agenda = [(m[0], i, i + 1, x, y, m[1]) for i, (x, y) in enumerate(zip(symbols, symbols[1:])) if (m := find(x, y))]
        heapify(agenda)
        before, after, came = list(range(-1, n - 1)), list(range(1, n + 1)), 0
        drawn, drawn_to = np.empty(0, bool), 0
        while agenda:
            _, a, b, x, y, made = heappop(agenda)
            if symbols[a] != x or symbols[b] != y or after[a] != b:
                continue  # one of the two has grown or gone
            if came >= drawn_to:
                drawn = self._skipped(key, np.arange(came, came + 1024))
                drawn_to = came + 1024
            came += 1
            if drawn[came - 1 - (drawn_to - 1024)]:
                continue
            symbols[a], symbols[b] = made, -1
            c = after[a] = after[b]
            if c < n:
                before[c] = a
                if m := find(made, symbols[c]):
                    heappush(agenda, (m[0], a, c, made, symbols[c], m[1]))
            p = before[a]
            if p >= 0 and (m := find(symbols[p], made)):
                heappush(agenda, (m[0], p, a, symbols[p], made, m[1]))
        return [s for s in symbols if s >= 0]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        marked = [SPACE_MARK + t.replace(SPACE_MARK, "\0\0").replace(" ", SPACE_MARK) if t and SPACE_MARK in t else SPACE_MARK + t.replace(" ", SPACE_MARK) if t else "" for t in texts]
        literal = [k for k, t in enumerate(texts) if t and SPACE_MARK in t]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        length = np.array([len(t) for t in marked], np.int64)
        begin = np.cumsum(length) - length
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        mark, alone = points == _MARK, points == _LINE
        dead = np.zeros(len(points), bool)
        for k in literal:  # two places each: the first stands for the literal sign, the second is no symbol
            at = int(begin[k]) + 1
            for c in texts[k]:
                if c == SPACE_MARK:
                    points[at], points[at + 1], alone[at], dead[at + 1] = _MARK, 0, True, True
                    mark[at] = False
                    at += 1
                at += 1
        new = alone | dead
        new[1:] |= alone[:-1] | (mark[1:] & ~mark[:-1])
        new[1:] |= dead[:-1]
        new[begin[length > 0]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(points))
        keep = ~dead[starts]
        starts, ends = starts[keep], ends[keep]
        symbols = self.symbol[points]
        symbols[alone & (points == _MARK)] = self.first + _MARK  # no piece: its bytes
        text_of = np.searchsorted(begin[length > 0], starts, "right") - 1
        which = np.flatnonzero(length > 0)[text_of]
        first_word = np.searchsorted(which, np.arange(len(texts)))
        seeds = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), self.seed) if t else 0 for t in texts], np.uint64)
        keys = mix(seeds[which] + (np.arange(len(starts)) - first_word[which]).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        return self._words(symbols, starts, ends - starts, keys, which, len(texts))

    def _words(self, symbols: np.ndarray, starts: np.ndarray, size: np.ndarray, keys: np.ndarray, which: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        skips = np.zeros(len(starts), bool)
        if self.limit:
            for c in range(LONG - 1):  # a word of n symbols has at most n - 1 candidates where none is skipped
                at = np.flatnonzero((size > c + 1) & ~skips)
                if not len(at):
                    break
                skips[at] = self._skipped(keys[at], c)
        # equal words without skips are segmented once
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(symbols.astype(np.uint64) + U(1)) * _powers(len(symbols)), dtype=np.uint64)))
        name = mix((prefix[starts + size] - prefix[starts]) * _inverse_powers(len(symbols))[starts]) ^ mix(size.astype(np.uint64))
        plain_at = np.flatnonzero(~skips & (size <= LONG))
        _, one, same = np.unique(name[plain_at], return_index=True, return_inverse=True)
        # names are hashes: a word that isn't its namesake, symbol by symbol, is segmented by itself
        n = size[plain_at]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differs = symbols[np.repeat(starts[plain_at], n) + nth] != symbols[np.repeat(starts[plain_at[one]][same], n) + nth]
        other = np.unique(np.repeat(np.arange(len(n)), n)[differs])
        same[other] = len(one) + np.arange(len(other))
        one = np.append(one, other)
        out_ids: list[np.ndarray] = []
        out_at = np.zeros(len(starts), np.int64)  # where a word's ids begin among all of out_ids, and how many they are
        out_n = np.zeros(len(starts), np.int64)
        total = 0
        for rows, skipping in ((plain_at[one], False), (np.flatnonzero(skips & (size <= LONG)), True)):
            rows = rows[np.argsort(size[rows], kind="stable")]
            a = 0
            while a < len(rows):
                width = int(size[rows[a]])
                wide = min(LONG, max(4, -(-width // 4) * 4))
                b = min(int(np.searchsorted(size[rows], wide, "right")), a + max(1, CELLS // wide))
                own = rows[a:b]
                cells = starts[own][:, None] + np.arange(wide)
                table = np.where(np.arange(wide) < size[own][:, None], symbols[np.minimum(cells, len(symbols) - 1)], np.int32(-1))
                table = self._side_by_side(table, keys[own], skipping)
                n = (table >= 0).sum(axis=1)
                out_n[own], out_at[own] = n, total + np.cumsum(n) - n
                out_ids.append(table[table >= 0])
                total += int(n.sum())
                a = b
        out_n[plain_at], out_at[plain_at] = out_n[plain_at[one]][same], out_at[plain_at[one]][same]
        for w in np.flatnonzero(size > LONG).tolist():
            ids = self._one(symbols[starts[w] : starts[w] + size[w]].tolist(), keys[w])
            out_n[w], out_at[w] = len(ids), total
            out_ids.append(np.array(ids, np.int32))
            total += len(ids)
        flat = np.concatenate([*out_ids, np.empty(0, np.int32)])
        ends = np.cumsum(out_n)
        ids = flat[np.repeat(out_at - ends + out_n, out_n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        owner = np.repeat(which, out_n)
        return self._with_bytes(ids, np.bincount(owner, minlength=n_texts), owner, n_texts)

    def _with_bytes(self, ids: np.ndarray, count: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the ids of their bytes."""
        strange = np.flatnonzero(ids >= self.first)
        if not len(strange):
            return ids, count
        raw = [chr(p).encode("utf-8", "replace") for p in (ids[strange] - self.first).tolist()]
        n = np.ones(len(ids), np.int64)
        n[strange] = [len(x) for x in raw]
        ends = np.cumsum(n)
        out = np.repeat(ids, n)
        at = np.repeat((ends - n)[strange], n[strange]) + np.arange(int(n[strange].sum())) - np.repeat(np.cumsum(n[strange]) - n[strange], n[strange])
        out[at] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.bincount(np.repeat(owner, n), minlength=n_texts)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        end = np.cumsum(size)
        text = self.table[np.repeat(self.start[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_BASE = 0x9E3779B97F4A7C15
_known_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    if len(_known_powers.get(base, ())) < n:
        _known_powers[base] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)
    return _known_powers[base][:n]


def _powers(n: int) -> np.ndarray:
    return _power_table(_BASE, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _power_table(pow(_BASE, -1, 1 << 64), n)


_codecs: dict[tuple, Codec] = {}


def _codec(model: bytes, *rest) -> Codec:
    key = (xxhash.xxh3_64_intdigest(model), *rest)
    if key not in _codecs:
        _codecs[key] = Codec(model, *rest)
    return _codecs[key]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _slices(whole: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Rows of about SLICE bytes of text at a time."""
    sizes = np.cumsum([0 if n is None else n for n in pc.binary_length(whole.column(at)).to_pylist()])
    s = 0
    while s < whole.num_rows:
        e = max(s + 1, int(np.searchsorted(sizes, (sizes[s - 1] if s else 0) + SLICE, "right")))
        yield whole.slice(s, e - s)
        s = e


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, keep_text: bool = True, check: bool = False) -> DataFrame:
    """docs and their ids (in place of columns of the same names); with check also lossless, whether decoding the ids gives the text back."""
    proto, at = _model(model), docs.columns.index(text_col)
    kept = [i for i, c in enumerate(docs.columns) if (keep_text or c != text_col) and c != ids_col and not (check and c == "lossless")]
    names = [docs.columns[i] for i in kept]
    schema = docs.select(*[plain(c) for c in names]).schema.add(ids_col, ArrayType(IntegerType()))
    if check:
        schema = schema.add("lossless", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(proto, dropout, seed)
        for whole in batches:
            for batch in _slices(whole, at):
                texts = batch.column(at).to_pylist()
                ids, count = codec.encode_all(texts)
                ends = np.cumsum(count)
                columns = [(batch.schema.field(i), batch.column(i)) for i in kept]
                offsets = pa.array(np.append(0, ends).astype(np.int32), mask=np.array([*(t is None for t in texts), False]))
                columns.append((pa.field(ids_col, pa.list_(pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))))
                if check:
                    ok = [t is None or codec.decode(ids[e - n : e]) == t for t, n, e in zip(texts, count.tolist(), ends.tolist())]
                    columns.append((pa.field("lossless", pa.bool_()), pa.array(ok, pa.bool_())))
                yield pa.RecordBatch.from_arrays([c for _, c in columns], schema=pa.schema([f for f, _ in columns]))

    return map_batches(docs, run, schema)


def decode(tokens: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """tokens and the text that their ids stand for (null for null)."""
    proto = _model(model)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        codec = _codec(proto, 0.0, 0)
        return ids.map(lambda x: None if x is None else codec.decode(x))

    return tokens.withColumn(text_col, text(plain(ids_col)))
