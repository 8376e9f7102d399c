"""Hashes over NumPy arrays of unsigned 64-bit integers (arithmetic wraps)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_MULTIPLIER = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def windows(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(width):
        acc = acc * _MULTIPLIER + tokens[i : i + n]
    return mix(acc)


_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            _powers[name] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base))), dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def rolled(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width tokens, at a cost that doesn't depend on the width."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(tokens))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens * up, dtype=np.uint64)))
    return mix((prefix[width:] - prefix[:-width]) * down[:n])


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_CODES = [mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER + U(salt << 32)) for salt in range(2)]
#: Bytes of text whose words are hashed at a time.
_SLICE = 1 << 20


def word_hashes(raw: bytes, salt: int = 0) -> np.ndarray:
    """A hash of each word (run of bytes other than ASCII white space) of a text, in order; another family for each salt."""
    out, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > _SLICE:
            near = max(raw.rfind(x, at, at + _SLICE) for x in (b" ", b"\n", b"\t"))
            if near > at:
                end = near
            else:  # one very long word: to its end
                end = next((i for i in range(at + _SLICE, len(raw)) if _SPACE[raw[i]]), len(raw))
        out.append(_hashes_of(np.frombuffer(raw, np.uint8, end - at, at), salt))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _hashes_of(part: np.ndarray, salt: int) -> np.ndarray:
    word = np.concatenate(([False], ~_SPACE[part], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(part) + 1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODES[salt][part] * up[: len(part)], dtype=np.uint64)))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane, which block compression then shortens."""
    return np.ascontiguousarray(np.diff(sorted_hashes, prepend=U(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
