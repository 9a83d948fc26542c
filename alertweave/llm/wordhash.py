"""Hashes of the words of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

#: Word separators: the ASCII white space \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1024, _STEP, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes; ``apart``: which bytes separate words."""
    inside = np.concatenate([[False], ~apart[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, between: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its bytes' random values times a power of
    their place, mixed with its length. ``between``: whether each byte is outside words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(raw), dtype=np.int64)
    size = ends - starts
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(raw))))
    if int(size.max()) > len(_POWERS):
        power = np.cumprod(np.full(int(size.max()), _STEP, np.uint64))
    else:
        power = _POWERS
    value = np.where(SPACE[raw] if between is None else between, np.uint64(0), _LETTERS[raw] * power[np.minimum(place, len(power) - 1)])
    return mix(np.add.reduceat(value, starts) + size.astype(np.uint64))


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one array of bytes, a space after each, and where each begins (and the
    last ends)."""
    raw = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)
    return raw, np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
