"""Vectorised word and shingle hashing over the byte buffer of an Arrow string column.

Hashes have 64 bits.  Two different words or shingles get one hash with a chance of about
2**-54; the operators that count with these hashes say so in their docstrings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text makes a chunk of its own.
CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHTS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def separators(spaces: bytes) -> np.ndarray:
    """A table of 256 flags, true for bytes that separate words."""
    table = np.zeros(256, dtype=bool)
    table[list(spaces)] = True
    return table


def lowered() -> np.ndarray:
    """A table that lower-cases A-Z and leaves all other bytes."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


WHITE = separators(b"\x20\t\n\v\f\r")
LOWER = lowered()
SAME = np.arange(256, dtype=np.uint8)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) for runs of rows of about `size` bytes; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the chunk, and for each row the number of words before it."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(space[data], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]) if len(cuts) else cuts
    if len(cuts):  # a word that goes from one row into the next is two words
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, case: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[case][data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive hashes; len(words) - k + 1 of them, at least none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total += words[i : i + n] * _WEIGHTS[i]
    return mix(total)


def row_shingles(data: np.ndarray, offsets: np.ndarray, k: int, space: np.ndarray = WHITE, case: np.ndarray = LOWER) -> Iterator[np.ndarray]:
    """For each row its sorted distinct k-word shingle hashes; fewer words make one shingle, no word none."""
    starts, ends, first = word_bounds(data, offsets, space)
    hashes = word_hashes(data, starts, ends, case)
    every = shingle_hashes(hashes, k)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = int(b - a)
        if n >= k:
            own = np.sort(every[a : b - k + 1])  # np.unique hashes first, which is slower here
            new = own[1:] != own[:-1]
            yield own if new.all() else np.concatenate([own[:1], own[1:][new]])
        elif n:
            yield shingle_hashes(hashes[a:b], n) ^ np.uint64(n)
        else:
            yield np.zeros(0, dtype=np.uint64)
