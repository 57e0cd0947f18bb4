"""Whole Arrow string columns cut into hashed words with numpy: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time, unless one text is longer.
CHUNK = 1 << 20
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240607)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B]  # A-Z hash as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys (numpy's own `unique` hashes them, which is many times slower than its sort)."""
    keys = np.sort(keys)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys[first]


def power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        steps = np.full(2 * n, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    base, end = (int(off[0]), int(off[-1])) if len(off) else (0, 0)
    body = np.frombuffer(data, np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
    return body, off - base


def slices(batch: pa.RecordBatch, text: str, budget: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut between rows into parts of about budget bytes of text; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    _, off = raw(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + budget, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, for each text the index of its first word, and the total)."""
    n = len(off) - 1
    if len(body) > CHUNK and n > 1:  # in halves between texts: the work space is several times the text
        m = min(max(1, int(np.searchsorted(off, len(body) // 2))), n - 1)
        (a, x), (b, y) = words(body[: off[m]], off[: m + 1]), words(body[off[m] :], off[m:] - off[m])
        return np.concatenate([a, b]), np.concatenate([x[:-1], y + len(a)])
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    space = _WS[body]
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1]
    heads = off[:-1][off[1:] > off[:-1]]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, off)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    letters = body[solid]
    at = np.flatnonzero(first[solid])
    length = np.diff(at, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(at, length)
    h = np.add.reduceat(_LETTER[letters] * power(int(length.max()))[place], at)
    return mix(h + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted within it; a text with fewer words is one shingle, an empty one none."""
    parts, sizes = [], np.zeros(len(bounds) - 1, np.int64)
    if len(hashes) >= k:
        rolled = np.zeros(len(hashes) - k + 1, np.uint64)
        for i in range(k):
            rolled = mix(rolled * np.uint64(0x2545F4914F6CDD1D) + hashes[i : len(hashes) - k + 1 + i])
    for d in range(len(sizes)):
        a, b = int(bounds[d]), int(bounds[d + 1])
        if b - a >= k:
            own = distinct(rolled[a : b - k + 1])
        elif b > a:
            own = np.array([b - a], np.uint64)
            for w in hashes[a:b]:
                own = mix(own * np.uint64(0x2545F4914F6CDD1D) + w)
        else:
            continue
        parts.append(own)
        sizes[d] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


_SHAPE = np.zeros(256, np.uint64)
_SHAPE[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = _rng.integers(1, 2**63, sum(not chr(c).isalnum() for c in range(0x21, 0x7F)), dtype=np.uint64)
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1


def words_and_shapes(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, shape hashes, bounds): a word's shape is its ASCII marks, counted from its end, and whether it shouts."""
    hashes, bounds = words(body, off)
    if not len(hashes):
        return hashes, hashes, bounds
    solid = ~_WS[body]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = off[:-1][off[1:] > off[:-1]]
    first[heads] = solid[heads]
    letters = body[solid]
    at = np.flatnonzero(first[solid])
    length = np.diff(at, append=len(letters))
    back = np.repeat(at + length, length) - np.arange(len(letters))
    marks = np.add.reduceat(_SHAPE[letters] * power(int(length.max()) + 1)[back], at)
    loud = np.add.reduceat(_UPPER[letters], at) >= 2
    return hashes, mix(marks + loud.astype(np.uint64) * np.uint64(0x94D049BB133111EB)), bounds
