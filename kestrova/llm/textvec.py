"""Words of many texts at once, as arrays over the texts' bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = _LOWER.copy()
_ALNUM[:128][[not chr(c).isalnum() for c in range(128)]] = 32
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """Where each word of a batch starts and ends in ``data``, and in which text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    texts: int


def pieces(texts: pa.Array, most: int = 1 << 21) -> Iterator[pa.Array]:
    """Slices of about ``most`` bytes; a longer text stands alone, whole."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts, and len(texts) + 1 offsets into them; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def words(texts: pa.Array, bare: bool = False, lower: bool = True) -> Words:
    """The words `[^\\x20\\x09-\\x0D]+` of each text, with A-Z in lower case
    unless not ``lower``; if ``bare``, ASCII punctuation separates words too."""
    data, ends = raw(texts)
    data = _ALNUM[data] if bare else _LOWER[data] if lower else data
    inside = ~_SPACE[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    cut = ends[:-1][np.diff(ends) > 0]
    first = inside.copy()
    first &= ~before[:-1]
    first[cut] = inside[cut]
    start = np.flatnonzero(first)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:] & ~first[1:]
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(ends, start, side="right") - 1, len(ends) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_steps = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _steps
    if len(_steps) < n:
        more = np.full(max(n, 1024), _STEP, dtype=np.uint64)
        more[0] = 1
        _steps = np.multiply.accumulate(more)
    return _steps


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(w.start):
        return np.zeros(0, dtype=np.uint64)
    size = w.end - w.start
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    values = _BYTE[w.data[np.repeat(w.start, size) + within]]
    values *= _powers(int(size.max()))[within]
    return mix(np.add.reduceat(values, first) + size.astype(np.uint64))


def shingles(h: np.ndarray, text: np.ndarray, texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of n words; a text of fewer words has its whole
    sequence as one, a text without words none."""
    count = np.bincount(text, minlength=texts)
    start = np.cumsum(count) - count
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(texts), made)
    at = np.repeat(start - (np.cumsum(made) - made), made) + np.arange(int(made.sum()))
    size = np.minimum(count, n)[owner]
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        has = size > k
        out[has] = mix(out[has] * _STEP + h[at[has] + k])
    return out, owner
