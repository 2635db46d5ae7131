"""Byte-level work on Arrow text columns: blocks of documents, words, hashes.

A *word* everywhere in this package is ``[^\\x20\\x09-\\x0D]+``: all separators
are single bytes in UTF-8, so words are found on the bytes without decoding.
Documents are taken in blocks of a few megabytes; a longer document is a block
of its own, so memory follows the longest document and never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_MUL = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def separator_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SEPARATORS)] = True
    return table


def lower_table() -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def plain_table() -> np.ndarray:
    """ASCII letters lower-cased, digits and all other scripts kept, the rest blank."""
    table = lower_table()
    plain = np.zeros(256, bool)
    plain[97:123] = plain[48:58] = plain[128:] = plain[65:91] = True
    table[~plain] = 0x20
    return table


class Block(NamedTuple):
    """Documents ``first`` to ``last`` of a batch as one run of bytes."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """A null text counts as an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, at, bytes_ = column.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(bytes_, np.uint8) if bytes_ is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1
        last = min(n, max(first + 1, last))
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


class Words(NamedTuple):
    """Byte ranges of all words of a block, and ``bounds[i]:bounds[i+1]`` of document i."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    if not len(data):
        nothing = np.zeros(0, np.int64)
        return Words(nothing, nothing, np.zeros(len(offsets), np.int64))
    inside = ~separator_table()[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[edges > 0] - 1
    stops[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all 64 bits over all 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _MUL), ("down", pow(_MUL, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, from one running sum over the block."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions near a border are meaningless."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j : j + n]
    return mix(out)


def gram_mask(bounds: np.ndarray, k: int) -> np.ndarray:
    """Which of the k-word windows over the whole block lie inside one document."""
    n = int(bounds[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    inside = np.zeros(n + 1, np.int32)
    lo, hi = bounds[:-1], np.maximum(bounds[1:] - k + 1, bounds[:-1])
    ok = hi > lo
    np.add.at(inside, lo[ok], 1)
    np.add.at(inside, np.minimum(hi[ok], n), -1)
    return np.cumsum(inside[:n]) > 0
