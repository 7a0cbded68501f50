"""Words of many texts at once, as 64-bit hashes computed with numpy on the UTF-8 bytes of an Arrow batch.

A word is a run of characters other than U+0020 and U+0009 to U+000D.  Two different words share a hash with
probability 2**-64 or so; a text of 20,000 words has two such words once in about 10**11 texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time, unless a single text is longer.
CHUNK_BYTES = 1 << 18
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64, doubled in length when a longer text comes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        have = np.ones(size, np.uint64)
        if size > 1:
            have[1:] = np.uint64(base)
            np.multiply.accumulate(have, out=have)
        if n <= CHUNK_BYTES + (1 << 16):
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each code among the distinct ones, and for each of these the place where it occurs first."""
    _, first, which = np.unique(codes, return_index=True, return_inverse=True)
    return which, first


@dataclass
class Block:
    """Texts laid end to end: bytes, the offset of each text (one more at the end), the first of the rows they come
    from, and the place of the bytes among those of the whole column."""

    data: np.ndarray
    offsets: np.ndarray
    first: int
    base: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Block]:
    """Cuts a column of texts into blocks of whole texts of about ``limit`` bytes; null counts as empty."""
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield Block(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lo, int(at[lo] - at[0]))
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that no text boundary interrupts."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends


def hash_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for each pair, from one running sum over 64-bit values."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power_table(_BASE, n)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * _power_table(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes ``data[start:end]`` for each pair; pairs stand in the order of their places.

    Long data are hashed a stretch at a time: a hash depends on the bytes alone, not on their place.
    """
    if len(data) <= CHUNK_BYTES + (1 << 16):
        return hash_ranges(_TABLE[data], starts, ends)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
        lo, hi = starts[i], ends[j - 1]
        out[i:j] = hash_ranges(_TABLE[data[lo:hi]], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


@dataclass
class Words:
    """Words of a block: byte ranges, hashes and, for each text, the index of its first word (one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(block: Block, lower: bool = False) -> Words:
    """The words of every text; ``lower`` maps A-Z to a-z first."""
    data = LOWER[block.data] if lower else block.data
    starts, ends = runs(~SPACES[data], block.offsets)
    return Words(starts, ends, hashes(data, starts, ends), np.searchsorted(starts, block.offsets))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words within each text, and for each run the index of its text.

    A text of fewer words gives the whole sequence as one; a text without words gives none.  ``size`` is 64 at most.
    """
    count = words.counts()
    doc = np.repeat(np.arange(len(count)), count)
    h = words.hash
    whole = max(0, len(h) - size + 1)
    code = np.full(whole, size, np.uint64)
    for i in range(size):
        code += h[i : i + whole] * _STEPS[i]
    code = mix(code)
    inside = doc[:whole] == doc[size - 1 :] if whole else np.zeros(0, bool)
    code, doc = code[inside], doc[:whole][inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for k, d in enumerate(short):
            one = h[words.first[d] : words.first[d + 1]]
            extra[k] = mix((one * _STEPS[: len(one)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(count[d]))[0]
        code, doc = np.concatenate([code, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        code, doc = code[order], doc[order]
    return code, doc
