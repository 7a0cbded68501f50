"""Recompression of word sequences: rounds that name runs and pairs of symbols by global rules, many texts at once.

A name is a 64-bit mix of what it stands for, so equal runs and pairs get equal names in every task, without a dictionary.
Each symbol carries the stretch of words that decide it: wherever these words occur, the same symbol arises in the same
place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import mix

#: Kinds of the rounds.  Symbols of more than ``LONGEST`` words take no further part, so symbols stay short.
ROUNDS = ("runs", "pairs", "pairs", "pairs", "pairs", "pairs", "pairs")
LONGEST = 6
_A, _B, _RUN = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_SIDE = 0x9FB21C651E98DF25
#: Ends of the deciding stretch of a symbol that hangs on the edge of its text.
BEFORE, BEYOND = -(1 << 40), 1 << 40


@dataclass
class Symbols:
    """Symbols of texts laid end to end: names, texts, words ``start:end``, and the words ``low:high`` that decide them."""

    name: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __len__(self) -> int:
        return len(self.name)

    def pick(self, keep: np.ndarray) -> Symbols:
        return Symbols(*(x[keep] for x in (self.name, self.text, self.start, self.end, self.low, self.high)))


def _beside(s: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each symbol and the next are of one text; the deciding stretches of the neighbours, open at edges."""
    joined = s.text[:-1] == s.text[1:]
    left, right = np.full(len(s), BEFORE), np.full(len(s), BEYOND)
    left[1:] = np.where(joined, s.low[:-1], BEFORE)
    right[:-1] = np.where(joined, s.high[1:], BEYOND)
    return joined, left, right


def runs(s: Symbols) -> Symbols:
    """Names maximal blocks of equal short symbols; which block a symbol is in is decided by both neighbours too."""
    if not len(s):
        return s
    joined, left, right = _beside(s)
    short = s.end - s.start <= LONGEST
    same = joined & (s.name[:-1] == s.name[1:]) & short[:-1]
    low, high = np.where(short, np.minimum(s.low, left), s.low), np.where(short, np.maximum(s.high, right), s.high)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.append(first[1:], len(s)) - 1
    length = last - first + 1
    name = s.name[first]
    block = length > 1
    name[block] = mix(name[block] * _RUN + length[block].astype(np.uint64))
    return Symbols(name, s.text[first], s.start[first], s.end[last], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first))


def pairs(s: Symbols, turn: int) -> Symbols:
    """Deals names to a left and a right side and names each left symbol with a right one after it.

    A pair is decided by its own symbols; a short symbol that stays single also by the neighbour that it might have met.
    """
    if len(s) < 2:
        return Symbols(s.name, s.text, s.start, s.end, np.full(len(s), BEFORE), np.full(len(s), BEYOND))
    joined, left, right = _beside(s)
    short = s.end - s.start <= LONGEST
    side = (mix(s.name + np.uint64(_SIDE * (turn + 1) % (1 << 64))) & np.uint64(1)).astype(bool)
    meets = np.flatnonzero(joined & short[:-1] & short[1:] & ~side[:-1] & side[1:])
    low, high = np.where(short & side, np.minimum(s.low, left), s.low), np.where(short & ~side, np.maximum(s.high, right), s.high)
    low[meets], high[meets] = s.low[meets], np.maximum(s.high[meets], s.high[meets + 1])
    low[meets] = np.minimum(low[meets], s.low[meets + 1])
    name, end = s.name.copy(), s.end.copy()
    name[meets] = mix(s.name[meets] * _A + s.name[meets + 1] * _B)
    end[meets] = s.end[meets + 1]
    keep = np.ones(len(s), bool)
    keep[meets + 1] = False
    return Symbols(name, s.text, s.start, end, low, high).pick(keep)


def recompressed(words: np.ndarray, text: np.ndarray, rounds: tuple[str, ...] = ROUNDS) -> Symbols:
    """The symbols of the last round for hashes of words and the text that each is of."""
    at = np.arange(len(words), dtype=np.int64)
    s = Symbols(words, text, at, at + 1, at, at + 1)
    for turn, kind in enumerate(rounds):
        s = runs(s) if kind == "runs" else pairs(s, turn)
    return s
