"""Byte-pair encoding of distinct pre-tokens, many at a time, with the results of the tokenizers library.

Texts in any script are cut into pre-tokens with numpy, by the kind of each character: letter, digit, blank or other.
The kinds of characters outside ASCII are asked of the library's own pre-tokeniser, once for each character that comes
up.  All distinct pre-tokens of a few megabytes of text are merged side by side; those of more than LONGEST bytes are
merged by the library, one by one.  Only texts that hold the string of a special token are encoded by the library whole.

Memory: a few megabytes of text are worked on at a time; a longer text is cut at blanks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .words import blocks, distinct, hashes

LONGEST = 40
#: Bytes of text that are cut and merged at a time.
PART_BYTES = 1 << 20
_NONE = np.int32(1 << 30)
_SPACE, _LETTER, _DIGIT, _OTHER, _UNSEEN = 0, 1, 2, 3, 9
_KINDS = np.full(0x110000, _UNSEEN, np.uint8)
_KINDS[33:127] = _OTHER
_KINDS[48:58] = _DIGIT
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[[32, *range(9, 14)]] = _SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_signs() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


@dataclass
class Bpe:
    """Merge tables of a tokenizer file, the kinds of characters as far as known, and the library's tokenizer."""

    library: object
    kinds: np.ndarray
    special: list[bytes]
    base: np.ndarray
    last: np.ndarray
    codes: np.ndarray
    rank: np.ndarray
    made: np.ndarray
    slots: np.ndarray
    bits: int
    size: int
    words_only: bool

    def kinds_of(self, codes: np.ndarray) -> np.ndarray:
        """The kind of each code point.  New ones are put behind a letter, another sign and a digit: the library joins
        those of one kind, and what joins none is a blank, or a digit where digits stand alone."""
        new = np.unique(codes[self.kinds[codes] == _UNSEEN])
        if len(new):
            found = []
            for sign in "x!1":
                spans = {a: b for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str("".join(f"{sign}{chr(c)}\n" for c in new.tolist()))}
                found.append((np.array([spans.get(3 * i, 0) >= 3 * i + 2 for i in range(len(new))]), np.array([3 * i + 1 in spans for i in range(len(new))])))
            (letter, _), (other, _), (digit, alone) = found
            self.kinds[new] = np.select([letter, other, digit | (alone & self.words_only)], [_LETTER, _OTHER, _DIGIT], _SPACE)
        return self.kinds[codes]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of a pair in the tables, or -1."""
        code = left.astype(np.int64) * self.size + right
        slot = _slots(code, self.bits)
        held = self.slots[slot]
        at = np.where(self.codes[held] == code, held, -1)
        more = np.flatnonzero((at < 0) & (held >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & ((1 << self.bits) - 1)
            held = self.slots[slot[more]]
            hit = self.codes[held] == code[more]
            at[more[hit]] = held[hit]
            more = more[~hit & (held >= 0)]
        return at

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after another, and the number of ids of each."""
        lengths = ends - starts
        count = np.zeros(len(starts), np.int64)
        got: list[tuple[np.ndarray, np.ndarray]] = []
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            if length > LONGEST:
                for r in rows:
                    ids = self.library.encode(data[starts[r] : ends[r]].tobytes().decode(), add_special_tokens=False).ids
                    count[r] = len(ids)
                    got.append((np.array([r]), np.array([ids], np.int32)))
                continue
            sign = data[starts[rows][:, None] + np.arange(length)]
            symbols = self.base[sign]
            symbols[:, -1] = self.last[sign[:, -1]]
            place = self._pair(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(rows), length - 1)
            rank = np.where(place < 0, _NONE, self.rank[place])
            while symbols.shape[1] > 1 and len(rows):
                best = rank.argmin(axis=1)
                here = np.arange(len(rows))
                open_ = rank[here, best] < _NONE
                if not open_.all():
                    done = ~open_
                    got.append((rows[done], symbols[done]))
                    rows, symbols, rank, best = rows[open_], symbols[open_], rank[open_], best[open_]
                    here = np.arange(len(rows))
                    if not len(rows):
                        break
                left, right = symbols[here, best], symbols[here, best + 1]
                new = self.made[self._pair(left, right)]
                width = symbols.shape[1]
                keep = np.ones((len(rows), width), bool)
                keep[here, best + 1] = False
                symbols[here, best] = new
                symbols = symbols[keep].reshape(len(rows), width - 1)
                keep = keep[:, 1:]
                rank = rank[keep].reshape(len(rows), width - 2)
                for beside, a, b in ((best - 1, best - 1, best), (best, best, best + 1)):
                    ok = np.flatnonzero((a >= 0) & (b < width - 1))
                    if len(ok):
                        at = self._pair(symbols[ok, a[ok]], symbols[ok, b[ok]])
                        rank[ok, beside[ok]] = np.where(at < 0, _NONE, self.rank[at])
            if len(rows):
                got.append((rows, symbols))
        for rows, symbols in got:
            count[rows] = symbols.shape[1]
        first = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), np.int32)
        for rows, symbols in got:
            ids[first[rows][:, None] + np.arange(symbols.shape[1])] = symbols
        return ids, count


def _slots(code: np.ndarray, bits: int) -> np.ndarray:
    return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)


def _open_table(code: np.ndarray, bits: int) -> np.ndarray:
    """Places of codes in a table of ``2**bits`` slots, each in the first free slot from its own on; -1 where free."""
    table, wait, slot = np.full(1 << bits, -1, np.int32), np.arange(len(code)), _slots(code, bits)
    while len(wait):
        free = table[slot[wait]] < 0
        table[slot[wait[free]]] = wait[free]
        wait = wait[table[slot[wait]] != wait]
        slot[wait] = (slot[wait] + 1) & ((1 << bits) - 1)
    return table


@lru_cache(4)
def load(path: str) -> Bpe:
    """The tables of a tokenizer file of the tokenizers library: byte-level, or lower-case words with ends."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, signs = spec["model"], _byte_signs()
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    size = max(vocab.values()) + 1
    code = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
    made = np.array([vocab[a + b] for a, b in merges], np.int32)
    bits = len(code).bit_length() + 2
    special = [t["content"].encode() for t in spec.get("added_tokens") or []]
    return Bpe(
        Tokenizer.from_file(path), _KINDS.copy(), special, np.array([vocab[s] for s in signs], np.int32), np.array([vocab[s + suffix] for s in signs], np.int32),
        np.append(code, -1), np.arange(len(code), dtype=np.int32), made, _open_table(code, bits), bits, size, bool(suffix),
    )


def _after(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    out[:-1] = x[1:]
    return out


def _byte_kinds(data: np.ndarray, bpe: Bpe) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte's character, and which bytes begin a character."""
    kind = bpe.kinds[data]
    low = np.flatnonzero((kind == _UNSEEN) & (data < 0x80))
    kind[low] = bpe.kinds_of(data[low].astype(np.int64))
    heads = np.flatnonzero(data >= 0xC0)
    if len(heads):
        size = 2 + (data[heads] >= 0xE0) + (data[heads] >= 0xF0)
        code = (data[heads] & (0x7F >> size)).astype(np.int64)
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | (data[heads[more] + k] & 0x3F)
        found = bpe.kinds_of(code)
        for k in range(4):
            more = size > k
            kind[heads[more] + k] = found[more]
    return kind, (data & 0xC0) != 0x80


def pretokens(data: np.ndarray, offsets: np.ndarray, bpe: Bpe) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the pre-tokens, and the text of each.

    Words only: runs of letters, single digits and runs of other signs, blanks dropped.  Otherwise a U+0020 before such
    a run (digits in runs too) belongs to it, and other blanks are pre-tokens of their own: a run of them up to its last
    one, if that stands before another sign, else the whole run.  An apostrophe that begins a pre-token takes s, t, re,
    ve, m, ll or d after it.
    """
    n = len(data)
    follow = _after(data)
    kind, head = _byte_kinds(data, bpe)
    border = np.ones(n, bool)
    border[1:] = kind[1:] != kind[:-1]
    border[offsets[:-1][offsets[:-1] < n]] = True
    if bpe.words_only:
        border |= (kind == _DIGIT) & head
    starts = np.flatnonzero(border)
    ends = np.append(starts[1:], n)[: len(starts)]
    what = kind[starts]
    text = np.searchsorted(offsets, starts, "right") - 1
    chained = np.zeros(len(starts), bool)  # the next run follows in the same text
    chained[:-1] = text[1:] == text[:-1]
    blank = what == _SPACE
    joins = np.zeros(len(starts), bool)
    extra: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not bpe.words_only and len(starts):
        last = ends - 1  # where the last character of a run begins
        for _ in range(3):
            last = last - ~head[last]
        joins[1:] = (blank & chained & (data[last] == 0x20))[:-1]
        lead = blank & chained & (last > starts)
        extra.append((starts[lead], last[lead], text[lead]))
        own = blank & chained & (data[last] != 0x20)
        extra.append((last[own], ends[own], text[own]))
        tail = blank & ~chained
        extra.append((starts[tail], ends[tail], text[tail]))
    quote = np.flatnonzero((what == _OTHER) & (ends - starts == 1) & (data[starts] == ord("'")) & ~joins & chained)
    quote = quote[what[quote + 1] == _LETTER] if len(quote) else quote
    if len(quote):
        c1, room = data[starts[quote + 1]], ends[quote + 1] - starts[quote + 1]
        c2 = np.where(room > 1, follow[starts[quote + 1]], 0)
        one = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        step = np.where(one, 1, np.where(two, 2, 0))
        ends[quote] += step
        starts[quote + 1] += step
    starts = starts - joins
    keep = ~blank & (ends > starts)
    starts, ends, text = starts[keep], ends[keep], text[keep]
    if extra:
        starts, ends, text = (np.concatenate([x, *y]) for x, y in zip((starts, ends, text), zip(*extra, strict=True), strict=True))
        order = np.argsort(starts, kind="stable")
        starts, ends, text = starts[order], ends[order], text[order]
    return starts, ends, text


@dataclass
class Pieces:
    """Pre-tokens of texts: the row of the first text, the text and the distinct pre-token of each pre-token, the ids of
    the distinct ones one after another, the number of ids of each, and the texts that hold a special token."""

    first: int
    texts: int
    text: np.ndarray
    which: np.ndarray
    ids: np.ndarray
    count: np.ndarray
    special: np.ndarray


def _merged(data: np.ndarray, offsets: np.ndarray, bpe: Bpe, first: int, special: np.ndarray) -> Pieces:
    """Cuts texts into pre-tokens, finds the distinct ones by hash and encodes each of these once."""
    starts, ends, text = pretokens(data, offsets, bpe)
    which, sample = distinct(hashes(data, starts, ends))
    ids, count = bpe.merge(data, starts[sample], ends[sample])
    return Pieces(first, len(offsets) - 1, text, which, ids, count, special)


def _normalised(data: np.ndarray, offsets: np.ndarray, bpe: Bpe) -> tuple[np.ndarray, np.ndarray]:
    """Texts as the tokenizer file normalises them; the library is asked where they hold more than ASCII characters and
    Latin-1 letters."""
    if bpe.library.normalizer is None:
        return data, offsets
    follow = _after(data)
    latin = (data == 0xC3) & ((follow & 0xC0) == 0x80) & (follow != 0x97) & (follow != 0xB7)
    odd = data >= 0x80
    odd[latin] = False
    odd[1:] &= ~latin[:-1]
    rows = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)
    big = np.flatnonzero(latin & (follow <= 0x9E))
    data = _LOWER[data]
    data[big + 1] += 0x20
    if not len(rows):
        return data, offsets
    parts, size, at = [], np.diff(offsets), 0
    for i in rows.tolist():
        made = np.frombuffer(bpe.library.normalizer.normalize_str(bytes(data[offsets[i] : offsets[i + 1]]).decode()).encode(), np.uint8)
        parts += [data[at : offsets[i]], made]
        size[i], at = len(made), offsets[i + 1]
    return np.concatenate([*parts, data[at:]]), np.concatenate([[0], np.cumsum(size)])


def _cut(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a text of about PART_BYTES that end before a U+0020 after a sign that is no blank: no pre-token crosses
    such a place."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + PART_BYTES)
        while hi < len(data):
            ahead = data[hi - 1 : hi + PART_BYTES]
            found = np.flatnonzero((ahead[1:] == 0x20) & (ahead[:-1] > 0x20) & (ahead[:-1] < 0x7F))
            if len(found):
                hi += int(found[0])
                break
            hi = min(len(data), hi + PART_BYTES)
        yield data[lo:hi]
        lo = hi


def pieces(column: pa.Array, bpe: Bpe) -> Iterator[Pieces]:
    """The pre-tokens of a column of texts, a few megabytes at a time; parts of a long text come one after another.

    Texts with the string of a special token are named and have no pre-tokens.
    """
    for block in blocks(column, PART_BYTES):
        data, offsets = block.data, block.offsets
        special = np.zeros(len(block), bool)
        opens = {s[:2] for s in bpe.special if len(s) > 1}
        maybe = sum(((data == o[0]) & (_after(data) == o[1]) for o in opens), np.zeros(len(data), bool))
        for i in np.unique(np.searchsorted(offsets, np.flatnonzero(maybe), "right") - 1).tolist():
            special[i] = any(s in bytes(data[offsets[i] : offsets[i + 1]]) for s in bpe.special)
        if special.any():
            plain = np.repeat(~special, np.diff(offsets))
            data, offsets = data[plain], np.concatenate([[0], np.cumsum(np.diff(offsets) * ~special)])
        data, offsets = _normalised(data, offsets, bpe)
        if len(block) > 1 or len(data) <= 2 * PART_BYTES:
            yield _merged(data, offsets, bpe, block.first, special)
        else:
            for part in _cut(data):
                yield _merged(part, np.array([0, len(part)]), bpe, block.first, special)


def _by_library(column: pa.Array, rows: np.ndarray, bpe: Bpe) -> Iterator[np.ndarray]:
    for r in rows.tolist():
        yield np.array(bpe.library.encode(column[r].as_py(), add_special_tokens=False).ids, np.int32)


def token_counts(column: pa.Array, bpe: Bpe) -> np.ndarray:
    """Tokens of every text: the count of each distinct pre-token, joined to the pre-tokens of the texts and summed."""
    out = np.zeros(len(column), np.int64)
    for got in pieces(column, bpe):
        out[got.first : got.first + got.texts] += np.bincount(got.text, weights=got.count[got.which], minlength=got.texts).astype(np.int64)
        rows = got.first + np.flatnonzero(got.special)
        out[rows] = [len(x) for x in _by_library(column, rows, bpe)]
    return out


def encoded(column: pa.Array, bpe: Bpe) -> Iterator[np.ndarray]:
    """The ids of every text."""
    held: list[np.ndarray] = []  # parts of a text that has more to come
    row = 0
    for got in pieces(column, bpe):
        if held and got.first > row:
            yield np.concatenate(held)
            held = []
        row = got.first
        first = np.cumsum(got.count) - got.count
        n = got.count[got.which]
        stop = np.cumsum(n)
        flat = got.ids[np.arange(int(n.sum())) - np.repeat(stop - n, n) + np.repeat(first[got.which], n)]
        if got.texts == 1 and not got.special[0]:
            held.append(flat)
            continue
        at = np.zeros(got.texts + 1, np.int64)
        np.cumsum(np.bincount(got.text, weights=n, minlength=got.texts).astype(np.int64), out=at[1:])
        whole = _by_library(column, got.first + np.flatnonzero(got.special), bpe)
        for i in range(got.texts):
            yield next(whole) if got.special[i] else flat[at[i] : at[i + 1]]
    if held:
        yield np.concatenate(held)
