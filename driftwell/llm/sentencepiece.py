"""SentencePiece models: Unigram Viterbi over a double-array trie of pieces, byte fallback, decoding.

The log scores are those of the model file if it is a Unigram model.  In a BPE model the score of a piece is minus its
merge rank r, which is no log probability; such a piece gets ``-log(1 + r)``, the log of its share under Zipf's law but
for a constant.  A text is cut where a blank follows another character; no piece
crosses such a place, so the best path of a text is the best paths of its segments, one after another.  The distinct
segments of a few megabytes of text, found by hash, go through the trie side by side, and their ids are dealt back to
the texts.  Segments of more than LONG bytes, such as texts without blanks, go through it alone, a window at a time.

Memory: a worker takes on about SLICE_BYTES of texts at a time; a longer text is cut at its segments.  A single segment
needs 6 bytes for each of its own beyond that.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from .shared import bounded_batches, slices
from .words import blocks, distinct, hashes

#: Fixed values of the format: field numbers, piece types, the marker of a blank, the penalty of an unknown character.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
#: Cells of a Viterbi table made at a time.
CELLS = 1 << 21
#: Bytes from which a segment goes through the trie alone, and the bytes of one window of it.
LONG, WINDOW = 256, 1 << 15
#: Bytes of a text that are cut into segments at a time.
PART_BYTES = 1 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Trie:
    """A double array: the child of node s by byte c is ``t = base[s] + c``, if ``check[t] == s``."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(keys: dict[bytes, int]) -> Trie:
    """Places the nodes level by level, each family of children at the first base where its slots are free."""
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for key, value in keys.items():
        node = 0
        for byte in key:
            if (nxt := children[node].get(byte)) is None:
                nxt = children[node][byte] = len(children)
                children.append({})
                values.append(-1)
            node = nxt
        values[node] = value
    size = len(children) * 2 + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0] = 1
    place, free, queue = {0: 0}, 1, deque([0])
    while queue:
        node = queue.popleft()
        at = place[node]
        value[at] = values[node]
        if not (codes := sorted(children[node])):
            continue
        while taken[free]:
            free += 1
        slot, used, begin = max(free, codes[0] + 1), 0, max(free, codes[0] + 1)
        while True:
            if slot + 512 > size:
                grow = size
                base, value = np.append(base, np.zeros(grow, np.int32)), np.append(value, np.full(grow, -1, np.int32))
                check = np.append(check, np.full(grow, -1, np.int32))
                taken.extend(bytes(grow))
                size += grow
            b = slot - codes[0]
            if taken[slot]:
                used += 1
            elif not any(taken[b + c] for c in codes):
                break
            slot += 1
        if used > 64 and used >= 0.9 * (slot - begin):
            free = slot  # hardly a slot before this one is free
        base[at] = b
        for c in codes:
            taken[b + c] = 1
            check[b + c] = at
            place[children[node][c]] = b + c
            queue.append(children[node][c])
    end = max(place.values()) + 257
    return Trie(base[:end], check[:end], value[:end])


@dataclass
class Model:
    """A model file: the trie of pieces (a blank for the marker), scores, and the bytes that each id stands for."""

    trie: Trie
    score: np.ndarray
    unknown_score: float
    unknown: int
    byte_ids: np.ndarray | None
    prefix: bool
    text: np.ndarray
    text_at: np.ndarray
    whole: bool
    longest: int

    def viterbi(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of segments one after another, the number of ids of each, and of these the bytes that no piece covers."""
        length = ends - starts
        count, fallback = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        got = []
        for i in np.flatnonzero(length > LONG):
            ids, fallback[i] = self.path(data[starts[i] : ends[i]])
            count[i] = len(ids)
            got.append((np.array([i]), ids))
        short = np.flatnonzero(length <= LONG)
        width = np.where(length <= 24, length, np.ceil(1.25 ** np.ceil(np.log(np.maximum(length, 1)) / np.log(1.25) - 1e-9)).astype(np.int64))
        width = np.maximum(width, length)
        order = short[np.argsort(width[short], kind="stable")]
        at = 0
        while at < len(order):
            w = int(width[order[at]])
            stop = min(int(np.searchsorted(width[order], w, "right")), at + max(1, CELLS // max(w, 1)))
            rows = order[at:stop]
            ids, n, raw = self._group(data, starts[rows], length[rows], w)
            count[rows], fallback[rows] = n, raw
            got.append((rows, ids))
            at = stop
        first = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for rows, ids in got:
            n = count[rows]
            out[np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows], n)] = ids
        return out, count, fallback

    def path(self, byte: np.ndarray) -> tuple[np.ndarray, int]:
        """Ids of one long segment, and how many of its bytes no piece covers.

        The trie is walked from all places of a window at once; the best path is then followed from place to place.  Of
        the path only the length and the piece of the last step to each place are kept.
        """
        n, trie, unknown = len(byte), self.trie, self.unknown_score
        byte = byte.astype(np.int32)
        steps, pieces = np.zeros(n + 1, np.int16), np.full(n + 1, -1, np.int32)
        reach = max(self.longest, 4)
        best: list[float] = [0.0] + [-np.inf] * (WINDOW + reach)
        for lo in range(0, n, WINDOW):
            hi = min(n, lo + WINDOW)
            heads = lo + np.flatnonzero((byte[lo:hi] & 0xC0) != 0x80)
            live, node, found = heads, np.zeros(len(heads), np.int32), []
            for k in range(self.longest):
                ok = live + k < n
                live, node = live[ok], node[ok]
                t = trie.base[node] + byte[live + k]
                ok = trie.check[t] == node
                live, node = live[ok], t[ok]
                if not len(live):
                    break
                hit = trie.value[node] >= 0
                found.append((live[hit], np.full(int(hit.sum()), k + 1), trie.value[node[hit]]))
            at, size, value = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            order = np.argsort(at, kind="stable")
            first = np.searchsorted(at[order], heads).tolist() + [len(at)]
            size, value = size[order], value[order]
            gain, size, value = self.score[value].tolist(), size.tolist(), value.tolist()
            char = np.ones(len(heads), np.int64)  # bytes of the character at each head
            for k in (1, 2, 3):
                inside = heads + k < n
                char[inside] += (char[inside] == k) & ((byte[heads[inside] + k] & 0xC0) == 0x80)
            step, piece = [0] * (hi - lo + reach + 1), [-1] * (hi - lo + reach + 1)
            for j, (i, c) in enumerate(zip((heads - lo).tolist(), char.tolist(), strict=True)):
                here, single = best[i], False
                for e in range(first[j], first[j + 1]):
                    end = i + size[e]
                    single |= size[e] == c
                    if here + gain[e] > best[end]:
                        best[end], step[end], piece[end] = here + gain[e], size[e], value[e]
                if not single and here + unknown > best[i + c]:
                    best[i + c], step[i + c], piece[i + c] = here + unknown, c, -1
            seen = min(hi - lo + reach, n - lo) + 1
            new = np.flatnonzero(np.array(step[:seen]) > 0)  # places before the window keep what the last one found, unless beaten
            steps[lo + new], pieces[lo + new] = np.array(step, np.int16)[new], np.array(piece, np.int32)[new]
            best = best[hi - lo : hi - lo + reach + 1] + [-np.inf] * WINDOW
        out, raw, at = [], 0, n
        while at > 0:
            size, value = int(steps[at]), int(pieces[at])
            if value >= 0:
                out.append(value)
            else:
                raw += size
                out.extend([self.unknown] if self.byte_ids is None else self.byte_ids[byte[at - size : at]][::-1].tolist())
            at -= size
        return np.array(out[::-1], np.int32), raw

    def _group(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = len(starts)
        cells = np.minimum(starts[:, None] + np.arange(w), len(data) - 1)
        byte = data[cells].astype(np.int32)
        byte[np.arange(w) >= length[:, None]] = 0
        heads = ((byte & 0xC0) != 0x80) & (np.arange(w) < length[:, None])
        size = np.ones((rows, w), np.int32)  # bytes of the character that begins at a place
        for i in range(1, min(4, w)):
            size[:, :-i] += ((size[:, :-i] == i) & ((byte[:, i:] & 0xC0) == 0x80)).astype(np.int32)
        best = np.full((rows, w + 1), -np.inf)
        best[:, 0] = 0.0
        origin, piece = np.zeros((rows, w + 1), np.int32), np.full((rows, w + 1), -1, np.int32)
        trie = self.trie
        for i in range(w):
            live = np.flatnonzero(heads[:, i])
            if not len(live):
                continue
            here, node, char = best[:, i], np.zeros(len(live), np.int32), size[:, i]
            single = np.zeros(rows, bool)
            for k in range(i, w):
                t = trie.base[node] + byte[live, k]
                ok = (trie.check[t] == node) & (k < length[live])
                live, node = live[ok], t[ok]
                if not len(live):
                    break
                value = trie.value[node]
                hit = np.flatnonzero(value >= 0)
                if len(hit):
                    r, v = live[hit], value[hit]
                    single[r] |= char[r] == k + 1 - i
                    score = here[r] + self.score[v]
                    up = score > best[r, k + 1]
                    r, v = r[up], v[up]
                    best[r, k + 1], origin[r, k + 1], piece[r, k + 1] = score[up], i, v
            r = np.flatnonzero(heads[:, i] & ~single)
            if len(r):
                end = i + char[r]
                score = here[r] + self.unknown_score
                up = score > best[r, end]
                r, end = r[up], end[up]
                best[r, end], origin[r, end], piece[r, end] = score[up], i, -1
        chosen = np.full((rows, w), -1, np.int32)
        raw = np.zeros(rows, np.int64)
        live, pos = np.flatnonzero(length > 0), length[length > 0].astype(np.int64)
        while len(live):
            start, value = origin[live, pos], piece[live, pos]
            known = value >= 0
            chosen[live[known], start[known]] = value[known]
            for r, s, e in zip(live[~known], start[~known], pos[~known], strict=True):
                if self.byte_ids is None:
                    chosen[r, s] = self.unknown
                else:
                    chosen[r, s:e] = self.byte_ids[byte[r, s:e]]
                raw[r] += e - s
            more = start > 0
            live, pos = live[more], start[more]
        n = (chosen >= 0).sum(axis=1)
        return chosen[chosen >= 0], n, raw

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids: pieces with blanks for markers, byte pieces as bytes, without the blank put before a text."""
        n = np.diff(self.text_at)[ids]
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        out = self.text[np.arange(total) - np.repeat(stop - n, n) + np.repeat(self.text_at[:-1][ids], n)].tobytes()
        return out[1:] if self.prefix and out[:1] == b" " else out


@lru_cache(2)
def load(path: str) -> Model:
    """Reads a SentencePiece model file."""
    with open(path, "rb") as f:
        data = f.read()
    pieces: list[tuple[bytes, float, int]] = []
    prefix, ranked = True, False
    for number, value in fields(data):
        if number == 1:
            got = dict(fields(value))
            pieces.append((got[1], float(np.frombuffer(got.get(2, bytes(4)), "<f4")[0]), got.get(3, NORMAL)))
        elif number == 2:
            ranked = dict(fields(value)).get(3, 1) == 2
        elif number == 3:
            spec = dict(fields(value))
            prefix = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                raise ValueError("only models that leave the text as it is but for blanks are read")
    marker = MARKER.encode()
    texts = [p.replace(marker, b" ") if kind in (NORMAL, USER_DEFINED, UNUSED) else b"" for p, _, kind in pieces]
    byte_ids = np.full(256, -1, np.int32)
    for i, (p, _, kind) in enumerate(pieces):
        if kind == BYTE:
            texts[i] = bytes([int(p[3:5], 16)])
            byte_ids[texts[i][0]] = i
    keys = {texts[i]: i for i, (_, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED) and texts[i]}
    score = np.array([s for _, s, _ in pieces])
    if ranked:
        score = np.round(-np.log1p(np.maximum(-score, 0)) * 2**20) / 2**20  # so that sums are exact and ties are ties
    lowest = min(s for s, (_, _, kind) in zip(score, pieces, strict=True) if kind in (NORMAL, USER_DEFINED))
    crosses = any(b" " in t.lstrip(b" ") for t in keys)
    unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
    return Model(
        build_trie(keys), score, lowest - UNKNOWN_PENALTY, unknown, byte_ids if (byte_ids >= 0).all() else None, prefix,
        np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), crosses, max(map(len, keys), default=1),
    )


def _borders(data: np.ndarray, offsets: np.ndarray, whole: bool) -> np.ndarray:
    """Where segments begin: at texts, and at each blank after another character."""
    border = np.zeros(len(data), bool)
    border[offsets[:-1][np.diff(offsets) > 0]] = True
    if not whole and len(data):
        border[1:] |= (data[1:] == 0x20) & (data[:-1] != 0x20)
    return np.flatnonzero(border)


def _cut(data: np.ndarray, whole: bool) -> Iterator[np.ndarray]:
    """Parts of one text of about PART_BYTES that end where segments end; a longer segment is a part of its own."""
    lo = 0
    while lo < len(data):
        hi = len(data) if whole else min(len(data), lo + PART_BYTES)
        while hi < len(data):
            ahead = data[hi - 1 : hi + PART_BYTES]
            found = np.flatnonzero((ahead[1:] == 0x20) & (ahead[:-1] != 0x20))
            if len(found):
                hi += int(found[0])
                break
            hi = min(len(data), hi + PART_BYTES)
        if hi - lo > 2 * PART_BYTES:  # what comes before a segment that is so long is dealt with first
            inside = data[lo : lo + PART_BYTES + 1]
            last = np.flatnonzero((inside[1:] == 0x20) & (inside[:-1] != 0x20))
            if len(last):
                hi = lo + 1 + int(last[-1])
        yield data[lo:hi]
        lo = hi


def _part(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of texts laid end to end, the number of ids of each, and of these the bytes that no piece covers."""
    starts = _borders(data, offsets, model.whole)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    if len(starts) == 1:
        ids, n, raw = model.viterbi(data, starts, ends)
        text = np.searchsorted(offsets, starts, "right") - 1
        return ids, np.bincount(text, weights=n, minlength=len(offsets) - 1).astype(np.int64), np.bincount(text, weights=raw, minlength=len(offsets) - 1).astype(np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    which, sample = distinct(hashes(data, starts, ends))
    ids, count, raw = model.viterbi(data, starts[sample], ends[sample])
    first = np.cumsum(count) - count
    n = count[which]
    stop = np.cumsum(n)
    flat = ids[np.arange(int(n.sum())) - np.repeat(stop - n, n) + np.repeat(first[which], n)]
    return flat, np.bincount(text, weights=n, minlength=len(offsets) - 1).astype(np.int64), np.bincount(text, weights=raw[which], minlength=len(offsets) - 1).astype(np.int64)


def encoded(column: pa.Array, model: Model) -> Iterator[tuple[np.ndarray, int]]:
    """For every text its ids, and how many of them are bytes that no piece covers.  Null counts as empty."""
    if not len(column):
        return
    column = pc.replace_substring(column.fill_null(""), MARKER, " ")
    for block in blocks(column, PART_BYTES):
        size = np.diff(block.offsets)
        if len(block) == 1 and len(block.data) > 2 * PART_BYTES:
            parts = list(_cut(block.data, model.whole))
            if model.prefix:
                parts[0] = np.concatenate([np.array([0x20], np.uint8), parts[0]])
            got = [_part(x, np.array([0, len(x)]), model) for x in parts]
            yield np.concatenate([x for x, _, _ in got]), int(sum(raw[0] for _, _, raw in got))
            continue
        add = ((size > 0) & model.prefix).astype(np.int64)
        offsets = block.offsets + np.concatenate([[0], np.cumsum(add)])
        own = np.ones(int(offsets[-1]), bool)  # all bytes but the blanks put before texts
        own[offsets[:-1][add > 0]] = False
        data = np.full(len(own), 0x20, np.uint8)
        data[own] = block.data
        flat, n, raw = _part(data, offsets, model)
        stop = np.cumsum(n)
        for i in range(len(block)):
            yield flat[stop[i] - n[i] : stop[i]], int(raw[i])


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in slices(batches, -1):
            got = list(encoded(batch.column(batch.num_columns - 1), model))
            flat = np.concatenate([np.zeros(0, np.int32), *(x for x, _ in got)])
            at = np.cumsum([0, *(len(x) for x, _ in got)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array([x for _, x in got], pa.int64())],
                [*batch.schema.names[:-1], "ids", "n_fallback"],
            )

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in slices(batches, 1):
            texts = [model.decode(np.array(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64)).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in slices(batches, 1):
            texts = batch.column(1)
            n, fallback, crc, back = [], [], [], []
            for (ids, raw), text in zip(encoded(texts, model), texts, strict=True):
                n.append(len(ids))
                fallback.append(raw)
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                back.append(model.decode(ids) == (text.as_py() or "").replace(MARKER, " ").encode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fallback, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.bool_())],
                ["doc_id", "n_tokens", "n_fallback", "ids_crc32", "round_trip"],
            )

    return run


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``ids array<int>``, ``n_fallback`` (ids that are bytes of characters
    that no piece covers).  Columns of these names in ``docs`` give way.

    Null and empty texts have no ids.  Rows are encoded one by one, so repeated rows and null ids have no effect; an
    empty table gives none.  Texts may be of any length, with blanks or without, up to what an Arrow value holds.
    ``model`` is a path that every executor has.
    """
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text_col, "ids", "n_fallback")]
    row = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")] if rest else []
    rows = docs.select(*row, F.col(f"`{text_col}`").alias("text"))
    schema = rows.drop("text").schema.add("ids", ArrayType(IntegerType())).add("n_fallback", LongType())
    return rows.mapInArrow(_encode(model), schema).select(*["row.*"] * bool(rest), "ids", "n_fallback")


def decode(ids: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of encoded rows; a marker within an original text comes back as a blank, invalid byte pieces as
    U+FFFD.  Null ids give an empty text."""
    bounded_batches(ids.sparkSession)
    ids = ids.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return ids.mapInArrow(_decode(model), f"doc_id {dict(ids.dtypes)['doc_id']}, text string")


def digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes the ids: ``doc_id, n_tokens, n_fallback, ids_crc32, round_trip`` (the checksum of
    the ids as little-endian 32-bit numbers; whether decoding gives the text back, blanks for markers)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_digest(model), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_fallback long, ids_crc32 long, round_trip boolean")
