"""Line-first cleaning: rules per line, failing lines go, and documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from .shared import bounded_batches, slices
from .words import SPACES, blocks, distinct, words_of

#: What counts as a symbol, and the base limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words
#: A line ends with one of these, blanks aside.
ENDINGS = ".!?:;…\"'”’»)]"
#: Or with a sentence end, colon or closing mark of another script.
MORE_ENDINGS = "".join(chr(c) for a, b in (
    (0x037E, 0x037E), (0x0589, 0x0589), (0x061B, 0x061B), (0x061D, 0x061F), (0x06D4, 0x06D4), (0x0700, 0x0702), (0x07F9, 0x07F9), (0x0837, 0x0837), (0x0839, 0x0839), (0x083D, 0x083E),
    (0x0964, 0x0965), (0x0F0D, 0x0F0E), (0x104A, 0x104B), (0x1362, 0x1362), (0x1364, 0x1368), (0x166E, 0x166E), (0x1735, 0x1736), (0x17D4, 0x17D6), (0x1803, 0x1804), (0x1809, 0x1809),
    (0x1944, 0x1945), (0x1AA8, 0x1AAB), (0x1B5A, 0x1B5B), (0x1B5E, 0x1B5F), (0x1B7D, 0x1B7F), (0x1C3B, 0x1C3C), (0x1C7E, 0x1C7F), (0x203C, 0x203D), (0x2047, 0x2049), (0x2CF9, 0x2CFB),
    (0x2E2E, 0x2E2E), (0x2E3C, 0x2E3C), (0x2E53, 0x2E54), (0x3002, 0x3002), (0xA4FF, 0xA4FF), (0xA60E, 0xA60F), (0xA6F3, 0xA6F7), (0xA876, 0xA877), (0xA8CE, 0xA8CF), (0xA92F, 0xA92F),
    (0xA9C8, 0xA9C9), (0xAA5D, 0xAA5F), (0xAAF0, 0xAAF1), (0xABEB, 0xABEB), (0xFE12, 0xFE16), (0xFE52, 0xFE52), (0xFE54, 0xFE57), (0xFF01, 0xFF01), (0xFF0E, 0xFF0E), (0xFF1A, 0xFF1B),
    (0xFF1F, 0xFF1F), (0xFF61, 0xFF61), (0x10A56, 0x10A57), (0x10F55, 0x10F59), (0x10F86, 0x10F89), (0x11047, 0x11048), (0x110BE, 0x110C1), (0x11141, 0x11143), (0x111C5, 0x111C6),
    (0x111CD, 0x111CD), (0x111DE, 0x111DF), (0x11238, 0x11239), (0x1123B, 0x1123C), (0x112A9, 0x112A9), (0x1144B, 0x1144C), (0x115C2, 0x115C3), (0x115C9, 0x115D7), (0x11641, 0x11642),
    (0x1173C, 0x1173E), (0x11944, 0x11944), (0x11946, 0x11946), (0x11A42, 0x11A43), (0x11A9B, 0x11A9C), (0x11C41, 0x11C42), (0x11EF7, 0x11EF8), (0x16A6E, 0x16A6F), (0x16AF5, 0x16AF5),
    (0x16B37, 0x16B38), (0x16B44, 0x16B44), (0x16E98, 0x16E98), (0x1BC9F, 0x1BC9F), (0x1DA88, 0x1DA88),
) for c in range(a, b + 1)) + "‹“‘」』）］｝】》〉〕｣"
#: Menu separators; a line fails with one for every four words or more.
SEPARATORS = "|»›>•·"
WORDS_PER_SEPARATOR = 4
#: A line fails with a symbol for every two words or more, if there are three at least.
WORDS_PER_SYMBOL, LEAST_SYMBOLS = 2, 3
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "cookie polic", "use of cookies", "uses cookies", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "all rights reserved", "click here", "read more", "sign in to", "sign up for", "log in to", "subscribe to", "share this",
    "lorem ipsum", "skip to content", "skip to main content", "back to top",
)
#: Percent of its words that a document may lose.
MOST_LOST = 50

_blanks = "\x20\t\n\x0b\x0c\r"
_separator = re.compile(f"[{re.escape(SEPARATORS)}]")
_symbol = re.compile(f"[{re.escape(SYMBOLS)}]")


def line_fails(line: str, words: int, marks: bool = True, phrases: bool = True) -> bool:
    """Whether a line of ``words`` words breaks the punctuation, navigation or boilerplate rule.

    ``marks`` and ``phrases`` are false where the text is known to hold no symbol or separator, or no phrase.
    """
    if (last := line.rstrip(_blanks)[-1:]) not in ENDINGS and last not in MORE_ENDINGS:
        return True
    if marks:
        if (n := len(_symbol.findall(line))) >= LEAST_SYMBOLS and WORDS_PER_SYMBOL * n >= words:
            return True
        if (n := len(_separator.findall(line))) and WORDS_PER_SEPARATOR * n >= words:
            return True
    if phrases:
        low = line.lower()
        return any(x in low for x in BOILERPLATE)
    return False


def clean(text: str) -> tuple[str, int, int, int]:
    """Text without failing lines; lines removed, words lost, and lines that repeat an earlier one.

    Lines without a word stay.
    """
    low = text.lower()
    marks, phrases = any(c in text for c in SYMBOLS + SEPARATORS), any(x in low for x in BOILERPLATE)
    kept, removed, lost, repeats, seen = [], 0, 0, 0, set()
    for line in text.split("\n"):
        if not line.strip(_blanks):
            kept.append(line)
            continue
        repeats += line in seen
        seen.add(line)
        if line_fails(line, words := len(line.encode().split()), marks, phrases):
            removed += 1
            lost += words
        else:
            kept.append(line)
    return "\n".join(kept), removed, lost, repeats


def repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the number of its words in windows of WINDOW words that occur in it twice or more."""
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    whole = len(hashes) - WINDOW + 1
    covered = np.zeros(len(hashes) + 1, np.int64)
    if whole > 0:
        inside = np.flatnonzero(doc[:whole] == doc[WINDOW - 1 :])
        code = doc[inside].astype(np.uint64)
        for i in range(WINDOW):
            code = code * np.uint64(0x9FB21C651E98DF25) + hashes[inside + i]
        which, seen = distinct(code)
        again = np.zeros(len(hashes), bool)
        again[inside] = np.bincount(which, minlength=len(seen))[which] > 1
        marked = again.copy()
        for i in range(1, WINDOW):
            marked[i:] |= again[:-i]
        np.cumsum(marked, out=covered[1:])
    return covered[first[1:]] - covered[first[:-1]]


_is_symbol = np.zeros(256, bool)
_is_symbol[[ord(c) for c in SYMBOLS]] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lines_removed long, words_lost long"
_COLUMNS = [x.split()[0] for x in FIELDS.split(", ")]


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], list[str]]:
    """The columns of FIELDS for each text, and the texts without failing lines."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for block in blocks(texts):
        words = words_of(block)
        inside = ~SPACES[block.data] & ((block.data & 0xC0) != 0x80)
        for into, got in zip(parts, (words.counts(), _per_text(inside, block.offsets), _per_text(_is_symbol[block.data], block.offsets), repeated_words(words.hash, words.first)), strict=True):
            into.append(got)
    n_words, chars, symbols, repeated = (np.concatenate([np.zeros(0, np.int64), *x]) for x in parts)
    cleaned = [clean(x or "") for x in texts.to_pylist()]
    removed, lost, dups = (np.array([x[i] for x in cleaned], np.int64) for i in (1, 2, 3))
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    kept = ~failed & (100 * lost <= MOST_LOST * n_words)
    values = (n_words, chars, symbols, dups, repeated, failed, kept, removed, lost)
    return dict(zip(_COLUMNS, values, strict=True)), [x[0] for x in cleaned]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        columns, _ = measure(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns.values())], ["doc_id", *columns])


def _run_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``text`` and whatever else: texts without failing lines, and the characters of those that lost lines."""
    for batch in slices(batches, 0):
        columns, texts = measure(batch.column(0))
        lost = columns["lines_removed"] > 0
        texts = [t if v else x for t, v, x in zip(texts, lost, batch.column(0).to_pylist(), strict=True)]
        chars = pa.array([len(t) if v else None for t, v in zip(texts, lost, strict=True)], pa.int64())
        out = [pa.array(texts, batch.schema.field(0).type), *batch.columns[1:], chars]
        yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, "chars"]).filter(pa.array(columns["kept"]))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of every row: ``doc_id`` and FIELDS.

    ``kept`` is false for texts that fail the base rules (fewer than LEAST_WORDS words, or more than MOST_REPEATED
    percent of the words in windows of WINDOW words that occur twice), and for those of which more than MOST_LOST
    percent of the words stand in failing lines.  Null counts as an empty text, which fails.  Rows are judged one by one: repeated rows,
    null ids and other columns have no effect; an empty table gives none.  Texts may be of any length, in one line or many.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_run, f"doc_id {dict(docs.dtypes)['doc_id']}, {FIELDS}")


def cleaned(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows that ``quality`` keeps, all their columns whatever their names, with the failing lines taken out of the
    text; where lines went, a column ``chars_col`` of an integer type is counted anew (of another type it stays).

    Null, empty and blank texts fail and go; texts may be of any length; repeated rows are judged one by one; an empty
    table gives none.
    """
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")) if rest else docs.select(F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(_run_clean, StructType([*rows.schema, StructField("chars", LongType())]))

    def column(field):
        own = F.col(f"row.`{field.name}`")
        if field.name == chars_col and isinstance(field.dataType, IntegralType):
            own = F.coalesce(F.col("chars").cast(field.dataType), own)
        return own.alias(field.name)

    return out.select(*[F.col("text").alias(text_col) if f.name == text_col else column(f) for f in docs.schema])


_WORD = r"[^\x20\x09-\x0D]+"
_like = " or ".join(f"contains(lower(l), '{x}')" for x in BOILERPLATE)
_ends = ", ".join("'" + c.replace("'", "''") + "'" for c in ENDINGS + MORE_ENDINGS)
ORACLE = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), w as (
  select r, generate_subscripts(ws, 1) as i, unnest(ws) as x from (select r, regexp_extract_all(t, '{_WORD}') as ws from d)
), v as (
  select r, i, x, lead(x, 1) over o as x1, lead(x, 2) over o as x2, lead(x, 3) over o as x3, lead(x, 4) over o as x4 from w window o as (partition by r order by i)
), a as (
  select r, i, x4 is not null and count(*) over (partition by r, x, x1, x2, x3, x4) > 1 as again from v
), c as (
  select r, max(again::int) over (partition by r order by i rows between {WINDOW - 1} preceding and current row) as hit from a
), n as (
  select r, sum(hit)::bigint as n_repeat_words from c group by r
), s as (
  select r, generate_subscripts(ls, 1) as i, unnest(ls) as l from (select r, string_split(t, chr(10)) as ls from d)
), k as (
  select r, i, l, len(regexp_extract_all(l, '{_WORD}')) as words, len(regexp_extract_all(l, '[{re.escape(SYMBOLS)}]')) as symbols,
    len(regexp_extract_all(l, '[{re.escape(SEPARATORS)}]')) as seps, right(regexp_replace(l, '[\x20\x09-\x0D]+$', ''), 1) as last
  from s
), f as (
  select *, words > 0 and (last not in ({_ends}) or (symbols >= {LEAST_SYMBOLS} and {WORDS_PER_SYMBOL} * symbols >= words)
    or (seps > 0 and {WORDS_PER_SEPARATOR} * seps >= words) or {_like}) as fails,
    words > 0 and row_number() over (partition by r, l order by i) > 1 as dup
  from k
), g as (
  select r, sum(words)::bigint as n_words, count(*) filter (where dup) as n_dup_lines, count(*) filter (where fails) as lines_removed,
    coalesce(sum(words) filter (where fails), 0)::bigint as words_lost from f group by r
), z as (
  select doc_id, n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    len(regexp_extract_all(t, '[{re.escape(SYMBOLS)}]'))::bigint as n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    lines_removed, words_lost from d join g using (r) left join n using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
  not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words) and 100 * words_lost <= {MOST_LOST} * n_words as kept,
  lines_removed, words_lost
from z
"""
