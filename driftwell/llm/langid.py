"""Language of texts by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A model predicts each letter of a lower-case run of letters, and its end, from the ORDER - 1 characters before it in the
run.  Texts get the language with the lowest cross-entropy per predicted character; texts whose lowest cross-entropy is
above the language's calibrated bound are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, slices, written
from .words import distinct, hash_ranges, mix, runs

ORDER = 4
BEGIN, END = 1, 2
#: The models are fitted on at most so many rows of each language, those with the smallest id hashes, whole texts;
#: the scale of scores and the bounds of rejection on at most so many others.
FIT_ROWS, CALIBRATION_ROWS = 300, 60
#: Share of a language's calibration texts under its bound, and what is added to that cross-entropy.
QUANTILE, MARGIN = 0.99, 0.25
#: Size of the alphabet that unseen characters share.
ALPHABET = 1000
#: Texts are scored in groups of about so many characters.
CHUNK_CHARS = 1 << 18
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """A hash of each row of code points."""
    out = np.full(len(grams), grams.shape[1], np.uint64)
    for i in range(grams.shape[1]):
        out = mix(out + grams[:, i].astype(np.uint64) + np.uint64(1))
    return out


def padded(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of letters the windows of ORDER characters that end at each letter and at the end, and each one's run."""
    n = ends - starts + 1
    stop = np.cumsum(n)
    total = int(stop[-1]) if len(stop) else 0
    run = np.repeat(np.arange(len(starts)), n)
    place = np.arange(total) - np.repeat(stop - n, n)
    out = np.full((total, ORDER), BEGIN, np.int32)
    for back in range(ORDER):
        at = place - back
        inside = at >= 0
        where = starts[run[inside]] + at[inside]
        out[inside, ORDER - 1 - back] = np.where(at[inside] == n[run[inside]] - 1, END, codes[np.minimum(where, len(codes) - 1)]) if len(codes) else END
    return out, run


@dataclass
class Level:
    """Grams of one length: sorted hashes of grams with their discounted probabilities, and of contexts with the weight
    left to the shorter gram; a row of each value array holds one value for each language."""

    grams: np.ndarray
    held: np.ndarray
    contexts: np.ndarray
    left: np.ndarray


@dataclass
class Models:
    languages: list[str]
    levels: list[Level] = field(default_factory=list)
    scale: float = 1.0
    bound: np.ndarray | None = None

    def log_probability(self, windows: np.ndarray) -> np.ndarray:
        """Of the last character of each window, a column for each language."""
        p = np.full((len(windows), len(self.languages)), 1.0 / ALPHABET)
        for k, level in enumerate(self.levels, 1):
            gram = windows[:, ORDER - k :]
            left, held = np.ones_like(p), np.zeros_like(p)
            for keys, values, code, out in ((level.contexts, level.left, gram_hash(gram[:, :-1]), left), (level.grams, level.held, gram_hash(gram), held)):
                at = np.searchsorted(keys, code)
                at[at == len(keys)] = 0
                ok = keys[at] == code if len(keys) else np.zeros(len(code), bool)
                out[ok] = values[at[ok]]
            p = held + left * p
        return np.log(p)


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.9, max(0.1, one / (one + 2 * two))) if one else 0.5


def fit(words) -> Models:
    """Models from a pandas frame of ``lang, word, n`` rows: one set of sorted arrays, a column for each language in code point order.
    No rows give a model of no language."""
    import pandas as pd  # on the driver alone: workers do without its memory

    models = Models(sorted(words["lang"].unique()))
    if not models.languages:
        return models
    tables: list[list] = [[] for _ in range(ORDER)]
    for lang in models.languages:
        mine = words[words["lang"] == lang]
        text = "".join(mine["word"])
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        length = mine["word"].str.len().to_numpy()
        ends = np.cumsum(length)
        windows, run = padded(codes, ends - length, ends)
        names = [f"c{i}" for i in range(ORDER)]
        grams = pd.DataFrame(windows, columns=names).assign(n=mine["n"].to_numpy()[run]).groupby(names, as_index=False)["n"].sum()
        for k in range(ORDER, 0, -1):
            tables[k - 1].append(grams)
            if k > 1:  # a shorter gram counts once for each character seen before it; one that begins a run, as often as it occurs
                names = names[1:]
                begins = grams[names[0]] == BEGIN if k > 2 else np.zeros(len(grams), bool)
                grams = grams.assign(n=np.where(begins, grams["n"], 1)).groupby(names, as_index=False)["n"].sum()
    for tables_of in tables:
        parts = []
        for lang, grams in enumerate(tables_of):
            codes = grams.drop(columns="n").to_numpy()
            n = grams["n"].to_numpy(np.float64)
            d = _discount(n)
            context = gram_hash(codes[:, :-1])
            which, seen = pd.factorize(context)
            total = np.bincount(which, weights=n)
            kinds = np.bincount(which)
            parts.append((gram_hash(codes), np.maximum(n - d, 0) / total[which], seen, d * kinds / total, lang))
        keys, contexts = np.unique(np.concatenate([p[0] for p in parts])), np.unique(np.concatenate([p[2] for p in parts]))
        held, left = np.zeros((len(keys), len(parts))), np.ones((len(contexts), len(parts)))
        for gram, share, seen, rest, lang in parts:
            held[np.searchsorted(keys, gram), lang] = share
            left[np.searchsorted(contexts, seen), lang] = rest
        models.levels.append(Level(keys, held, contexts, left))
    return models


def entropies(texts: list[str | None], models: Models) -> np.ndarray:
    """Cross-entropy per predicted character of each text and language; NaN for texts without a letter."""
    out = np.full((len(texts), len(models.languages)), np.nan)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < CHUNK_CHARS):
            size += len(texts[hi] or "")
            hi += 1
        low = [(t or "").lower() for t in texts[lo:hi]]
        codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
        offsets = np.cumsum([0, *map(len, low)])
        starts, ends = runs(letters()[codes], offsets)
        which, first = distinct(hash_ranges(mix(codes.astype(np.uint64) + np.uint64(1)), starts, ends))
        windows, run = padded(codes.astype(np.int64), starts[first], ends[first])
        kind, sample = distinct(gram_hash(windows))
        logs = models.log_probability(windows[sample])
        text = np.searchsorted(offsets, starts, "right") - 1
        n = np.bincount(text, weights=(ends - starts + 1), minlength=hi - lo)
        some = n > 0
        for lang in range(len(models.languages)):
            by_word = np.bincount(run, weights=logs[kind, lang], minlength=len(first))
            total = np.bincount(text, weights=by_word[which], minlength=hi - lo)
            out[lo:hi][some, lang] = -total[some] / n[some]
        lo = hi
    return out


def _softmax(h: np.ndarray, scale: float) -> np.ndarray:
    x = -scale * (h - h.min(axis=1, keepdims=True))
    e = np.exp(x)
    return e / e.sum(axis=1, keepdims=True)


def calibrate(models: Models, h: np.ndarray, lang: np.ndarray) -> None:
    """Sets the scale of scores (the likeliest of a grid) and each language's bound from texts of known language."""
    known = ~np.isnan(h).any(axis=1)
    h, lang = h[known], lang[known]
    models.bound = np.full(len(models.languages), np.inf)
    if not len(h):
        return
    grid = [2.0**i for i in range(-1, 7)]
    models.scale = max(grid, key=lambda s: (np.log(np.maximum(_softmax(h, s)[np.arange(len(h)), lang], 1e-12)).sum(), -s))
    for k in range(len(models.languages)):
        own = h[lang == k, k]
        if len(own):
            models.bound[k] = np.quantile(own, QUANTILE) + MARGIN


def _entropy_rows(models: Models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            h = entropies(batch.column(1).to_pylist(), models)
            at = np.arange(len(h) + 1, dtype=np.int32) * len(models.languages)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(h.ravel()))], ["lang", "h"])

    return run


def _predict(models: Models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = batch.column(2).to_pylist()
            names, scores, refused = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if models.languages:
                h = entropies(texts, models)
                for i in np.flatnonzero(~np.isnan(h[:, 0])):
                    best = int(h[i].argmin())
                    names[i], scores[i], refused[i] = models.languages[best], _softmax(h[i : i + 1], models.scale)[0, best], h[i, best] > models.bound[best]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), pa.array(refused)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> Models:
    """Fits and calibrates the models on labelled rows that are not held out.

    Each language gives its distinct rows (id and text) with the smallest hashes, FIT_ROWS for the models and
    CALIBRATION_ROWS more (a fifth of them, where a language has fewer than both); repeated rows count once, so that
    they cannot make the sample larger.  What comes to the driver are the distinct words of these rows and a few numbers
    for each calibration row and language, whatever the size of the table.  Languages whose sample holds no letter are
    not learned; where none is, every text is ``und``.
    """
    doc = F.col(id_col)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(doc))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(doc.cast("string"), F.col(text_col)).alias("h"))
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return Models([])
    want = FIT_ROWS + CALIBRATION_ROWS
    # twice the rows wanted, by hash: no more than these is sorted
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * want / n))]), F.col("lang"))
    few = rows.where((F.col("h") / F.lit(2.0**64) + 0.5) <= share)
    chosen: dict[str, list[int]] = {}
    for r in few.select("lang", "h").distinct().collect():
        chosen.setdefault(r["lang"], []).append(r["h"])
    cut = []
    for lang, got in chosen.items():
        got.sort()
        got = got[:want]
        fit_rows = min(FIT_ROWS, len(got) - len(got) // 5)
        cut.append((lang, got[fit_rows - 1], got[-1]))
    bound = lambda i: F.element_at(F.create_map(*[F.lit(x) for c in cut for x in (c[0], c[i])]), F.col("lang"))
    if not cut:
        return Models([])
    sample = few.where(F.col("h") <= bound(2)).dropDuplicates(["lang", "h"])
    sample = written(sample.select("lang", "text", (F.col("h") <= bound(1)).alias("fit")), "sample")
    words = sample.where("fit").select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    models = fit(words.groupBy("lang", "word").agg(F.count("*").alias("n")).toPandas())
    if not models.languages:
        return models
    got = sample.where("not fit").select("lang", "text").mapInArrow(_entropy_rows(models), "lang string, h array<double>").collect()
    got = [r for r in got if r["lang"] in models.languages]
    h = np.array([r["h"] for r in got]).reshape(len(got), len(models.languages))
    calibrate(models, h, np.array([models.languages.index(r["lang"]) for r in got], np.int64))
    return models


def identify(docs: DataFrame, models: Models | None = None, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row.

    ``lang_pred`` is a learned language, or ``und`` for texts that are null or have no letter (and where nothing could be
    learned); of equal cross-entropies the first language by code point.  ``score`` is the language's share among all, 0
    for ``und``; ``rejected`` marks texts like none of the languages.  Predictions see the text alone.  Repeated rows and
    null ids are treated as any other; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    models = models or train(docs, id_col, lang_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(models), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean")
