"""Jaccard self-join of documents on word n-grams: size-banded tiles, hashed bitmaps, exact intersections.

Two sets of sizes p and q with Jaccard similarity of t or more differ in at most ``(1 - t) / (1 + t) * (p + q)``
elements.  Documents are put into bands by set size (each band 1.5 times the one before; a document also enters the
bands up to that of the largest set it may link with, so any two that may link share a band).  In a band whose sets may differ in d elements the
hash space is cut into ``d + 1 + spare`` slices: of two linked sets at least ``1 + spare`` slices hold the same
elements.  A *tile* is (band, slice, digest of the slice's elements), and every link joins two documents of one tile.
Slices that hold nothing, or only n-grams that are common in the corpus, would gather unrelated documents; a set leaves
them out while it has at most ``spare`` of them, which leaves at least one other slice in common.  Common n-grams are
those in overfull buckets of a table of fixed size, into which all n-grams of all documents are counted by hash; it
decides which tiles are made, never which documents link.  What is left of a set's ``spare`` in a band it spends on its
largest tiles there: all sets rank tiles alike, so the tiles that two sets leave out of those they share are the
``spare`` largest of them at most, and the smallest stays.

Work inside tiles is linear in their rows.  First each document of a tile is held against the one before it: parity
bitmaps bound the difference from below (each differing element flips one bit at most), and pairs that pass are
held against each other by longer bitmaps, then checked by intersecting the sorted hash arrays.  Then the documents that tiles connect, a family, are compared block by
block, each with its closest partners.  Only tiles whose documents are after that still in different components are
compared in full, in blocks of bounded size, and only across components; tiles that overlap are taken together as one
where that moves fewer rows.  Copies with equal sets are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .graph import components
from .shared import bounded_batches, new_path, remove, scratch, slices, written
from .words import blocks, mix, shingles, words_of

BAND = 1.5
#: Slices beyond those needed: two, and one for so many others.
SLICES_PER_SPARE = 6
#: Lowest bits of a tile's key: its band, and whether its slice holds common n-grams alone or nothing.
BAND_BITS, VOID = 63, 64
#: Buckets of the table of counts; those above the median by so many times its square root are common.
BUCKETS, BUCKET_CHUNK = 1 << 17, 1024
OVERFULL = 6
_PLACE = np.uint64(0xA0761D6478BD642F)
#: 64-bit lanes of a parity bitmap, at least; doubled until it has two bits for each element, or so many in the longer
#: one that decides which pairs are checked.
LANES, FINE = 16, 8
#: Documents of a typical block; two blocks are compared at a time, so many block pairs in a group of rows, so many
#: pairs of rows in a step.
BLOCK_ROWS, GROUP_PAIRS, PAIR_ROWS = 256, 64, 1 << 17
#: Bytes of bitmaps of a block, so that a group takes tens of megabytes at most, however long texts are.
BLOCK_BYTES = 1 << 18
#: Partners of a document that the first comparison within families proposes.
NEAREST = 3
#: Ids that may be broadcast (8 bytes each); beyond, the tables are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of bitmaps or arrays that may be broadcast.
BROADCAST_BYTES = 96 << 20


@lru_cache(None)
def band_of(n: int) -> int:
    band = int(np.log(max(n, 1)) / np.log(BAND))
    while BAND ** (band + 1) <= n:
        band += 1
    while BAND**band > n:
        band -= 1
    return band


@lru_cache(None)
def slices_in(band: int, num: int, den: int) -> tuple[int, int]:
    """Slices of a band, and how many of them are spare; no slices where sets that are not equal cannot link."""
    top = int(np.ceil(BAND ** (band + 1))) - 1
    apart = (den - num) * 2 * top // (den + num)
    spare = 2 + (apart + 1) // SLICES_PER_SPARE
    return (apart + 1 + spare, spare) if apart else (0, 0)


@lru_cache(None)
def _cuts(band: int, num: int, den: int) -> np.ndarray:
    """Lower bounds of the slices of a band but the first."""
    k, _ = slices_in(band, num, den)
    return np.array([(i << 64) // k for i in range(1, k)], np.uint64)


def tile_keys(values: np.ndarray, num: int, den: int, common: np.ndarray | None = None) -> np.ndarray:
    """The tiles of a set, given its sorted distinct hashes and which buckets are common."""
    return tiles_of(values, num, den, common)[0]


def tiles_of(values: np.ndarray, num: int, den: int, common: np.ndarray | None = None) -> tuple[np.ndarray, list[int]]:
    """The tiles of a set, and by band how many of them it may still leave out."""
    n, keys = len(values), []
    band = band_of(n)
    left = [0] * band
    last = band
    while n * den >= num * BAND ** (last + 1):
        last += 1
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=running[1:])
    rare = np.arange(n + 1)
    if common is not None:
        np.cumsum(~common[(values & np.uint64(BUCKETS - 1)).astype(np.int64)], out=rare[1:])
    for b in range(band, last + 1):
        k, spare = slices_in(b, num, den)
        left.append(spare)
        if not k:
            continue
        at = np.empty(k + 1, np.int64)
        at[0], at[1:-1], at[-1] = 0, np.searchsorted(values, _cuts(b, num, den)), n
        held = at[1:] - at[:-1]
        key = mix(running[at[1:]] - running[at[:-1]] + (np.arange(k, dtype=np.uint64) + np.uint64(b << 32)) * _PLACE + held.astype(np.uint64))
        void = rare[at[1:]] == rare[at[:-1]]
        key = key & ~np.uint64(BAND_BITS | VOID) | void * np.uint64(VOID) | np.uint64(b)
        if void.sum() <= spare:
            left[b] -= int(void.sum())
            key = key[~void]
        keys.append(key)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), left


def parity_bitmap(values: np.ndarray, per: int = 2) -> np.ndarray:
    """A bit for each residue of the mixed hashes, set if an odd number of elements has it; ``per`` bits for each element
    at least."""
    size = 64 * LANES
    while size < per * len(values):
        size *= 2
    odd = np.zeros(size, np.uint8)
    np.bitwise_xor.at(odd, (mix(values) & np.uint64(size - 1)).astype(np.int64), np.uint8(1))
    return np.packbits(odd, bitorder="little").view(np.uint64)


def same_width(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps folded to the shortest of them: residues of half the size are the parities of two halves."""
    width = min(map(len, maps), default=LANES)
    return np.stack([m if len(m) == width else np.bitwise_xor.reduce(m.reshape(-1, width), axis=0) for m in maps]) if maps else np.zeros((0, width), np.uint64)


def sets_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text of a column the sorted distinct hashes of its word n-grams."""
    for block in blocks(column):
        code, doc = shingles(words_of(block, lower=True), size)
        at = np.searchsorted(doc, np.arange(len(block) + 1))
        for i in range(len(block)):
            one = np.sort(code[at[i] : at[i + 1]])
            yield one[np.concatenate([[True], one[1:] != one[:-1]])] if len(one) > 1 else one


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    at = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def _bucket_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                code, _ = shingles(words_of(block, lower=True), size)
                total += np.bincount((code & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        parts = total.reshape(-1, BUCKET_CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([x.tobytes() for x in parts], pa.binary())], ["chunk", "counts"])

    return run


def _add_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(BUCKET_CHUNK, np.int64)
    for x in table.column("counts").to_pylist():
        total += np.frombuffer(x, np.int64)
    return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def common_buckets(docs: DataFrame, size: int) -> np.ndarray:
    """Which buckets of n-gram hashes are overfull; what comes to the driver is a table of BUCKETS numbers."""
    parts = docs.select("text").mapInArrow(_bucket_counts(size), "chunk long, counts binary").groupBy("chunk").applyInArrow(_add_counts, "chunk long, counts binary")
    total = np.zeros((BUCKETS // BUCKET_CHUNK, BUCKET_CHUNK), np.int64)
    for r in parts.collect():
        total[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    middle = float(np.median(total))
    return total.ravel() > middle + OVERFULL * max(1.0, middle**0.5)


def _signatures(size: int, num: int, den: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            count, d0, d1, keys, left = [], [], [], [], []
            for one in sets_of(batch.column(1), size):
                count.append(len(one))
                d0.append(one.sum(dtype=np.uint64))
                d1.append((one * one).sum(dtype=np.uint64))
                own = tiles_of(one, num, den, common) if len(one) else (one, [])
                keys.append(own[0])
                left.append(own[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (d0, d1)), _lists(keys), pa.array(left, pa.list_(pa.int32()))],
                ["doc_id", "n_shingles", "d0", "d1", "keys", "spare"],
            )

    return run


def _arrays(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = list(sets_of(batch.column(1), size))
            maps = [[parity_bitmap(x, per).tobytes() for x in sets] for per in (2, FINE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in maps), pa.array([x.tobytes() for x in sets], pa.binary())],
                ["doc_id", "n", "bits", "fine", "hashes"],
            )

    return run


def alike(p: np.ndarray, q: np.ndarray, num: int, den: int) -> bool:
    """``den * |p & q| >= num * |p | q|`` for sorted distinct arrays."""
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    common = int((q[at] == p).sum()) if len(q) else 0
    return den * common >= num * (len(p) + len(q) - common)


def may_link(n: np.ndarray, bits: np.ndarray, m: int, other: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the sets (sizes ``n``, bitmaps ``bits``) a set of size ``m`` can be alike: the overlap is at most
    half of what the sizes leave after the bits in which the bitmaps differ."""
    apart = np.bitwise_count(bits ^ other).sum(axis=1, dtype=np.int64)
    most = np.minimum((n + m - apart) // 2, np.minimum(n, m))
    return den * most >= num * (n + m - most)


def _bound(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, 5):
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            p, q = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (3, 5))
            good = np.zeros(len(n), bool)
            width = np.minimum([len(x) for x in p], [len(x) for x in q])
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                left, right = (np.stack([np.bitwise_xor.reduce(x[i].reshape(-1, w), axis=0) for i in rows]) for x in (p, q))
                good[rows] = may_link(n[rows], left, m[rows], right, num, den)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 3):
            good = [
                alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), num, den)
                for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def most_apart(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most elements in which sets of sizes ``n`` and ``m`` may differ and still link; -1 where they cannot."""
    need = -(-num * (n + m) // (num + den))
    return np.where(np.minimum(n, m) >= need, n + m - 2 * need, -1)


def across(component: np.ndarray, side: np.ndarray, n: np.ndarray, bits: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of a block pair, in different components, that the bitmaps let link, and the bits in which they
    differ; with two sides, only pairs of one row from each.

    Bits that differ are counted a few lanes at a time, and a pair whose count is beyond its bound is not followed on.
    """
    two = side.any() and not side.all()
    lanes = np.ascontiguousarray(bits.T)
    step = max(1, PAIR_ROWS // len(n))
    for lo in range(0, len(n), step):
        own = slice(lo, lo + step)
        limit = most_apart(n[own, None], n, num, den)
        ok = (component[own, None] < component) & (limit >= 0)
        if two:
            ok &= side[own, None] != side
        i, j = np.nonzero(ok)
        limit, i = limit[i, j], i + lo
        apart = np.zeros(len(i), np.int64)
        for at in range(0, len(lanes), 4):
            for lane in lanes[at : at + 4]:
                apart += np.bitwise_count(lane[i] ^ lane[j])
            near = apart <= limit
            if not near.all():
                i, j, apart, limit = i[near], j[near], apart[near], limit[near]
            if not len(i):
                break
        yield i, j, apart


def nearest(i: np.ndarray, j: np.ndarray, apart: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs those that are among the ``keep`` closest of one of their rows."""
    row, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort([np.tile(apart, 2), row])
    row, pair = row[order], pair[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    chosen = np.unique(pair[place < keep])
    return i[chosen], j[chosen]


def _across(num: int, den: int, keep: int | None = None):
    """Compares many block pairs: the rows of each stand under one (key, p, q).  With ``keep`` a row gives its closest
    partners alone."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, p, q, ids, component, side, n = (table.column(k).to_numpy() for k in ("key", "p", "q", "doc_id", "component", "side", "n"))
        bits = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()]
        order = np.lexsort([q, p, key])
        change = np.flatnonzero(np.diff(key[order]).astype(bool) | np.diff(p[order]).astype(bool) | np.diff(q[order]).astype(bool)) + 1
        found = [np.zeros((0, 2), np.int64)]
        for rows in np.split(order, change):
            got = list(across(component[rows], side[rows], n[rows], same_width([bits[r] for r in rows]), num, den))
            i, j, apart = (np.concatenate(x) for x in zip(*got, strict=True))
            if len(i):
                i, j = (i, j) if keep is None else nearest(i, j, apart, keep)
                found.append(np.sort(np.stack([ids[rows[i]], ids[rows[j]]], axis=1), axis=1))
        out = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

    return run


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``: broadcast while the ids are few (counted first), else by a shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _sides(pairs: DataFrame, arrays: DataFrame, *cols: str) -> DataFrame:
    """Pairs with columns of ``arrays`` for both ids; only the rows that pairs name are moved.

    Their bytes are counted first: up to BROADCAST_BYTES they are broadcast, beyond they are joined by shuffles.
    """
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "named")
    named = written(_texts_of(arrays, ids).select("doc_id", *cols), "rows")
    size = named.agg(F.coalesce(F.sum(sum((F.octet_length(c) if t == "binary" else F.lit(8) for c, t in named.dtypes), F.lit(32))), F.lit(0))).first()[0]
    named = F.broadcast(named) if size <= BROADCAST_BYTES else named
    side = lambda k: named.select(F.col("doc_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in cols))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{c}_{k}" for k in "ab" for c in cols))


def _verified(pairs: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose exact similarity is high enough; only those that the longer bitmaps let link move their hashes."""
    pairs = written(pairs, "bounded")
    pairs = written(_sides(pairs, arrays, "n", "fine").mapInArrow(_bound(num, den), "a long, b long"), "close")
    return written(_sides(pairs, arrays, "hashes").mapInArrow(_verify(num, den), "a long, b long"), "verified")


def ngram_classes(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of ``num / den`` or more of their n-gram sets.

    Returns ``doc_id, n_shingles, component_id`` for every row of ``docs``; ``component_id`` is the smallest id that
    links reach, the row's own included.  A-Z count as a-z; a text of fewer than ``words`` words is one n-gram of all
    of them.  Rows with null, empty or blank texts have 0 n-grams and link with nothing.  Rows that share an id are one
    document; a row without an id is linked only through rows of an equal set.  Ids are integers (of other types it is an
    error).  Texts may be of any length; other columns are not read; an empty table gives none.
    """
    with scratch(docs.sparkSession):
        out = _classes(docs, words, num, den, id_col, text_col)
        path = new_path(docs.sparkSession, "classes")
        out.write.parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def _classes(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    if (kind := dict(docs.dtypes)[id_col]) not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids are integers, not {kind}")
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    common = common_buckets(docs, words)
    made = written(docs.mapInArrow(_signatures(words, num, den, common), "doc_id long, n_shingles long, d0 long, d1 long, keys array<long>, spare array<int>"), "sets")
    base = written(made.drop("keys", "spare"), "bases")
    full = base.where("n_shingles > 0")
    same = full.groupBy("d0", "d1", "n_shingles").agg(F.min("doc_id").alias("node"))

    first_ids = written(same.where("node is not null").select(F.col("node").alias("doc_id")).distinct(), "nodes")
    nodes = _texts_of(made.where("size(keys) > 0").select("doc_id", "keys", "spare"), first_ids)
    shared = written(_smallest(nodes), "shared")
    remove(spark, made)
    tile = Window.partitionBy("key").orderBy("doc_id")
    rows = shared.select(
        "key", "doc_id", F.lag("doc_id").over(tile).alias("before"), F.lead("doc_id").over(tile).alias("after"),
        F.lag("doc_id", 2).over(tile).alias("before2"), F.lead("doc_id", 2).over(tile).alias("after2"),
    ).where("before is not null or after is not null")
    rows = written(rows.select("key", "doc_id", "before", F.expr("before is not null and after is not null or before2 is not null or after2 is not null").alias("many")), "tiles")

    remove(spark, shared)
    pairs = rows.where("before <> doc_id").select(F.col("before").alias("a"), F.col("doc_id").alias("b")).distinct()
    tested = written(pairs, "pairs")
    ids = written(rows.select("doc_id").distinct(), "candidates")
    arrays = written(_texts_of(docs, ids).mapInArrow(_arrays(words), "doc_id long, n long, bits binary, fine binary, hashes binary"), "arrays")
    bounded = _sides(tested, arrays, "n", "bits").mapInArrow(_bound(num, den), "a long, b long")
    links = _verified(bounded, arrays, num, den)
    found = written(components(links), "components")
    family = written(components(tested).withColumnRenamed("component", "family"), "family")
    for step in (_neighbours, _open_tiles):
        more = _verified(step(rows, family, found, arrays, num, den), arrays, num, den)
        if more.head(1):
            links = links.unionByName(more)
            found = written(components(links), "components")
    classes = same.join(found.withColumnRenamed("component", "c"), same["node"] == found["node"], "left").select("d0", "d1", "n_shingles", F.coalesce("c", same["node"]).alias("component_id"))
    return base.join(classes, ["d0", "d1", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _smallest(nodes: DataFrame) -> DataFrame:
    """``key, doc_id`` of the tiles that several rows of ``doc_id, keys, spare`` hold, without the largest that a set may
    leave out; sets that share an id leave none out."""
    held = nodes.select("doc_id", F.explode("keys").alias("key")).select("key", "doc_id", F.count("*").over(Window.partitionBy("key")).alias("held"))
    held = written(held.where("held > 1"), "held")
    spare = nodes.groupBy("doc_id").agg(F.when(F.count("*") == 1, F.first("spare")).alias("spare"))
    band = F.col("key").bitwiseAND(F.lit(BAND_BITS).cast("long")).cast("int")
    largest = Window.partitionBy("doc_id", "band").orderBy(F.col("key").bitwiseAND(F.lit(VOID).cast("long")).desc(), F.desc("held"), F.desc("key"))
    placed = held.join(spare, "doc_id").withColumn("band", band).withColumn("place", F.row_number().over(largest))
    return placed.where(F.col("place") > F.coalesce(F.get("spare", F.col("band")), F.lit(0))).select("key", "doc_id")


def _in_families(family: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, family, component`` of every candidate."""
    nodes = family.join(found, "node", "left")
    return written(nodes.select(F.col("node").alias("doc_id"), "family", F.coalesce("component", "node").alias("component")), "families")


def _compared(work: DataFrame, groups: int, num: int, den: int, keep: int | None = None) -> DataFrame:
    """Candidate pairs of rows ``key, p, q, doc_id, component, side, n, bits``, many block pairs in a group."""
    work = work.withColumn("group", F.pmod(F.xxhash64("key", "p", "q"), F.lit(groups)))
    return work.groupBy("group").applyInArrow(_across(num, den, keep), "a long, b long").distinct()


def _in_blocks(held: DataFrame, arrays: DataFrame, name: str, order: WindowSpec, rows: int = BLOCK_BYTES) -> DataFrame:
    """Rows with the block that they are in along an order, of BLOCK_BYTES of bitmaps or so and ``rows`` rows at most."""
    size = F.greatest(F.lit(8.0 * LANES), F.lit(float(BLOCK_BYTES // rows)), F.pow(2.0, F.ceil(F.log2(F.col("n") * 2.0))) / 8)
    sized = held.join(arrays.select("doc_id", size.cast("long").alias("size")), "doc_id")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn(name, F.floor((upto - F.col("size")) / BLOCK_BYTES).cast("int")).drop("size")


def _neighbours(rows: DataFrame, family: DataFrame, found: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that join most of a family of many components, from a number of rows that does not outgrow its documents.

    The documents of a family stand in the order of their least tile, which similar ones share more often than not, and
    each is held against the others of its block; its closest partners in other components are candidates.  What this
    leaves apart the open tiles compare in full.
    """
    nodes = _in_families(family, found)
    several = nodes.groupBy("family").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("family")
    held = nodes.join(several, "family", "left_semi").join(rows.groupBy("doc_id").agg(F.min("key").alias("least")), "doc_id")
    order = Window.partitionBy("family").orderBy("least", "doc_id")
    held = written(_in_blocks(held, arrays, "p", order, BLOCK_ROWS), "blocks")
    groups = math.ceil(held.count() / (GROUP_PAIRS * 16)) or 1
    work = held.select(F.xxhash64("family").alias("key"), "p", F.col("p").alias("q"), "doc_id", "component", F.lit(False).alias("side"))
    return _compared(work.join(arrays.select("doc_id", "n", "bits"), "doc_id"), groups, num, den, NEAREST)


def _open_tiles(rows: DataFrame, family: DataFrame, found: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that the first comparison left out and that may link, from tiles of three or more documents in two or more
    components.

    A family is what candidate pairs connect, and holds every tile of its documents.  It is compared as a whole where
    that moves fewer rows (its documents, and the blocks that hold different components) than its open tiles do.
    """
    nodes = _in_families(family, found)
    held = rows.where("many").select("key", "doc_id").join(nodes, "doc_id")
    tiles = held.groupBy("key").agg(
        F.count("*").alias("rows"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("family").alias("family"),
        F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("h0"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("h1"),
    ).where("c0 <> c1")
    tiles = written(tiles.groupBy("rows", "family", "h0", "h1").agg(F.min("key").alias("key")), "open")
    by_tile = tiles.groupBy("family").agg(F.sum("rows").alias("by_tile"))
    sizes = nodes.groupBy("family", "component").agg(F.count("*").cast("double").alias("n")).groupBy("family").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"))
    whole = sizes.join(by_tile, "family").where(F.col("n") + (F.col("n") * F.col("n") - F.col("q")) / BLOCK_ROWS <= F.col("by_tile")).select("family")
    at_once = nodes.join(whole, "family", "left_semi").select(F.xxhash64("family").alias("key"), "doc_id", "component")
    in_tiles = held.join(tiles.join(whole, "family", "left_anti").select("key"), "key", "left_semi").select("key", "doc_id", "component")
    held = at_once.unionByName(in_tiles)
    order = Window.partitionBy("key").orderBy("component", "doc_id")
    members = written(_in_blocks(held, arrays, "part", order), "members")
    parts = members.groupBy("key", "part").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    other = parts.select("key", F.col("part").alias("part2"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    duels = written(parts.join(other, "key").where("part <= part2 and not (c0 = c1 and d0 = d1 and c0 = d0)").select("key", "part", "part2"), "duels")
    groups = math.ceil(duels.count() / GROUP_PAIRS) or 1
    seats = duels.select("key", F.struct("part", "part2").alias("duel"), F.explode(F.array_distinct(F.array("part", "part2"))).alias("part"))
    work = members.join(seats, ["key", "part"]).select("key", "duel", "doc_id", "component", (F.col("part") > F.col("duel.part")).alias("side"))
    work = work.join(arrays.select("doc_id", "n", "bits"), "doc_id").select("key", F.col("duel.part").alias("p"), F.col("duel.part2").alias("q"), "doc_id", "component", "side", "n", "bits")
    return _compared(work, groups, num, den)
