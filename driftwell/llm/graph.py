"""Connected components of an edge table: forests within tasks, then alternating star contraction."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Links that one task contracts to a forest (about 100 bytes each); with more, rounds over all tasks finish the work.
LOCAL_LINKS = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from each node to the smallest that the links of this task reach from it."""
    boss: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (up := boss.get(root, root)) != root:
            root = up
        while (up := boss.get(x, x)) != root:
            boss[x], x = root, up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = top(a), top(b)
            if p != q:
                boss[max(p, q)] = min(p, q)
    nodes = np.fromiter(boss, np.int64, len(boss))
    roots = np.array([top(int(x)) for x in nodes], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != roots]), pa.array(roots[nodes != roots])], ["a", "b"])


def _ends(edges: DataFrame) -> DataFrame:
    ends = edges.groupBy("a").agg(F.min("b").alias("b"))
    return ends.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        ends.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """``(a, b)`` links between ids -> ``(node, component)``, the smallest id that links reach.

    Tasks contract ``local_links`` links or so each to a forest, again and again while that leaves at most half of the
    links, until one task holds them all.  Where it does not come to that, rounds over all tasks follow: each replaces the links of every node by links to its smallest neighbour, first upwards, then downwards, so the rows
    never outnumber the links and the rounds grow with the logarithm of the largest component; they end when a round
    changes nothing.  Self links and nulls are ignored; an empty table gives an empty one.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges, "links")
    count, before = edges.count(), math.inf
    while count > local_links and count <= before / 2:
        edges = written(edges.repartition(math.ceil(count / local_links)).mapInArrow(_forest, "a long, b long"), "links")
        count, before = edges.count(), count
    if count <= local_links:
        return _ends(edges.coalesce(1).mapInArrow(_forest, "a long, b long"))
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = written(small, "links")
        before, state = state, _state(edges)
        if state == before:
            break
    return _ends(edges)
