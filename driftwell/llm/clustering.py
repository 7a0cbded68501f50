"""Centroid clustering in exact integers: float32 products screen the centroids, exact distances decide near ties."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, remove, trimmed, written

#: Components of a vector, centroids, rounds, factor of the integers and seed of the first centroids.
DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Integers of a component stay below this, so that squared distances fit into a long.
LARGEST = 1 << 27
#: Vectors compared at a time.
ROWS = 4096


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, q``: components as integers ``floor(scale * x)``, of vectors with ``dim`` components, none null or not
    finite; others are left out."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & finite)
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def _hashed(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number) and the squared distance, both exact.

    ``|c|**2 - 2 x.c`` orders the centroids of a row.  The products are float32; whatever their order of summation, the
    product of ``d`` components is off by at most ``(d + 3) * 2**-24`` times the lengths of the two vectors, rounding of
    the components included.  Centroids whose intervals reach into that of the best one are compared in integers.
    """
    dim = q.shape[1]
    x, c = q.astype(np.float64), centroids.astype(np.float64)
    length, norm = np.sqrt((x * x).sum(axis=1)), (c * c).sum(axis=1)
    product = (q.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    middle = norm[None, :] - 2 * product
    # Twice the bound of a product, its growth by higher orders, and the rounding of the float64 sums above.
    off = 2 * 1.001 * (dim + 3) * 2.0**-24 * length[:, None] * np.sqrt(norm)[None, :] + (norm[None, :] + np.abs(product)) * (dim + 8) * 2.0**-52
    open_ = middle - off <= (middle + off).min(axis=1)[:, None]
    label = open_.argmax(axis=1)
    several = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(several):
        row, which = np.nonzero(open_[several])
        distance = np.full((len(several), len(centroids)), np.iinfo(np.int64).max)
        apart = q[several[row]] - centroids[which]
        distance[row, which] = (apart * apart).sum(axis=1)
        label[several] = distance.argmin(axis=1)
    apart = q - centroids[label]
    return label, (apart * apart).sum(axis=1)


def _sums(centroids: np.ndarray):
    """Per task and centroid: vectors and sums of their components."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            q = _matrix(batch.column(0), dim)
            for lo in range(0, len(q), ROWS):
                part = q[lo : lo + ROWS]
                label, _ = nearest(part, centroids)
                count += (held := np.bincount(label, minlength=k))
                total[held > 0] += np.add.reduceat(part[np.argsort(label, kind="stable")], (np.cumsum(held) - held)[held > 0], axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])
        trimmed()

    return run


def _labels(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(1), centroids.shape[1])
            parts = [nearest(q[lo : lo + ROWS], centroids) for lo in range(0, len(q), ROWS)]
            label, distance = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])
        trimmed()

    return run


@dataclass
class Clustering:
    """Centroids in whole numbers, in the order of their numbers."""

    centroids: np.ndarray

    def sha256(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in self.centroids]

    def assign(self, vectors: DataFrame) -> DataFrame:
        """``vec_id, cluster, distance`` of every row of ``integer_vectors``; without centroids (no vectors) none."""
        kind = vectors.schema["vec_id"].dataType.simpleString()
        if not len(self.centroids):
            return vectors.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return vectors.select("vec_id", "q").mapInArrow(_labels(self.centroids), f"vec_id {kind}, cluster int, distance long")


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> Clustering:
    """Moves ``k`` centroids for some rounds over all rows of ``integer_vectors``.

    They start as the vectors with the smallest hashes of seed and id (a null id hashes as none; equal ids in the order of
    their components), fewer where there are fewer vectors.  A round assigns every vector to the nearest centroid (ties:
    the smaller number) and moves every centroid that has vectors to the floor of their mean.  A round is one job, of which
    the driver sees ``k`` rows of sums; equal vectors, hot clusters and empty ones need nothing else.  The centroids
    (``k * dim`` numbers, both parameters) travel with the tasks.
    """
    bounded_batches(vectors.sparkSession)
    first = vectors.select(_hashed(seed).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    if not first:
        return Clustering(np.zeros((0, 0), np.int64))
    centroids = np.array([r["q"] for r in first], np.int64)
    dim = centroids.shape[1]
    for _ in range(rounds):
        parts = vectors.select("q").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
        for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dim)]).alias("sums")).collect():
            centroids[row["cluster"]] = np.array(row["sums"], np.int64) // row["n"]
    return Clustering(centroids)


def clustered(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Vectors that are null, have another number of components or one that is null or not finite are left out; repeated rows
    and ids are vectors of their own; an empty table gives none; other columns are not read.  A component of 2**17 or more
    (at a scale of 1024) is an error, as its squared distances would not fit into a long.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    limit = F.when(F.exists("q", lambda x: F.abs(x) >= LARGEST), F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(F.col("q"))
    vectors = written(integer_vectors(df, id_col, vec_col, dim, scale).withColumn("q", limit), "vectors")
    found = fit(vectors, k, rounds, seed)
    labelled = written(found.assign(vectors), "labelled")
    sums = {r["cluster"]: r["inertia"] for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    remove(spark, vectors)
    rows = [(i, sums.get(i), sum(sums.values()), h) for i, h in enumerate(found.sha256())]  # one row per centroid
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labelled.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """Each round as a pair of common table expressions."""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    near = "select vec_id, q, arg_min(n, (d, n)) as n, min(d) as d from (select v.vec_id, v.row, v.q, c.n, {apart} as d from v, c{i} c) group by vec_id, row, q"
    mean = (
        "select c.n, coalesce(m.q, c.q) as q from c{i} c left join (select n, list((s - ((s % m + m) % m)) // m order by j) as q from"
        " (select n, j, sum(x)::bigint as s, count(*) as m from (select n, unnest(q) as x, unnest(range(1, 65)) as j from a{i}) group by n, j) group by n) m using (n)"
    )
    text = [
        "with v as materialized (select vec_id, row_number() over () as row, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as q from embeddings"
        " where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)",
        f"c0 as materialized (select (row_number() over (order by h, q) - 1)::int as n, q from (select sha256('3:' || coalesce(vec_id::varchar, '')) as h, q from v order by h, q limit {k}))",
    ]
    for i in range(rounds + 1):
        text.append(f"a{i} as materialized ({near.format(i=i, apart=apart)})")
        if i < rounds:
            text.append(f"c{i + 1} as materialized ({mean.format(i=i)})")
    return ", ".join(text) + (
        f" select vec_id, n as cluster, d::bigint as distance, (sum(d) over (partition by n))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,"
        f" sha256(array_to_string(list_transform(c.q, lambda x: x::varchar), ',')) as centroid_sha256 from a{rounds} join c{rounds} c using (n)"
    )


ORACLE = _oracle()
