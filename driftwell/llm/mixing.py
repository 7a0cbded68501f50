"""Mixing sources to target weights by systematic sampling.

Sources are few: their weights and targets are worked out in one task, a row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: A source gives at most so many times its own size.
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
#: Hash buckets within a source and size class.
BUCKETS = 32
#: Ids that may be broadcast (some 40 bytes each); beyond, rows are looked up by a shuffle.
BROADCAST_ROWS = 500_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Runs of characters other than U+0020 and U+0009 to U+000D; null: none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def size_class(size: Column) -> Column:
    """Four classes for each power of two, in the order of sizes."""
    binary = F.bin(size)
    bit = lambda i: F.when(F.substring(binary, i, 1) == "1", 1).otherwise(0)
    return F.length(binary) * 4 + bit(2) * 2 + bit(3)


def _uniform(key: Column) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), key)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source_key, source, size`` rows -> ``source_key, source_size, target, rate, offset``, one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; no target exceeds
    ``most`` times its source's size.  A source is capped if even the share left when all sources with a smaller
    size per weight are capped would exceed its cap; the others share the rest by weight.
    """
    by_source = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source_size") * F.lit(1.0) / F.col("weight"), "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * most
    rest = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double")
    capped = weighed.withColumn("capped", cap * F.sum("weight").over(after) < F.col("weight") * rest)
    over = lambda x, flag: F.coalesce(F.sum(F.when(flag, x)).over(everything), F.lit(0))
    share = (F.sum("source_size").over(everything) - over(cap, F.col("capped"))).cast("double") / over(F.col("weight"), ~F.col("capped"))
    out = capped.withColumn("target", F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * share))
    return out.select(
        "source_key", "source_size", "target", _uniform(F.col("source_key")).alias("offset"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source), F.lit("null"))


def _ranked(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``doc_id, source_key, size, source_size, target, copies`` of every row."""
    source = F.col(source_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), _source_key(source).alias("source_key"), source.alias("source"), word_count(F.col(text_col)).alias("size"))
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long") % BUCKETS
    sized = written(sized.withColumn("class", size_class(F.col("size"))).withColumn("bucket", bucket), "sizes")
    cell = ["source_key", "class", "bucket"]
    fine = sized.groupBy(*cell, "size").agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = fine.groupBy(*cell).agg(F.sum("n").alias("n"))
    cells = cells.withColumn("first", before(Window.partitionBy("source_key").orderBy("class", "bucket"))).drop("n").join(source_targets(sized), "source_key")
    fine = fine.withColumn("within", before(Window.partitionBy(*cell).orderBy("size"))).drop("n").join(cells, cell)
    place = F.row_number().over(Window.partitionBy(*cell, "size").orderBy("doc_id"))
    ranked = sized.withColumn("place", place).join(fine, [*cell, "size"])
    ranked = ranked.withColumn("rank", (F.col("first") + F.col("within") + F.col("place")).cast("double"))
    crossed = F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    return ranked.select("doc_id", "source_key", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def sample(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Copies of each row in the mix: ``doc_id, size, source_size, target, copies, taken``.

    A row's expected copies are its source's target by its source's size.  Within a source the rows stand in a fixed
    order, by size class, hash bucket, size and id; the running sum of expected copies plus the source's one offset
    crosses as many integers at a row as the mix takes copies of it.  Equal expected copies make the running sum the
    row's rank times the rate.  Ranks come from counts per (source, class, bucket) and per size within these, so a source
    with a third of all rows is numbered by as many tasks as it has sizes and buckets.  Null texts have size 0, null
    sources are one source, null ids stand first among rows of their size, repeated rows are numbered one by one.  Other
    columns are not read.  An empty table gives none.
    """
    ranked = _ranked(docs, id_col, source_col, text_col)
    return ranked.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Ids, sources and sizes alone are ranked; the rows are then looked up by id and source, through a broadcast while the
    ids taken are few (counted first), else through a shuffle.  Rows that share id and source are told apart by their
    size; those that share this too divide their copies evenly.
    """
    ranked = written(_ranked(docs, id_col, source_col, text_col).select("doc_id", "source_key", "size", "copies"), "ranked")
    key = ["doc_id", "source_key"]
    taken = written(ranked.groupBy(*key).agg(F.count("*").alias("n"), F.sum("copies").alias("copies")), "taken")
    rows = docs.select(F.struct("*").alias("__row"))
    rows = rows.select("__row", F.col(f"__row.{id_col}").alias("__id"), _source_key(F.col(f"__row.{source_col}")).alias("__source"))

    def looked_up(rows: DataFrame, table: DataFrame) -> DataFrame:
        few = table.count() <= BROADCAST_ROWS
        on = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__source") == F.col("source_key"))
        return rows.join(F.broadcast(table) if few else table.hint("shuffle_hash"), on)

    out = looked_up(rows, taken.where("n = 1 and copies > 0")).select("__row", "copies")
    several = taken.where("n > 1 and copies > 0")
    if several.head(1):
        shared = ranked.withColumnRenamed("copies", "c").join(several.select(F.col("doc_id").alias("d"), F.col("source_key").alias("s")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("source_key") == F.col("s")), "left_semi")
        shared = shared.groupBy(*key, "size").agg(F.count("*").alias("n"), F.sum("c").alias("c")).withColumnsRenamed({"doc_id": "d", "source_key": "s", "size": "z"})
        part = looked_up(rows, several.select(*key)).select("__row", *key, word_count(F.col(f"__row.{text_col}")).alias("size"))
        number = F.row_number().over(Window.partitionBy(*key, "size").orderBy(F.crc32(F.coalesce(F.col(f"__row.{text_col}"), F.lit("")).cast("binary"))))
        part = part.withColumn("number", number).join(shared, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("source_key") == F.col("s")) & (F.col("size") == F.col("z")))
        copies = F.expr("c div n") + F.when(F.col("number") <= F.col("c") % F.col("n"), 1).otherwise(0)
        out = out.unionByName(part.select("__row", copies.cast("long").alias("copies")).where("copies > 0"))
    return out.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")


ORACLE = r"""
with d as (
  select doc_id, source, coalesce('s:' || source, 'null') as k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), c as (
  select *, length(bin(size)) * 4 + (substr(bin(size), 2, 1) = '1')::int * 2 + (substr(bin(size), 3, 1) = '1')::int as class,
    ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 8))::bigint % 32 as bucket from d
), s as (
  select k, source, sum(size)::bigint as source_size,
    1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from d group by k, source
), t as (
  select *, 3 * source_size * sum(weight) over (o rows between current row and unbounded following)
    < weight * (sum(source_size) over () - coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0))::double as capped
  from s window o as (order by source_size * 1.0::double / weight, k)
), u as (
  select *, case when capped then (3 * source_size)::double else weight * (
      (sum(source_size) over () - coalesce(sum(3 * source_size) filter (where capped) over (), 0))::double
      / sum(weight) filter (where not capped) over ()) end as target from t
), v as (
  select k, source_size, target, case when source_size > 0 then target / source_size else 0.0::double end as rate,
    ('0x' || substr(md5('mix-1' || k), 1, 8))::bigint / 4294967296.0::double as off from u
), r as (
  select *, row_number() over (partition by k order by class, bucket, size, doc_id nulls first)::double as j from c
)
select doc_id, size, source_size, target,
  ((floor(j * rate + off) - floor((j - 1) * rate + off))::bigint * size)::bigint as taken
from r join v using (k)
"""
