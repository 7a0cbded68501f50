"""Exact duplicates: groups of equal normalised texts by a 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Characters that normalising deletes: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Hashes that may be broadcast (16 bytes each); beyond, the tables are joined by a shuffle.
BROADCAST_HASHES = 500_000


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def content_hash(text: Column) -> Column:
    """128 bits of a normalised text."""
    return F.unhex(F.md5(text))


def _collisions(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Hashes under which texts of different bytes meet: where the least and the greatest text differ."""
    few = repeated.count() <= BROADCAST_HASHES
    texts = docs.join(F.broadcast(repeated) if few else repeated, "hash", "left_semi")
    return texts.groupBy("hash").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).where("least <> most").select("hash")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher=content_hash) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without blanks; null counts as empty.  Of equal texts the row with the most
    code points in its original text stays, then the one with the smallest id (a null id only where no other is left);
    of rows that also share these one stays, so exactly one row of a group has ``kept``.  ``hasher`` gives the content
    hash; hashes under which different texts meet are told apart by the texts themselves.  Only ids, hashes and lengths
    are shuffled, and of the texts the least and greatest of each hash that occurs twice.  Ids may be of any type that has
    an order.  Texts may be of any length; other columns are not read.  An empty table gives none.
    """
    norm = normalised(F.col(text_col))
    docs = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"))
    docs = docs.withColumn("hash", hasher(F.col("norm")))
    rows = docs.select("hash", "doc_id", "chars", F.unhex(F.sha2("norm", 256)).alias("sha")).groupBy("hash", "doc_id", "chars", "sha").agg(F.count("*").alias("n"))
    rows = written(rows, "rows")
    repeated = written(rows.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash"), "repeated")
    collided = written(_collisions(docs.select("hash", "norm"), repeated), "collided")
    if collided.head(1):
        told = docs.join(collided, "hash", "left_semi").groupBy("hash", "norm").agg(F.first(F.sha2("norm", 256)).alias("hex"))
        told = told.select("hash", F.unhex("hex").alias("sha"), F.dense_rank().over(Window.partitionBy("hash").orderBy("norm")).alias("part"))
        rows = rows.join(told, ["hash", "sha"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    else:
        rows = rows.withColumn("part", F.lit(0))
    first = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    best = rows.groupBy("hash", "part").agg(F.sum("n").alias("group_size"), first.alias("best"))
    best = best.select("hash", "part", "group_size", (-F.col("best.less")).alias("best_chars"), F.col("best.doc_id").alias("keep_id"))
    out = rows.join(best, ["hash", "part"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("best_chars")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, of which ``exact_groups`` has ``kept``.

    What goes is looked up by id and text; rows that repeat both are thinned to the longest original text, one row.
    """
    told = exact_groups(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    told = written(told.where("not kept or n > 1").select("doc_id", F.unhex("text_sha256").alias("sha"), F.col("kept").alias("thin")), "dropped")
    few = told.count() <= BROADCAST_HASHES
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", F.col(f"row.{id_col}").alias("id"), F.unhex(F.sha2(normalised(F.col(f"row.{text_col}")), 256)).alias("norm_sha"))
    marked = rows.join(F.broadcast(told) if few else told, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("norm_sha") == F.col("sha")), "left")
    out = marked.where("thin is null").select("row")
    if told.where("thin").head(1):
        order = Window.partitionBy("id", "norm_sha").orderBy(F.length(F.col(f"row.{text_col}")).desc_nulls_last())
        out = out.unionByName(marked.where("thin").withColumn("place", F.row_number().over(order)).where("place = 1").select("row"))
    return out.select("row.*")


ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as n from documents
)
select doc_id,
  first_value(doc_id) over (partition by n order by length(t) desc, doc_id nulls last) as keep_id,
  count(*) over (partition by n) as group_size,
  row_number() over (partition by n order by length(t) desc, doc_id nulls last) = 1 as kept,
  sha256(n) as text_sha256
from d
"""
