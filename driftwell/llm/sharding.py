"""Sharding through fixed virtual slots and a stored, versioned map from slots to shards."""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path

#: Virtual slots; fixed for the life of a store, so that a map stays valid when shards come and go.
SLOTS = 4096


def virtual_slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: a hash of its key, or of its text where the key is null."""
    digest = F.md5(F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots


def balanced_map(slot_bytes: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot: largest slots first, each to the shard with the fewest bytes so far (ties: lowest shard)."""
    load = [(0, shard) for shard in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-slot_bytes.get(s, 0), s)):
        size, shard = load[0]
        out[slot] = shard
        heapq.heapreplace(load, (size + slot_bytes.get(slot, 0), shard))
    return out


def grown_map(assigned: list[int], slot_bytes: dict[int, int], shards: int) -> list[int]:
    """The map edited for one more shard: slots move only into the new shard (number ``shards``), from the fullest
    shard each time, while the new shard stays below its even share.  Where the slots of the fullest are too large to
    move, the next fullest gives one, if it stays no emptier than the new shard."""
    load = [0] * shards
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    for slot, shard in enumerate(assigned):
        load[shard] += slot_bytes.get(slot, 0)
        held[shard].append((slot_bytes.get(slot, 0), slot))
    for slots in held.values():
        slots.sort()
    share, taken, out = sum(load) / (shards + 1), 0, list(assigned)
    while True:
        for place, fullest in enumerate(sorted(range(shards), key=lambda s: (-load[s], s))):
            fit = [x for x in held[fullest] if taken + x[0] <= share and x[0] > 0 and (place == 0 or load[fullest] - x[0] >= taken + x[0])]
            if fit:
                break
        else:
            return out
        size, slot = fit[-1]
        held[fullest].remove((size, slot))
        load[fullest] -= size
        taken += size
        out[slot] = shards


MAP_SCHEMA = "virtual_slot long, shard int, bytes long, rows long, version int"


def save_map(spark: SparkSession, assigned: list[int], path: str, version: int, totals: dict[int, tuple[int, int]] | None = None) -> None:
    """Adds a version to the stored map, with the bytes and rows of each slot at that time; earlier versions stay."""
    held = totals or {}
    lists = [assigned, *([held.get(s, (0, 0))[i] for s in range(len(assigned))] for i in (0, 1))]
    shard, size, rows = (F.get(F.from_json(F.lit(json.dumps(x)), "array<bigint>"), F.col("id").cast("int")) for x in lists)
    table = spark.range(len(assigned)).select(F.col("id").alias("virtual_slot"), shard.cast("int").alias("shard"), size.alias("bytes"), rows.alias("rows"), F.lit(version).alias("version"))
    table.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def has_map(spark: SparkSession, path: str) -> bool:
    """Whether a map is stored at a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the latest unless one is named."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def held_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[list[int], dict[int, int], int]:
    """Shard of each slot, bytes of each slot and number of a stored version; as many rows as there are slots."""
    rows = load_map(spark, path, version).orderBy("virtual_slot").collect()
    if [r["virtual_slot"] for r in rows] != list(range(len(rows))) or not rows:
        raise ValueError(f"version {version} of the map at {path} does not hold each slot once")
    return [r["shard"] for r in rows], {r["virtual_slot"]: r["bytes"] for r in rows}, rows[0]["version"]


def grow_map(spark: SparkSession, path: str, shards: int, totals: dict[int, tuple[int, int]] | None = None) -> int:
    """Edits the latest stored map for one more shard, by the bytes given or those stored with it, and saves the next
    version, whose number it returns."""
    before, size, version = held_map(spark, path)
    if max(before) >= shards:
        raise ValueError(f"the map at {path} has shard {max(before)}, so more than {shards} shards")
    size = {s: b for s, (b, _) in totals.items()} if totals is not None else size
    save_map(spark, grown_map(before, size, shards), path, version + 1, totals if totals is not None else {s: (b, 0) for s, b in size.items()})
    return version + 1


def sized_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        virtual_slot(F.col(id_col), F.col(text_col), slots).alias("virtual_slot"),
    )


def slot_totals(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot; at most as many rows as there are slots."""
    got = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in got}


def _placed(records: DataFrame, totals: dict[int, tuple[int, int]], stored: DataFrame, assigned: list[int], shards: int) -> DataFrame:
    """Records with the shard of their slot in a stored map and their place in it; ``assigned`` is that map."""
    first, seen = [0] * len(assigned), [0] * shards
    for slot, shard in enumerate(assigned):
        first[slot] = seen[shard]
        seen[shard] += totals.get(slot, (0, 0))[1]
    starts = F.from_json(F.lit(json.dumps(first)), "array<bigint>")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return records.join(F.broadcast(stored.select("virtual_slot", "shard", "version")), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.get(starts, F.col("virtual_slot").cast("int")) + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Places every row in a shard so that the shards hold nearly equal bytes.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version``.  ``size`` is the
    UTF-8 length of the text plus 1 (null: an empty text).  Rows are hashed by id (by text where the id is null) into
    ``slots`` virtual slots, bytes are summed per slot, and the map from slots to shards made from them is stored at
    ``map_path`` (a folder of the shared one by default) and read back.  Where a map is stored there already, its latest
    version places the rows and stays as it is; it is an error if it has other slots or more shards.  ``slot`` numbers
    the rows of a shard from 0 without gaps, by virtual slot, id, checksum and size.  Repeated rows get places of their
    own; an empty table gives none; other columns are not read.  The map and the slot totals have a fixed number of
    rows, whatever the input; rows of one id share a virtual slot and are numbered there by one task.
    """
    spark = docs.sparkSession
    records = sized_records(docs, id_col, text_col, slots)
    totals = slot_totals(records)
    if map_path is None or not has_map(spark, map_path):
        map_path = map_path or new_path(spark, "slot-map")
        save_map(spark, balanced_map({s: b for s, (b, _) in totals.items()}, shards, slots), map_path, 1, totals)
    assigned, _, version = held_map(spark, map_path)
    if len(assigned) != slots or max(assigned) >= shards:
        raise ValueError(f"the map at {map_path} has {len(assigned)} slots and {max(assigned) + 1} shards, not {slots} and {shards}")
    return _placed(records, totals, load_map(spark, map_path, version), assigned, shards)


def grow_documents(docs: DataFrame, map_path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places every row after shard number ``shards`` joins the ``shards`` shards of the map stored at ``map_path``.

    Returns the columns of ``shard_documents`` and ``shard_before``.  The latest stored version is edited with
    ``grown_map`` for the bytes of ``docs`` and saved as the next version; earlier versions stay.  ``shard``, ``slot``
    and ``map_version`` are of the new version: rows keep their shard or move into the new one, and ``slot`` is numbered
    anew.  A map has no more rows than slots, whatever the input.
    """
    spark = docs.sparkSession
    before, _, _ = held_map(spark, map_path)
    records = sized_records(docs, id_col, text_col, len(before))
    totals = slot_totals(records)
    version = grow_map(spark, map_path, shards, totals)
    placed = _placed(records, totals, load_map(spark, map_path, version), held_map(spark, map_path, version)[0], shards + 1)
    held = F.from_json(F.lit(json.dumps(before)), "array<int>")
    return placed.withColumn("shard_before", F.get(held, F.col("virtual_slot").cast("int")))


def rebalanced(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``shard_documents`` with a map of its own, and ``rebalanced_shard``: the shard of each row in the next version of
    the map, which is edited for one more shard by the bytes stored with the first."""
    path = new_path(docs.sparkSession, "slot-map")
    placed = shard_documents(docs, shards, id_col, text_col, map_path=path)
    after = load_map(docs.sparkSession, path, grow_map(docs.sparkSession, path, shards))
    return placed.join(F.broadcast(after.select("virtual_slot", F.col("shard").alias("rebalanced_shard"))), "virtual_slot")


#: Checksums byte by byte, the map slot by slot, and its edit move by move, for 4,096 slots and 8 shards.
ORACLE = r"""
with recursive t0 as (
  select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as tbl
), d as (
  select doc_id, coalesce(text, '') as t, string_split(hex(encode(coalesce(text, ''))), '') as h from documents
), b as (
  select doc_id, t, list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: ((ord(h[i]) - case when ord(h[i]) > 57 then 55 else 48 end) * 16 + ord(h[i + 1]) - case when ord(h[i + 1]) > 57 then 55 else 48 end)::bigint)) as bs from d
), c as (
  select doc_id, (strlen(t) + 1)::bigint as size, xor(list_reduce(bs, lambda a, x: xor(a >> 8, tbl[(xor(a, x) & 255) + 1])), 4294967295)::bigint as text_crc32,
    ('0x' || substr(md5(coalesce(doc_id::varchar, 'text:' || t)), 1, 8))::bigint % 4096 as vs from b, t0
), s as (
  select vs, coalesce(sum(size), 0)::bigint as bytes from (select unnest(range(4096)) as vs) left join c using (vs) group by vs
), o as (
  select vs, bytes, row_number() over (order by bytes desc, vs) as i from s
), g(i, vs, shard, load) as (
  select 0::bigint, -1::bigint, -1::int, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]
  union all
  select o.i, o.vs, (list_position(load, list_min(load)) - 1)::int,
    list_transform(load, lambda x, k: case when k = list_position(load, list_min(load)) then x + o.bytes else x end)
  from g join o on o.i = g.i + 1
), m(step, vs, shard, bytes) as (
  select 0, vs, shard, bytes from g join s using (vs)
  union all
  select step + 1, vs, case when place = 1 then 8 else shard end, bytes from (
    select *, row_number() over (order by fits desc, load desc, shard, bytes desc, vs desc) as place, bool_or(fits) over () as more from (
      select *, shard < 8 and bytes > 0 and taken + bytes <= total / 9 and (shard = fullest or load - bytes >= taken + bytes) as fits from (
        select *, first_value(shard) over (order by shard = 8, load desc, shard) as fullest from (
          select *, sum(bytes) over (partition by shard) as load, coalesce(sum(bytes) filter (where shard = 8) over (), 0) as taken, (sum(bytes) over ())::double as total from m
        )
      )
    )
  ) where more
), r as (
  select vs, arg_max(shard, step) as rebalanced_shard from m group by vs
)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by vs, doc_id nulls first, text_crc32, size) - 1 as slot, null::int as grown_shard, rebalanced_shard
from c join g using (vs) join r using (vs)
"""
