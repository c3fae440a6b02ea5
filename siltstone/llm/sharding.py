"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots for ever; slots belong to shards by
a table of versions (version, slot, shard).  Version 1 lays the slots on the
shards by bytes.  A later version holds only the slots that move, so a
rebalancing is a small edit and everything else stays where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.llm.common import shared_dir, stored

SLOTS = 4096


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a record's key; a null key is in slot 0."""
    digest = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.coalesce(digest % slots, F.lit(0)).cast("int")


def slot_bytes(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slot, docs, bytes) of every slot, empty ones too; a null text has no bytes."""
    own = docs.select(slot_of(F.col(id_col), slots).alias("slot"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    held = own.groupBy("slot").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"))
    every = docs.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(held, "slot", "left").select("slot", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def initial_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the slot map: consecutive slots, each shard about as many bytes."""
    # slots are a fixed number, so these windows without a partition are over a few thousand rows
    order = W.orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sized = loads.select("slot", F.sum(F.col("bytes") + 1).over(order).alias("upto"), (F.col("bytes") + 1).alias("own"), F.sum(F.col("bytes") + 1).over(every).alias("total"))
    return sized.select(F.lit(1).alias("version"), "slot", F.expr(f"CAST((2 * upto - own) * {shards} DIV (2 * total) AS INT)").alias("shard"))


def rebalanced(slot_map: DataFrame, loads: DataFrame, shards: int, more: int) -> DataFrame:
    """The slot map with one version more, for ``more`` new shards beside the ``shards`` there are.

    Each old shard keeps its first slots up to the new mean load; what is over
    is laid on the new shards by bytes.  Slots never move between old shards.
    """
    version = slot_map.agg(F.max("version").alias("v"))
    now = current(slot_map).join(loads.select("slot", (F.col("bytes") + 1).alias("own")), "slot")
    order = W.partitionBy("shard").orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    over = now.select("slot", "shard", "own", F.sum("own").over(order).alias("kept"), F.sum("own").over(every).alias("total"))
    over = over.where(F.col("kept") * (shards + more) > F.col("total"))
    along = W.orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    moved = over.select("slot", "own", F.sum("own").over(along).alias("upto"), F.sum("own").over(every).alias("surplus"))
    edit = moved.crossJoin(version).select(
        (F.col("v") + 1).cast("int").alias("version"), "slot", F.expr(f"CAST({shards} + (2 * upto - own) * {more} DIV (2 * surplus) AS INT)").alias("shard")
    )
    return slot_map.select("version", "slot", "shard").unionByName(edit)


def current(slot_map: DataFrame, version: int | None = None) -> DataFrame:
    """(slot, shard) as of a version (the last one if none is given)."""
    upto = slot_map if version is None else slot_map.where(F.col("version") <= version)
    return upto.groupBy("slot").agg(F.max_by("shard", "version").alias("shard"))


def assignments(docs: DataFrame, slot_map: DataFrame, slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, slot, shard, moved): where each row was in version 1's map and whether a later version moved it."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), slot_of(F.col(id_col), slots).alias("slot"))
    last = current(slot_map).select("slot", F.col("shard"))
    first = current(slot_map, 1).select("slot", F.col("shard").alias("first"))
    # one row a slot: a table of fixed size
    table = last.join(first, "slot").select("slot", "shard", (F.col("shard") != F.col("first")).alias("moved"))
    return own.join(F.broadcast(table), "slot").select("doc_id", "slot", "shard", "moved")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions whose files are complete in the folder of a map."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(version, slot, shard, shards) of all complete versions of the map kept at ``path``; an error where there is none."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no slot map at {path}")
    return spark.read.schema("version int, slot int, shard int, shards int").parquet(*(f"{path}/v={v}" for v in found))


def create_map(loads: DataFrame, path: str, shards: int) -> DataFrame:
    """Version 1 of a map by the loads of ``slot_bytes``, kept at ``path``; an error where a map is there already."""
    spark = loads.sparkSession
    if _versions(spark, path):
        raise FileExistsError(f"a slot map is at {path} already: use grow_map")
    initial_map(loads, shards).withColumn("shards", F.lit(shards)).coalesce(1).write.mode("overwrite").parquet(f"{path}/v=1")
    return read_map(spark, path)


def grow_map(loads: DataFrame, path: str, more: int) -> DataFrame:
    """The map kept at ``path`` with one version more, which only lists the slots that move to ``more`` new shards.

    The versions before are read, never made anew: today's loads only decide
    what moves.  A version's folder counts once its writing has ended, so a
    run that was lost half-way is written over by the next.  One writer at a
    time is assumed.
    """
    if more < 1:
        raise ValueError("at least one new shard")
    spark = loads.sparkSession
    kept = read_map(spark, path)
    last, shards = kept.agg(F.max("version"), F.max("shards")).first()
    edit = rebalanced(kept, loads, shards, more).where(F.col("version") > last).withColumn("shards", F.lit(shards + more))
    edit.coalesce(1).write.mode("overwrite").parquet(f"{path}/v={last + 1}")
    return read_map(spark, path)


def shard(
    docs: DataFrame, shards: int = 64, more: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None
) -> DataFrame:
    """(doc_id, slot, shard, moved) of every row, after growing from ``shards`` to ``shards + more`` shards.

    The map is made at ``map_path`` (a new shared folder if none is given),
    where ``grow_map`` edits it later and ``read_map`` reads it for
    ``assignments``.  Null ids are in slot 0 and null texts weigh nothing; rows
    of one id are in one slot; other columns are ignored; an empty table gives
    an empty result.
    """
    path = map_path or shared_dir(docs.sparkSession, "slot-map")
    loads = stored(slot_bytes(docs, slots, id_col, text_col).coalesce(1), "slot-bytes")
    create_map(loads, path, shards)
    return assignments(docs, grow_map(loads, path, more), slots, id_col)


SHARD_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes,
         CAST(coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 4096, 0) AS INTEGER) AS slot FROM documents
), l AS (
  SELECT CAST(r.range AS INTEGER) AS slot, CAST(coalesce(sum(bytes), 0) AS BIGINT) + 1 AS own FROM range(4096) r LEFT JOIN d ON d.slot = r.range GROUP BY 1
), a AS (
  SELECT slot, own, CAST(sum(own) OVER (ORDER BY slot) AS BIGINT) AS upto, CAST(sum(own) OVER () AS BIGINT) AS total FROM l
), v1 AS (
  SELECT slot, own, total, CAST((2 * upto - own) * 64 // (2 * total) AS INTEGER) AS shard FROM a
), k AS (
  SELECT *, CAST(sum(own) OVER (PARTITION BY shard ORDER BY slot) AS BIGINT) AS kept FROM v1
), o AS (SELECT * FROM k WHERE kept * 80 > total
), m AS (
  SELECT slot, own, CAST(sum(own) OVER (ORDER BY slot) AS BIGINT) AS upto, CAST(sum(own) OVER () AS BIGINT) AS surplus FROM o
), v2 AS (SELECT slot, CAST(64 + (2 * upto - own) * 16 // (2 * surplus) AS INTEGER) AS shard FROM m)
SELECT d.doc_id, d.slot, coalesce(v2.shard, v1.shard) AS shard, v2.shard IS NOT NULL AND v2.shard <> v1.shard AS moved
FROM d JOIN v1 USING (slot) LEFT JOIN v2 USING (slot)
"""
