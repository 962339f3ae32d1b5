"""Sharding by fixed virtual slots; DataFrame functions only.

Every record belongs to a virtual slot for good: a hash of its id, modulo a fixed number of slots. A map, stored
with its version, says which shard holds a slot. The first map gives slots to shards by their bytes, largest
first to the lightest shard; rebalancing or adding shards edits the map, and only the slots it names move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 8192
SHARDS = 40
RECORD_OVERHEAD = 16
# Rows of a slot are numbered in this many parts, so that no task sorts a whole slot.
PARTS = 16


def _hash(doc_id: Column) -> Column:
    """32 bits of the MD5 of the id as text; a null id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and a fixed overhead), text_crc32, virtual_slot, part.

    Texts go no further than this projection. A null text has no bytes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    code = _hash(F.col("doc_id"))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + RECORD_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (code % slots).alias("virtual_slot"),
        (F.floor(code / slots) % PARTS).alias("part"),
    )


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes, n_rows of every slot, empty ones too."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    every = rows.sparkSession.range(slots).withColumnRenamed("id", "virtual_slot")
    return every.join(sums, "virtual_slot", "left").fillna(0, ["bytes", "n_rows"])


def _greedy(slots: DataFrame, start_loads: Column) -> DataFrame:
    """Slots, largest first, to the lightest shard: one fold over the fixed number of slots."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "virtual_slot")))

    def put(state: Column, slot: Column) -> Column:
        loads = state["loads"]
        lightest = F.array_position(loads, F.array_min(loads)).cast("int") - 1
        return F.struct(
            F.transform(loads, lambda v, k: F.when(k == lightest, v - slot["order"]).otherwise(v)).alias("loads"),
            F.concat(state["shards"], F.array(lightest)).alias("shards"),
        )

    begin = F.struct(start_loads.alias("loads"), F.array().cast("array<int>").alias("shards"))
    folded = slots.groupBy().agg(ordered.alias("ordered"))
    placed = folded.withColumn("shards", F.aggregate("ordered", begin, put)["shards"])
    pairs = placed.select(F.explode(F.arrays_zip("ordered", "shards")).alias("p"))
    return pairs.select(F.col("p.ordered.virtual_slot").alias("virtual_slot"), F.col("p.shards").alias("shard"))


def first_map(slots: DataFrame, shards: int = SHARDS) -> DataFrame:
    """version, virtual_slot, shard: the first map."""
    placed = _greedy(slots, F.array_repeat(F.lit(0).cast("bigint"), shards))
    return placed.select(F.lit(1).alias("version"), "virtual_slot", "shard")


def grown_map(current: DataFrame, slots: DataFrame, shards: int) -> DataFrame:
    """The next version, for one shard more than ``shards``: slots move into the new shard only.

    Every shard gives its smallest slots, as long as they sum to no more than its share for the new one.
    """
    loads = current.join(slots, "virtual_slot")
    held, every = Window.partitionBy("shard"), Window.partitionBy(F.lit(0))  # one row per slot
    given = held.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = loads.withColumns(
        {
            "load": F.sum("bytes").over(held),
            "given": F.sum("bytes").over(given),
            "target": F.sum("bytes").over(every) / (shards + 1),
        }
    )
    moved = F.col("given") <= F.col("load") - F.col("target")
    return share.select(
        (F.col("version") + 1).alias("version"),
        "virtual_slot",
        F.when(moved, F.lit(shards)).otherwise(F.col("shard")).alias("shard"),
    )


def map_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the slot map below ``path`` that were written to their end, rising."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    folders = [status.getPath() for status in files.listStatus(root)]
    done = [f for f in folders if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(f.getName().removeprefix("version=")) for f in done)


def save_map(slot_map: DataFrame, path: str) -> int:
    """Keep a map as ``<path>/version=<n>``, where it outlives the run; its version.

    A version that is there is an error, as records were placed by it; one whose writing broke off is written again. The
    map has rows of one version; an empty one is an error.
    """
    versions = [r["version"] for r in slot_map.select("version").distinct().limit(2).collect()]
    if len(versions) != 1:
        raise ValueError("a slot map has one version")
    if versions[0] in map_versions(slot_map.sparkSession, path):
        raise ValueError(f"version {versions[0]} of the slot map is kept already")
    slot_map.select("virtual_slot", "shard").write.mode("overwrite").parquet(f"{path}/version={versions[0]}")
    return versions[0]


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """version, virtual_slot, shard of a kept map; the last version, if none is named."""
    known = map_versions(spark, path)
    if not known or version not in (None, *known):
        raise ValueError(f"no version {version or ''} of a slot map in {path}")
    version = known[-1] if version is None else version
    rows = spark.read.parquet(f"{path}/version={version}")
    return rows.select(F.lit(version).alias("version"), "virtual_slot", "shard")


def moved_slots(before: DataFrame, after: DataFrame) -> DataFrame:
    """virtual_slot, from_shard, to_shard of the slots that two versions of a map place differently: what to move."""
    old = before.select("virtual_slot", F.col("shard").alias("from_shard"))
    new = after.select("virtual_slot", F.col("shard").alias("to_shard"))
    return old.join(new, "virtual_slot").filter("from_shard <> to_shard")


def assigned(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Every record with its shard and its place there (``slot``), numbered from 0 without gaps.

    A record's place is the sum of three counts: records of the shard's earlier slots, records of earlier parts of
    its slot, and earlier records of its part. Only the third looks at records, a small part at a time.
    """
    sizes = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n_rows"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.join(slot_map.select("virtual_slot", "shard"), "virtual_slot").select(
        "virtual_slot", "part", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("base")
    )
    order = ("doc_id", "size", "text_crc32")
    number = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy(*order)).cast("bigint") - 1
    numbered = rows.withColumn("number", number)
    return numbered.join(bases, ["virtual_slot", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("number")).alias("slot"), "virtual_slot"
    )
