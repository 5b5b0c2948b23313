"""Sharding by fixed virtual slots (operator 4): DataFrame functions only.

A document's doc_id is hashed into one of some thousands of slots. Bytes are summed by slot. A versioned map assigns slots to
shards: version 1 deals slots out in turn, knowing no sizes; each later version edits the one before so that the
shards' bytes are near equal (law "bytes"). Rebalancing edits the map, not the hash: a shard keeps its largest slots up to the equal share,
and only what is beyond, small slots, moves to the emptiest shards; a new shard starts empty and takes its share alike.
Versions are stored side by side in a folder and loaded by number. A map has as many rows as there are slots, whatever the input.

Null text has size 1 and CRC 0; a null doc_id is hashed like the empty string. Repeated rows get places of their own: they are
counted as one before places are given, and rows of one slot, such as those without id, are dealt by their texts, so
that no id is one task. An empty table gives no rows. Extra columns are ignored, whatever their names. Ties in bytes are
broken by slot. A very long text is only measured and summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import crc32, temporary, written

SLOTS = 4096
#: Groups by text that the rows of a slot are dealt to.
GROUPS = 16
#: Copies of a repeated row that are given places at once.
COPIES = 1 << 16
MAP = "version int, virtual_slot int, shard int, bytes long, rows long"


def virtual_slot(slots: int = SLOTS) -> Column:
    """The first 32 bits of the doc_id's MD5, in decimal digits, modulo the number of slots."""
    digits = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(digits.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return docs.select("doc_id", size.alias("size"), crc32("text").alias("text_crc32"), virtual_slot(slots).alias("virtual_slot"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes, rows: for every slot, empty ones too."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(F.broadcast(sums), "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """version (1), virtual_slot, shard, bytes, rows: slots dealt out in turn."""
    return sizes.select(F.lit(1).alias("version"), "virtual_slot", F.pmod("virtual_slot", F.lit(shards)).cast("int").alias("shard"), "bytes", "rows")


def rebalanced(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, for the sizes given and for as many shards or more.

    Each shard keeps its largest slots as long as they fit into the equal share; the others go, the largest first, to the shard with the
    fewest bytes then. As many rows as there are slots, so windows and lists are bounded.
    """
    known = current.select("version", "shard", F.col("virtual_slot").alias("_v")).join(sizes, F.col("_v") == F.col("virtual_slot")).drop("_v")
    share = F.sum("bytes").over(Window.partitionBy()) / shards
    upto = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    marked = known.select("*", (upto <= share).alias("stays"))
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda k: F.aggregate(F.filter("stay", lambda s: s["shard"] == k), F.lit(0).cast("long"), lambda a, s: a + s["bytes"]),
    )
    ordered = F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct(F.negative("bytes").alias("key"), "virtual_slot", "bytes", "rows"))))
    kept = marked.where("stays").groupBy("shard").agg(F.sum("bytes").alias("bytes")).agg(F.collect_list(F.struct("shard", "bytes")).alias("stay"))
    one = marked.agg(ordered.alias("o"), F.max("version").alias("version")).crossJoin(F.broadcast(kept)).select("version", "o", loads.alias("loads"))  # one row each

    def place(done: Column, slot: Column) -> Column:
        emptiest = F.array_position(done["loads"], F.array_min(done["loads"])).cast("int") - 1
        after = F.transform(done["loads"], lambda load, i: F.when(i == emptiest, load + slot["bytes"]).otherwise(load))
        return F.struct(after.alias("loads"), F.concat(done["placed"], F.array(emptiest)).alias("placed"))

    start = F.struct(F.col("loads").alias("loads"), F.array().cast("array<int>").alias("placed"))
    placed = one.select("version", "o", F.aggregate("o", start, place)["placed"].alias("p")).select("version", F.explode(F.arrays_zip("o", "p")).alias("x"))
    moved = placed.select("version", "x.o.virtual_slot", F.col("x.p").alias("shard"), "x.o.bytes", "x.o.rows")
    stays = marked.where("stays").select("version", "virtual_slot", "shard", "bytes", "rows")
    return stays.union(moved).select((F.col("version") + 1).alias("version"), "virtual_slot", "shard", "bytes", "rows")


class SlotMaps:
    """Versions of a slot map in a folder that all executors share, a Parquet table for each."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def save(self, slot_map: DataFrame) -> int:
        """Stores a map under the version that it carries; a version that is there already is an error. Returns the version."""
        version = slot_map.agg(F.max("version")).first()[0]
        slot_map.select("version", "virtual_slot", "shard", "bytes", "rows").coalesce(1).write.parquet(f"{self.folder}/{version:06d}")
        return version

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP).parquet(f"{self.folder}/{version:06d}")

    def versions(self) -> list[int]:
        """Numbers of the stored versions, ascending."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()) for s in system.listStatus(path)) if system.exists(path) else []


def shard_rows(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """rows with shard, map_version and slot, a place in the shard without gaps: virtual slots in order, in them groups by text, in these rows by doc_id."""
    group = F.pmod("text_crc32", F.lit(GROUPS)).cast("int")
    # Equal rows are one until they have places. Both tables below have slots x GROUPS rows at most.
    equal = written(rows.groupBy("virtual_slot", group.alias("group"), "doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "equal-rows")
    sums = equal.groupBy("virtual_slot", "group").agg(F.sum("n").alias("n")).select(F.col("virtual_slot").alias("_v"), F.col("group").alias("_g"), "n")
    upto = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "_g"))
    where = slot_map.select("virtual_slot", "shard", F.col("version").alias("map_version")).join(F.broadcast(sums), F.col("virtual_slot") == F.col("_v")).select("_v", "_g", "shard", "map_version", (upto - F.col("n")).alias("_before"))
    own = Window.partitionBy("virtual_slot", "group").orderBy(F.asc_nulls_first("doc_id"), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    placed = equal.withColumn("_own", F.sum("n").over(own) - F.col("n")).join(F.broadcast(where), (F.col("virtual_slot") == F.col("_v")) & (F.col("group") == F.col("_g")))
    # Copies in blocks, so that no row unfolds without bound.
    blocks = placed.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    copies = F.explode(F.sequence(F.col("_block"), F.least(F.col("_block") + COPIES, F.col("n")) - 1)).alias("_copy")
    out = blocks.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "map_version", (F.col("_before") + F.col("_own")).alias("_at"), copies)
    return out.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "map_version", (F.col("_at") + F.col("_copy")).cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = 16, slots: int = SLOTS, maps: SlotMaps | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version, first_shard.

    The latest stored map is edited for the documents' sizes, and rows are sharded by the version that is stored then; without
    one, version 1 is made first. first_shard: the shard by the version before.
    """
    rows = written(sized(docs, slots), "sized")
    maps = maps or SlotMaps(docs.sparkSession, temporary(docs.sparkSession, "slot-maps"))
    sizes = written(slot_sizes(rows, slots), "slot-sizes")
    have = maps.versions()
    before = have[-1] if have else maps.save(first_map(sizes, shards))
    version = maps.save(rebalanced(maps.load(before), sizes, shards))
    out = shard_rows(rows, maps.load(version))
    old = maps.load(before).select(F.col("virtual_slot").alias("_v"), F.col("shard").alias("first_shard"))
    out = out.join(F.broadcast(old), F.col("virtual_slot") == F.col("_v"))  # a row for each slot
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "first_shard")
