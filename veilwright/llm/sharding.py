"""Sharding by fixed virtual slots.

A record's hash gives one of thousands of slots for good. Bytes and rows are summed per slot (before the
shuffle, and one row a slot after it), and a versioned map tells which shard has which slot. The map is small
and of fixed size; rebalancing edits it and writes a new version, and moves only the slots that it names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwright.llm.runtime import Scratch, fresh

SLOTS = 4096
SHARDS = 16


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (none for null), plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def virtual_slot(id_: Column, text: Column, slots: int = SLOTS) -> Column:
    """A slot that depends on nothing but the record. Its text counts as well, so null or repeated ids spread."""
    return F.pmod(F.xxhash64(F.lit("slot"), id_, text), F.lit(slots)).cast("int")


def balanced(sizes: Sequence[int], shards: int) -> list[int]:
    """A shard for each slot: the largest slots first, each to the shard that has least; ties to the lower number."""
    import heapq

    heap, out = [(0, s) for s in range(shards)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        total, s = heapq.heappop(heap)
        out[i] = s
        heapq.heappush(heap, (total + sizes[i], s))
    return out


def rebalanced(sizes: Sequence[int], old: Sequence[int], shards: int, tolerance: float = 0.02) -> list[int]:
    """old, edited for other sizes or another number of shards: slots of shards that are no more, and then of
    the fullest ones, go to the emptiest until these two are within a share `tolerance` of the mean, or no move
    brings them closer. Other slots stay."""
    out, totals = list(old), [0] * shards
    homeless = [i for i, s in enumerate(out) if s >= shards]
    for i, s in enumerate(out):
        if s < shards:
            totals[s] += sizes[i]
    for i in sorted(homeless, key=lambda i: (-sizes[i], i)):
        out[i] = s = min(range(shards), key=lambda s: (totals[s], s))
        totals[s] += sizes[i]
    for _ in range(len(out) * 2):
        full = max(range(shards), key=lambda s: (totals[s], -s))
        bare = min(range(shards), key=lambda s: (totals[s], s))
        gap = totals[full] - totals[bare]
        fits = [i for i, s in enumerate(out) if s == full and 0 < sizes[i] < gap]
        if not fits or gap * shards <= tolerance * sum(totals):
            break
        i = min(fits, key=lambda i: (abs(sizes[i] - gap / 2), i))
        out[i] = bare
        totals[full] -= sizes[i]
        totals[bare] += sizes[i]
    return out


def grown(sizes: Sequence[int], old: Sequence[int], shards: int) -> list[int]:
    """old, edited for more shards: slots go from the fullest shards to new ones only, until these have their share."""
    out, totals = list(old), [0] * shards
    for i, s in enumerate(out):
        totals[s] += sizes[i]
    share = sum(totals) / shards
    for new in range(max(old, default=-1) + 1, shards):
        while True:
            full = max(range(shards), key=lambda s: (totals[s], -s))
            room = min(share - totals[new], totals[full] - totals[new])
            fits = [i for i, s in enumerate(out) if s == full and 0 < sizes[i] <= room]
            if full == new or not fits:
                break
            i = min(fits, key=lambda i: (abs(sizes[i] - (totals[full] - share)), i))
            out[i] = new
            totals[full] -= sizes[i]
            totals[new] += sizes[i]
    return out


def slot_sizes(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slot, bytes, rows) of the slots that have rows: at most as many rows as slots."""
    text = F.col(text_col)
    return docs.select(virtual_slot(F.col(id_col), text, slots).alias("slot"), size_of(text).alias("size")).groupBy("slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def gathered(sizes: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; as many numbers as slots, whatever the input."""
    size, rows = [0] * slots, [0] * slots
    for r in sizes.collect():
        size[r["slot"]], rows[r["slot"]] = r["bytes"], r["rows"]
    return size, rows


def table_of(numbers: Sequence[int], slot: Column) -> Column:
    """The number at a slot, looked up in a constant array."""
    return F.element_at(F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>"), slot + 1)


def map_table(spark: SparkSession, shard_of: Sequence[int], version: int) -> DataFrame:
    """(version, slot, shard): a version of the slot-to-shard map."""
    slots = spark.range(len(shard_of)).select(F.col("id").cast("int").alias("slot"))
    return slots.select(F.lit(version).alias("version"), "slot", table_of(shard_of, F.col("slot")).cast("int").alias("shard"))


def store_map(spark: SparkSession, path: str, shard_of: Sequence[int], version: int) -> None:
    """Add a version to the map at path (one Parquet folder a version; the versions before it stay)."""
    map_table(spark, shard_of, version).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """A version, by default the last, of the map at path."""
    t = spark.read.parquet(path)
    if version is None:
        version = t.agg(F.max("version")).first()[0]
    return version, [r["shard"] for r in t.where(F.col("version") == version).orderBy("slot").collect()]


def assign(docs: DataFrame, shard_of: Sequence[int]) -> DataFrame:
    """docs with virtual_slot and shard (in place of columns of these names). No row moves between tasks. Null ids and
    texts hash like values, repeated rows get one shard, and an empty table gives an empty one."""
    kept = [c for c in docs.columns if c.lower() not in ("virtual_slot", "shard")]
    (v,) = fresh(docs, "virtual")
    with_slot = docs.withColumn(v, virtual_slot(F.col("doc_id"), F.col("text"), len(shard_of)))
    return with_slot.select(*kept, F.col(v).alias("virtual_slot"), table_of(shard_of, F.col(v)).cast("int").alias("shard"))


def has_map(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def current_map(spark: SparkSession, path: str, sizes: Sequence[int], shards: int, tolerance: float = 0.02) -> tuple[int, list[int]]:
    """The version of the map at path that holds for these sizes and shards, and its shards by slot.

    Where there is none, one with near equal bytes becomes version 1. Else the last version is read; if its shards are
    other than these or too uneven, it is edited (only the slots that have to move get another shard) and stored as the
    next version. The versions before it stay.
    """
    if not has_map(spark, path):
        store_map(spark, path, balanced(sizes, shards), 1)
        return load_map(spark, path)
    version, old = load_map(spark, path)
    new = grown(sizes, old, shards) if shards > max(old) + 1 else old
    new = rebalanced(sizes, new, shards, tolerance)
    if new != old:
        store_map(spark, path, new, version + 1)
        return load_map(spark, path)
    return version, old


def _map_path(docs: DataFrame, path: str | None) -> str:
    return path or f"{Scratch(docs.sparkSession, 'shards').root}/map"


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """assign() by the map at path (see current_map()), which makes the shards' bytes near equal; without a path the map
    is a new one in the shared folder.

    A null text counts one byte, a very long one as many as it has; equal rows share a slot, equal texts of different
    doc_ids don't; a null doc_id is a value like others; an empty table gives none.
    """
    _, shard_of = current_map(docs.sparkSession, _map_path(docs, path), gathered(slot_sizes(docs, slots), slots)[0], shards)
    return assign(docs, shard_of)


def shard_report(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law `bytes`, shard, slot (the row's place in its
    shard, gapless from 0: by virtual slot, then doc_id), grown_shard (null under this law), virtual_slot, map_version.

    The map is that of shard_documents(). A place is the count of rows in the shard's slots before (a table as long as
    there are slots) and the number within the slot, so no task sorts more than a slot. A null text has size 1 and crc
    0, a null doc_id comes first within its slot, repeated rows get places of their own, and an empty table gives none.
    Groups of equal texts are not kept in one shard: a group may hold a third of all bytes, and `bytes` would not hold.
    """
    size, rows = gathered(slot_sizes(docs, slots), slots)
    version, shard_of = current_map(docs.sparkSession, _map_path(docs, path), size, shards)
    before, at = [0] * slots, [0] * shards
    for i, s in enumerate(shard_of):
        before[i], at[s] = at[s], at[s] + rows[i]
    text = F.col("text")
    narrow = docs.select(
        F.col("doc_id"), size_of(text).alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), virtual_slot(F.col("doc_id"), text, slots).alias("virtual_slot")
    )
    number = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return narrow.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        table_of(shard_of, F.col("virtual_slot")).cast("int").alias("shard"),
        (table_of(before, F.col("virtual_slot")) + number - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(version).alias("map_version"),
    )
