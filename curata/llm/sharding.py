"""Fixed virtual slots: documents to slots by hash, slots to shards by a versioned map.

A document's slot is a hash of its id, so copies and long texts spread evenly.
Bytes are summed per slot; the map gives each slot a shard, largest slot first
to the lightest shard, and is stored with a version.  When data has grown or a
shard is added, a new version moves as few slots as it needs; documents never
change their slot.

The law held is ``bytes``: shard sizes are near equal.  The largest gap is one
slot's size, and there are ``SLOTS`` of them.

The map has ``SLOTS`` rows at any size of data, so it is made on the driver and
broadcast.  Places inside a shard are numbered from counts of ``SLOTS * PIECES``
pieces of the hash, so no window sees more than one piece.

Nulls: a null text has no bytes and counts as one (size 1, checksum of nothing);
a null doc_id stays null and is placed by its text's checksum.  Every row gives one row; equal rows
get places of their own.  An empty table gives an empty result and a map of
empty slots.  Other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.llm.tables import settle, whole_text
from curata.session import staging_path

SHARDS = 16
SLOTS = 4096
PIECES = 16


def slotted(docs: DataFrame, slots: int = SLOTS, pieces: int = PIECES) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, piece`` per row."""
    raw = whole_text().cast("binary")
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.crc32(raw))), F.lit(slots * pieces))
    return docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.floor(hashed / pieces).cast("int").alias("virtual_slot"),
        (hashed % pieces).cast("int").alias("piece"),
    )


def balanced(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """The first map: slots in order of falling size, each to the lightest shard so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), shard))
    return out


def rebalanced(old: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """An edited map: slots leave shards above the mean, smallest first, for the lightest shard.

    A slot moves only from above the mean to below it, so a balanced map is
    returned as it is, and after growth only the new shard receives.
    """
    out = dict(old)
    load = {s: 0 for s in range(shards)}
    own: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    for slot, shard in out.items():
        load[shard] += sizes.get(slot, 0)
        own[shard].append((sizes.get(slot, 0), slot))
    for held in own.values():
        held.sort(reverse=True)
    mean = sum(load.values()) / shards
    for shard in sorted(load, key=lambda s: -load[s]):
        # A shard gives only what it holds above the mean, so it never has to get some back.
        while own[shard] and load[shard] - own[shard][-1][0] >= mean:
            size, slot = own[shard].pop()
            to = min(load, key=lambda s: (load[s], s))
            if to == shard or load[to] + size > mean:
                break
            out[slot] = to
            load[shard] -= size
            load[to] += size
    return out


def store_map(spark, version: int, shards: int, table: dict[int, int], path: str) -> None:
    """Write one version of the map beside the others."""
    rows = [(version, shards, slot, shard) for slot, shard in sorted(table.items())]
    frame = spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")
    frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark, version: int, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def slot_sizes(rows: DataFrame) -> dict[int, int]:
    """Bytes per slot; one entry per slot at most."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"))
    return {r["virtual_slot"]: r["size"] for r in sums.collect()}


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """``slotted`` with ``shard`` and ``slot``, the place in the shard; the map is stored at ``path``."""
    spark = docs.sparkSession
    path = path or staging_path(spark, "slot-map")
    rows = settle(slotted(docs, slots), "slotted")
    pieces = rows.groupBy("virtual_slot", "piece").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    sizes: dict[int, int] = {}
    for r in pieces:
        sizes[r["virtual_slot"]] = sizes.get(r["virtual_slot"], 0) + r["size"]
    table = balanced(sizes, shards, slots)
    store_map(spark, 1, shards, table, path)
    before, offsets = {}, []
    for r in sorted(pieces, key=lambda r: (r["virtual_slot"], r["piece"])):
        shard = table[r["virtual_slot"]]
        offsets.append((r["virtual_slot"], r["piece"], before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + r["n"]
    starts = spark.createDataFrame(offsets, "virtual_slot int, piece int, first long")
    shard_of = load_map(spark, 1, path).select("virtual_slot", "shard")
    place = F.row_number().over(
        Window.partitionBy("virtual_slot", "piece").orderBy("doc_id", "text_crc32", "size")
    )
    # Both tables have a fixed number of rows: slots, and slots times pieces.
    return (
        rows.withColumn("_place", place)
        .join(F.broadcast(starts), ["virtual_slot", "piece"])
        .join(F.broadcast(shard_of), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("_place") - 1).alias("slot"), "virtual_slot")
    )


def digest(assigned: DataFrame) -> DataFrame:
    return assigned.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
