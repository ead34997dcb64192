"""Lay entries out in size-targeted shards and index them by byte range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curata.functions.hashing import sort_hash
from curata.functions.text import shard_name
from curata.operators.ordered import prefix_sum
from curata.session import stage

# Entry header and padding block in bytes, default shard target.
BLOCK = 512
TARGET = 256 * 1024 * 1024


def padded_size(size) -> Column:
    """Bytes an entry takes: a header block and its payload in whole blocks."""
    s = F.col(size) if isinstance(size, str) else size
    return (F.lit(BLOCK) + F.ceil(s / F.lit(BLOCK)) * BLOCK).cast("bigint")


def byte_layout(
    df: DataFrame,
    key: str,
    size: str = "size",
    source: str = "source",
    target: int = TARGET,
    seed: int = 0,
    mode: str = "xxhash64",
) -> DataFrame:
    """Shard number and byte offset per entry, computed fully in parallel.

    Entries of a source follow the seeded hash order of their keys.  A shard
    takes the entries that start within its ``target`` stretch of the source's
    byte stream, so shards exceed the target by less than one entry.  Pass keys
    and sizes only and join payloads afterwards.
    """
    placed = prefix_sum(
        df.withColumn("_padded", padded_size(size)), seed, [source], [key], "_padded", "_start", mode=mode
    )
    placed = placed.withColumn("shard_no", F.floor(F.col("_start") / F.lit(target)))
    # An entry takes two blocks at least, so a shard has at most target / 1024 rows.
    shard = W.partitionBy(source, "shard_no")
    return (
        placed.withColumn("offset", F.col("_start") - F.min("_start").over(shard) + BLOCK)
        .withColumn("shard_id", shard_name(source, "shard_no"))
        .drop("_padded", "_start")
    )


def _close_shards(target: int):
    """Per (source, lane): close the open shard once it holds ``target`` bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, shard, used = None, 0, 0
        for batch in batches:
            shards = np.empty(len(batch), dtype=np.int64)
            offsets = np.empty(len(batch), dtype=np.int64)
            lanes = list(zip(batch["_source"], batch["_lane"]))
            for i, (this, padded) in enumerate(zip(lanes, batch["_padded"].to_numpy())):
                if this != lane:
                    lane, shard, used = this, 0, 0
                elif used >= target:
                    shard, used = shard + 1, 0
                shards[i], offsets[i] = shard, used + BLOCK
                used += int(padded)
            yield batch.assign(_lane_shard=shards, offset=offsets)

    return run


def exact_shards(
    df: DataFrame,
    key: str,
    lanes: int,
    size: str = "size",
    source: str = "source",
    target: int = TARGET,
    first_shard: int = 0,
    seed: int = 0,
    mode: str = "xxhash64",
) -> DataFrame:
    """Shards that close as soon as they reach the target, then start from zero.

    The rule depends on all earlier entries, so each (source, lane) is one
    ordered stream over (key, size) only.  A source is dealt to ``lanes`` by
    hash, each with its own open shard; the layout depends on that number and not
    on the size of the data.  Shard numbers count on from ``first_shard`` over
    the lanes of a source.
    """
    hashed = df.select(
        F.col(key).alias("_key"),
        F.col(source).alias("_source"),
        padded_size(size).alias("_padded"),
        sort_hash(seed, key, mode=mode).alias("_hash"),
    )
    number = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint") if mode == "md5" else F.col("_hash")
    hashed = hashed.withColumn("_lane", F.pmod(number, F.lit(lanes)).cast("bigint"))
    columns = "_key, _source, _padded, _hash, _lane, _lane_shard, offset"
    fields = dict(hashed.dtypes) | {"_lane_shard": "bigint", "offset": "bigint"}
    schema = ", ".join(f"{c} {fields[c]}" for c in columns.split(", "))
    placed = (
        hashed.repartition("_source", "_lane")
        .sortWithinPartitions("_source", "_lane", "_hash", "_key")
        .mapInPandas(_close_shards(target), schema)
        .select("_key", "_source", "_lane", "_lane_shard", "offset")
    )
    placed = stage(placed, "shards")
    counts = placed.groupBy("_source", "_lane").agg((F.max("_lane_shard") + 1).alias("_n"))
    before = W.partitionBy("_source").orderBy("_lane").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "_source", "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from")
    )
    numbered = placed.join(starts, ["_source", "_lane"]).select(
        F.col("_key").alias(key),
        F.col("_source").alias(source),
        (F.col("_from") + F.col("_lane_shard") + first_shard).alias("shard_no"),
        "offset",
    )
    return df.join(numbered, [key, source]).withColumn("shard_id", shard_name(source, "shard_no"))


def index_rows(entries: DataFrame, chain_ids: str = "chain_ids") -> DataFrame:
    """One index row per chain; the chains of an entry share its byte range."""
    return entries.withColumn("chain", F.explode(chain_ids)).drop(chain_ids)
