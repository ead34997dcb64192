"""Epoch plans: one row per cluster, coalesced reads, worker shares, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curata.functions.hashing import epoch_seed, sort_hash
from curata.operators.ordered import carry, dense_index, top_per_group
from curata.session import stage

GAP = 64 * 1024
SEGMENT = 1 << 20


def epoch_sample(
    df: DataFrame,
    cluster_col: str,
    keys=("pdb", "chain"),
    base_seed: int = 42,
    epoch: int = 0,
    fixed: bool = False,
    mode: str = "xxhash64",
) -> DataFrame:
    """One whole row per cluster, chosen by a seeded hash of the row keys."""
    seed = epoch_seed(base_seed, epoch, fixed)
    order = [sort_hash(seed, *keys, mode=mode), *keys]
    return top_per_group(df, [cluster_col], order, 1)


def _read_points(df: DataFrame, by, offset: str, size: str) -> DataFrame:
    """One row per (shard, offset): entries at one offset always share a read."""
    return df.groupBy(*by, offset).agg(
        F.max(F.col(offset) + F.col(size)).alias("_end"),
        F.count(F.lit(1)).alias("_entries"),
        F.sum(size).alias("_bytes"),
    )


def _read_starts(df: DataFrame, by, offset: str, size: str, gap: int, segment: int) -> DataFrame:
    """Points with ``byte_start``, the start of the read that each belongs to.

    A point opens a read when it lies more than ``gap`` past the furthest end
    before it.  Offsets are cut into segments, so one window partition holds
    at most ``segment`` distinct offsets; what crosses a segment border is the
    furthest end so far and the last opened read.
    """
    piece = [*by, "_segment"]
    place = F.floor(F.col(offset) / F.lit(segment))
    ends = df.groupBy(*by, place.alias("_segment")).agg(F.max(F.col(offset) + F.col(size)).alias("_segment_end"))
    ends = carry(ends, by, "_segment", F.max("_segment_end"), "_end_before").drop("_segment_end")
    inside = W.partitionBy(*piece).orderBy(offset)
    before = F.greatest(
        F.max("_end").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.col("_end_before")
    )
    opened = F.when(before.isNull() | (F.col(offset) - before > gap), F.col(offset))
    points = _read_points(df, by, offset, size).withColumn("_segment", place)
    points = points.join(ends, piece, "left").withColumn("_opened", opened).drop("_end_before")
    points = points.withColumn(
        "_local_start", F.max("_opened").over(inside.rowsBetween(W.unboundedPreceding, 0))
    )
    points = stage(points, "read-points")  # read twice below
    starts = points.groupBy(*piece).agg(F.max("_opened").alias("_last_opened"))
    starts = carry(starts, by, "_segment", F.max("_last_opened"), "_start_before").drop("_last_opened")
    return (
        points.join(starts, piece, "left")
        .withColumn("byte_start", F.coalesce("_local_start", "_start_before"))
        .drop("_opened", "_local_start", "_start_before", "_segment")
    )


def coalesce_ranges(
    df: DataFrame,
    by=("shard_id",),
    offset: str = "offset",
    size: str = "size",
    gap: int = GAP,
    segment: int = SEGMENT,
) -> DataFrame:
    """Merge byte ranges of a shard whose gap is at most ``gap`` into reads.

    Returns one row per read: ``byte_start``, ``byte_end``, ``n_entries`` and
    ``entry_bytes``.
    """
    by = list(by)
    points = _read_starts(df, by, offset, size, gap, segment)
    return points.groupBy(*by, "byte_start").agg(
        F.max("_end").alias("byte_end"),
        F.sum("_entries").alias("n_entries"),
        F.sum("_bytes").alias("entry_bytes"),
    )


def assign_reads(
    df: DataFrame,
    by=("shard_id",),
    offset: str = "offset",
    size: str = "size",
    gap: int = GAP,
    segment: int = SEGMENT,
) -> DataFrame:
    """Each entry with the ``byte_start`` of its read."""
    by = list(by)
    points = _read_starts(df, by, offset, size, gap, segment)
    return df.join(points.select(*by, offset, "byte_start"), [*by, offset])


def assign_workers(
    df: DataFrame, keys, seed, num_workers: int, digits: int = 3, mode: str = "xxhash64"
) -> DataFrame:
    """Shuffle rows by a seeded hash and deal them to workers in turn.

    Adds ``worker_id`` and ``step``, the position in that worker's order.
    """
    indexed = dense_index(df, seed, keys, "_index", digits=digits, mode=mode)
    return indexed.withColumns(
        {
            "worker_id": F.pmod("_index", F.lit(num_workers)).cast("int"),
            "step": F.floor(F.col("_index") / F.lit(num_workers)),
        }
    ).drop("_index")


def resume_plan(plan: DataFrame, step: int) -> DataFrame:
    """Skip what was done before an interruption; the plan itself is deterministic."""
    return plan.filter(F.col("step") >= step)


def epoch_plan(
    index: DataFrame,
    cluster_col: str,
    base_seed: int = 42,
    epoch: int = 0,
    num_workers: int = 8,
    fixed: bool = False,
    gap: int = GAP,
    mode: str = "xxhash64",
) -> DataFrame:
    """The reads of one epoch: ``worker_id, step, shard_id, byte_start, byte_end, n_entries``."""
    sampled = epoch_sample(
        index, cluster_col, base_seed=base_seed, epoch=epoch, fixed=fixed, mode=mode
    )
    reads = coalesce_ranges(sampled, gap=gap)
    seed = epoch_seed(base_seed, epoch, fixed)
    return assign_workers(reads, ["shard_id", "byte_start"], seed, num_workers, mode=mode)


def read_once(entries: DataFrame, blobs: DataFrame, keys=("pdb", "offset")) -> DataFrame:
    """Attach a blob to every entry that shares it, reading each blob once.

    Entries reduce to distinct keys before the blobs are touched; the blob
    payload is joined back afterwards.
    """
    wanted = entries.select(*keys).distinct()
    needed = blobs.join(wanted, list(keys), "left_semi")
    return entries.join(needed, list(keys))
