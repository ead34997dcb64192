"""Ordered computations that never put one whole group into one task.

A plain ``Window.partitionBy(group)`` sorts a group in a single task, so a
group with a third of all rows stalls the job.  The helpers here cut a group
into ordered pieces of bounded size, compute inside the pieces, and carry one
summary row per piece across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curata.functions.hashing import col, sort_hash
from curata.session import stage

# Spark limits each group before the shuffle when the wanted rank is at most
# spark.sql.optimizer.windowGroupLimitThreshold (default 1000).
GROUP_LIMIT = 1000
SALTS = 256
#: Rows of a range that one task orders.
PIECE_ROWS = 100_000


def _ranked(df: DataFrame, by, order, k: int, rank: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def top_per_group(df: DataFrame, by, order, k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; ``order`` must be a total order.

    Up to ``GROUP_LIMIT`` Spark itself drops surplus rows before the shuffle.
    Beyond it, groups are first cut by salt, so that one hot group is ranked
    in many tasks and only ``k`` rows per salt go on.
    """
    by = [col(c) for c in by]
    name = rank or "_rank"
    if k > GROUP_LIMIT:
        plain = [c for c, t in df.dtypes if "map<" not in t]
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)))
        df = _ranked(salted, [*by, F.col("_salt")], order, k, "_pre").drop("_salt", "_pre")
    out = _ranked(df, by, order, k, name)
    return out if rank else out.drop(name)


def attach_by_key(df: DataFrame, small: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join one summary row per key; skewed keys are split at run time by AQE."""
    return df.join(small, list(keys), how)


def carry(pieces: DataFrame, by, piece, expr: Column, name: str) -> DataFrame:
    """``expr`` aggregated over all earlier pieces of the same group."""
    w = W.partitionBy(*by).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    return pieces.withColumn(name, expr.over(w))


def running_total(df: DataFrame, by, axis: str, value: str, out: str, width: int) -> DataFrame:
    """Inclusive running sum along an integer axis, one row per (group, axis).

    The axis is cut into segments of ``width`` units, so a task never holds
    more than ``width`` rows of a group, and one row per segment is carried.
    """
    by = list(by)
    df = df.withColumn("_segment", F.floor(F.col(axis) / F.lit(width)))
    totals = df.groupBy(*by, "_segment").agg(F.sum(value).alias("_segment_sum"))
    carried = carry(totals, by, "_segment", F.sum("_segment_sum"), "_carried").drop("_segment_sum")
    local = W.partitionBy(*by, "_segment").orderBy(axis).rowsBetween(W.unboundedPreceding, 0)
    return (
        attach_by_key(df, carried, [*by, "_segment"])
        .withColumn(out, F.sum(value).over(local) + F.coalesce("_carried", F.lit(0)))
        .drop("_segment", "_carried")
    )


def in_pieces(df: DataFrame, order, rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``_piece``: numbers of ranges of about ``rows`` rows in this order, whatever the values are.

    Written once, so every reader sees the same pieces.  Rows that are equal
    in all of ``order`` may fall to neighbouring pieces.
    """
    pieces = df.count() // rows + 1
    ranged = df.repartitionByRange(pieces, *order).withColumn("_piece", F.spark_partition_id())
    return stage(ranged, "pieces")


def previous_value(df: DataFrame, by, axis: str, tie, value: str, out: str, rows: int = PIECE_ROWS) -> DataFrame:
    """``lag(value)`` per group ordered by (axis, tie).

    Rows are cut into ranges bounded by their number, so a group, or one value
    of the axis, with a third of all rows is many tasks; the last row of each
    group in a range is carried to the next range that has the group.
    """
    by, tie = list(by), list(tie)
    df = in_pieces(df, [*by, axis, *tie], rows)
    last = df.groupBy(*by, "_piece").agg(
        F.max(F.struct(axis, *tie, F.col(value).alias("_last"))).alias("_end")
    )
    previous = last.withColumn(
        "_carried", F.lag("_end._last").over(W.partitionBy(*by).orderBy("_piece"))
    ).drop("_end")
    local = W.partitionBy(*by, "_piece").orderBy(axis, *tie)
    return (
        attach_by_key(df, previous, [*by, "_piece"])
        .withColumn("_row", F.row_number().over(local))
        .withColumn(out, F.when(F.col("_row") == 1, F.col("_carried")).otherwise(F.lag(value).over(local)))
        .drop("_piece", "_carried", "_row")
    )


def hash_order(df: DataFrame, seed, keys, digits: int = 3, mode: str = "xxhash64") -> DataFrame:
    """Add ``_hash`` and its leading hex digits ``_piece``: a seeded order whose
    pieces have equal expected size whatever the keys are."""
    hashed = df.withColumn("_hash", sort_hash(seed, *keys, mode=mode))
    if mode == "md5":
        return hashed.withColumn("_piece", F.substring("_hash", 1, digits))
    return hashed.withColumn("_piece", F.shiftrightunsigned("_hash", 64 - 4 * digits))


def dense_index(
    df: DataFrame, seed, keys, out: str, by=(), digits: int = 3, mode: str = "xxhash64"
) -> DataFrame:
    """Position 0, 1, 2, … of each row in the seeded hash order of its keys.

    Only the piece counts (at most ``16 ** digits`` per group) meet in one
    window; rows are numbered inside their piece.
    """
    by, keys = list(by), list(keys)
    df = hash_order(df, seed, keys, digits, mode)
    counts = df.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    starts = carry(counts, by, "_piece", F.sum("_n"), "_before").drop("_n")
    local = W.partitionBy(*by, "_piece").orderBy("_hash", *keys)
    return (
        attach_by_key(df, starts, [*by, "_piece"])
        .withColumn(out, F.coalesce("_before", F.lit(0)) + F.row_number().over(local) - 1)
        .drop("_hash", "_piece", "_before")
    )


def prefix_sum(
    df: DataFrame, seed, by, keys, value: str, out: str, digits: int = 3, mode: str = "xxhash64"
) -> DataFrame:
    """Exclusive prefix sum of ``value`` per group in the seeded hash order of the keys."""
    by, keys = list(by), list(keys)
    df = hash_order(df, seed, keys, digits, mode)
    totals = df.groupBy(*by, "_piece").agg(F.sum(value).alias("_total"))
    starts = carry(totals, by, "_piece", F.sum("_total"), "_before").drop("_total")
    local = (
        W.partitionBy(*by, "_piece").orderBy("_hash", *keys).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        attach_by_key(df, starts, [*by, "_piece"])
        .withColumn(
            out, F.coalesce("_before", F.lit(0)) + F.coalesce(F.sum(value).over(local), F.lit(0))
        )
        .drop("_hash", "_piece", "_before")
    )
