"""Pack samples of varying length into batches under a token budget."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Default token budget and buffer of samples waiting to be placed.
BATCH_TOKENS = 16_384
BUFFER = 32


def placements(samples: Iterator[tuple], budget: int, buffer_size: int) -> Iterator[tuple]:
    """``(sample, batch, slot)`` for samples ``(length, arrival, ...)`` in order of arrival.

    Whenever the buffer is full, or nothing more arrives, the longest waiting
    sample that still fits the open batch is placed, of equal ones the latest.
    A batch closes when not even the shortest one fits.  A sample over the
    budget opens a batch and fills it alone.
    """
    waiting: list[tuple] = []
    batch, slot, room = 0, 0, budget
    while True:
        waiting += islice(samples, buffer_size - len(waiting))
        if not waiting:
            return
        fitting = [s for s in waiting if s[0] <= room]
        if not fitting:
            # Batch 0 is still empty when all that came first is over the budget.
            batch, slot, room, fitting = batch + (slot > 0), 0, budget, waiting
        chosen = max(fitting, key=itemgetter(0, 1))
        waiting.remove(chosen)
        yield chosen, batch, slot
        slot, room = slot + 1, room - chosen[0]


def _pack(budget: int, buffer_size: int):
    names = ["worker_id", "_lane", "step", "sample_id", "len", "_batch", "sample_idx"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for frame in batches for row in frame[["len", "step", "worker_id", "_lane", "sample_id"]].itertuples(index=False, name=None))
        placed = (
            (worker, lane, step, sample, length, batch, slot)
            for _, own in groupby(rows, key=itemgetter(2, 3))
            for (length, step, worker, lane, sample), batch, slot in placements(own, budget, buffer_size)
        )
        while part := list(islice(placed, 10_000)):
            yield pd.DataFrame(part, columns=names)

    return run


def pack_batches(
    plan: DataFrame, batch_tokens: int = BATCH_TOKENS, buffer_size: int = BUFFER, lane: str | None = None,
    alone: bool = False,
) -> DataFrame:
    """Batch and slot for each sample: ``batch_id, sample_idx`` added to the plan.

    ``plan`` has ``worker_id, step, sample_id, len`` with ``step`` unique per
    worker; samples pass through a buffer in step order.  Only these columns
    flow through Python.  The result depends on the order, so a worker is one
    stream; ``lane`` names an integer column that cuts it into streams with
    batches of their own, at any number of steps.

    A sample longer than the budget fits no batch and is an error; crop first,
    or take ``alone`` to give each of them a batch of its own.
    """
    fits = F.col("len") if alone else F.when(F.col("len") <= batch_tokens, F.col("len")).otherwise(
        F.raise_error(F.concat(F.lit("sample longer than the batch budget: "), F.col("sample_id").cast("string")))
    )
    lanes = plan.select(
        "worker_id",
        (F.col(lane) if lane else F.lit(0)).cast("bigint").alias("_lane"),
        F.col("step").cast("bigint").alias("step"),
        "sample_id",
        fits.cast("bigint").alias("len"),
    )
    types = dict(lanes.dtypes)
    schema = (
        f"worker_id {types['worker_id']}, _lane bigint, step bigint, "
        f"sample_id {types['sample_id']}, len bigint, _batch bigint, sample_idx int"
    )
    packed = (
        lanes.repartition("worker_id", "_lane")
        .sortWithinPartitions("worker_id", "_lane", "step")
        .mapInPandas(_pack(batch_tokens, buffer_size), schema)
    )
    batch_id = F.concat_ws("/", "worker_id", "_lane", "_batch")
    return packed.withColumn("batch_id", batch_id).drop("_lane", "_batch")


def prefix_lengths(packed: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Add ``cu_start`` and ``cu_end``, the token range of a sample in its batch.

    A window per batch is bounded by the token budget.
    """
    w = W.partitionBy(batch).orderBy("sample_idx").rowsBetween(W.unboundedPreceding, 0)
    return packed.withColumn("cu_end", F.sum("len").over(w)).withColumn(
        "cu_start", F.col("cu_end") - F.col("len")
    )


def batch_summary(samples: DataFrame, batch: str = "batch_id", loss_tokens: str | None = None) -> DataFrame:
    """Longest sample, samples, tokens and loss tokens per batch."""
    loss = F.sum(loss_tokens) if loss_tokens else F.sum("len")
    return samples.groupBy(batch).agg(
        F.max("len").alias("max_seqlen"),
        F.count(F.lit(1)).alias("samples"),
        F.sum("len").alias("tokens"),
        loss.alias("loss_tokens"),
    )


def collate(packed: DataFrame, samples: DataFrame, arrays, batch: str = "batch_id") -> DataFrame:
    """One row per batch: the sample arrays joined end to end, with ``cu_seqlens``.

    ``samples`` has ``sample_id`` and array columns of equal length per sample;
    samples that failed construction are absent or empty and are left out, the
    rest are renumbered.  A batch without samples gives no row.  A batch is at
    most the token budget long.
    """
    joined = packed.select(batch, "sample_idx", "sample_id").join(samples, "sample_id")
    joined = joined.filter(F.size(arrays[0]) > 0)
    rows = joined.groupBy(batch).agg(
        F.sort_array(F.collect_list(F.struct("sample_idx", "sample_id", *arrays))).alias("_s")
    )
    lens = F.transform("_s", lambda s: F.size(s[arrays[0]]))
    ends = joined.select(batch, "sample_idx", F.size(arrays[0]).alias("len"))
    offsets = prefix_lengths(ends, batch).groupBy(batch).agg(F.sort_array(F.collect_list("cu_end")).alias("_ends"))
    starts = F.concat(F.array(F.lit(0)), F.transform("_ends", lambda e: e.cast("int")))
    index = F.flatten(F.transform("_s", lambda s, i: F.array_repeat(i, F.size(s[arrays[0]]))))
    return rows.join(offsets, batch).select(
        batch,
        *[F.flatten(F.col("_s")[a]).alias(a) for a in arrays],
        index.alias("sample_idx"),
        starts.alias("cu_seqlens"),
        F.array_max(lens).alias("max_seqlen"),
        F.size("_s").alias("samples"),
        F.col("_s")["sample_id"].alias("sample_ids"),
    )
