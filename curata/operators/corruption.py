"""Replace a share of labels by noise, the same share and place every time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions.hashing import col, pick, uniform
from curata.functions.noise import SCHEDULES
from curata.functions.residues import CANONICAL, MASK


def corrupt_labels(
    residues: DataFrame,
    seed,
    schedule: str = "linear",
    max_t: int = 10,
    rate: float = 0.0,
    sample: str = "sample_id",
    pos: str = "pos",
    label: str = "label",
    also_mask=None,
    only_mask=None,
    random_label: bool = True,
    compat_inverted: bool = False,
    mode: str = "xxhash64",
) -> DataFrame:
    """Add ``t``, ``is_corrupted`` and ``corrupted_label`` to residue rows.

    Each sample draws a timestep, the schedule turns it into a rate, and each
    residue is hit at that rate; ``also_mask`` adds hits and ``only_mask``
    limits them.  All draws hash (seed, sample, position), so the step is a
    projection without a shuffle.  ``compat_inverted`` replaces the residues
    that were *not* hit, for comparison with runs made that way.
    """
    if schedule not in SCHEDULES:
        raise ValueError(f"unknown schedule {schedule!r}; known: {sorted(SCHEDULES)}")
    also = F.lit(False) if also_mask is None else col(also_mask)
    only = F.lit(True) if only_mask is None else col(only_mask)
    t = pick(max_t, f"{seed}:t", sample, mode=mode)
    hit = uniform(f"{seed}:hit", sample, pos, mode=mode) < SCHEDULES[schedule]("t", max_t, rate)
    noise = pick(CANONICAL, f"{seed}:aa", sample, pos, mode=mode) if random_label else F.lit(MASK)
    replaced = F.col("is_corrupted")
    if compat_inverted and random_label:
        replaced = ~replaced
    return (
        residues.withColumn("t", t)
        .withColumn("is_corrupted", (hit | also) & only)
        .withColumn("corrupted_label", F.when(replaced, noise).otherwise(F.col(label)).cast("int"))
    )
