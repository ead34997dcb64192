"""The evaluation job: predictions to accumulated metrics and ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.operators import metrics as M


def evaluate(
    predictions: DataFrame, preset: str | list[M.Term] = "plain", batch: str = "batch_id", order=None, magnitudes: DataFrame | None = None
) -> DataFrame:
    """One value per metric key over all batches, ``full_loss/sum`` included.

    ``preset`` may join several by ``+``.  With ``magnitudes`` among them the
    table of that name (``label, mag``) gives one more key for each label.
    """
    terms, wanted = M.combined(preset) if isinstance(preset, str) else (preset, False)
    found = M.accumulate(M.with_total(M.batch_metrics(predictions, terms, batch, order=order), batch), batch)
    if not wanted:
        return found
    if magnitudes is None:
        raise ValueError(f"the preset {preset!r} needs a table of magnitudes")
    rows = M.label_magnitudes(magnitudes)
    key = F.concat(F.lit("label_magnitudes/last/"), "name")
    return found.unionByName(rows.select(key.alias("key"), F.lit("last").alias("reduction"), "value"))


def step_metrics(accumulated: DataFrame, batches: DataFrame, seconds: float, prefix: str, accumulation_steps: int = 1, steps=None) -> DataFrame:
    """Loss, data and throughput metrics of a period as ``key, value`` rows."""
    losses = accumulated.select(F.concat(F.lit(f"{prefix}/loss/"), "key").alias("key"), "value")
    ratios = M.ratio_metrics(M.data_metrics(batches), seconds, accumulation_steps, steps)
    per_second = lambda c: "throughput" if c.endswith("_per_sec") else "data"
    pairs = [
        F.struct(F.lit(f"{prefix}/{per_second(c)}/{c}").alias("key"), F.col(c).cast("double").alias("value"))
        for c in ratios.columns
    ]
    return losses.unionByName(ratios.select(F.explode(F.array(*pairs)).alias("m")).select("m.*"))
