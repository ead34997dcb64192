"""Per-token values from an array of logits and a label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions.hashing import col


def _log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))
    return F.ln(total) + top


def _safe_label(label, mask) -> Column:
    """Tokens outside the mask may carry labels that have no logit."""
    return F.when(col(mask), col(label)).otherwise(F.lit(0))


def cross_entropy(logits, label, mask=None) -> Column:
    at = col(label) if mask is None else _safe_label(label, mask)
    return _log_sum_exp(col(logits)) - F.get(col(logits), at).cast("double")


def focal_loss(logits, label, mask=None, alpha: float = 1.0, gamma: float = 2.0) -> Column:
    ce = cross_entropy(logits, label, mask)
    return alpha * F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce


def is_match(logits, label) -> Column:
    """1.0 when the first largest logit sits at the label."""
    best = F.array_position(col(logits), F.array_max(col(logits))) - 1
    return (best == col(label)).cast("double")


def label_probability(logits, label, mask=None) -> Column:
    return F.exp(-cross_entropy(logits, label, mask))
