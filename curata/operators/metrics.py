"""Masked, grouped and weighted metric reductions over prediction tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import logits as L
from curata.functions import masks as M
from curata.functions.residues import label_name

REDUCTIONS = ("sum", "mean", "max", "min", "last")
INF = float("inf")

# Metric functions by name: each takes the prediction columns and gives a value per token.
METRICS: dict[str, Callable[..., Column]] = {
    "cel": lambda logits="logits", label="label", mask="loss_mask": L.cross_entropy(logits, label, mask),
    "focal_loss": lambda logits="logits", label="label", mask="loss_mask", alpha=1.0, gamma=2.0: (
        L.focal_loss(logits, label, mask, alpha, gamma)
    ),
    "matches": lambda logits="logits", label="label", mask="loss_mask": L.is_match(logits, label),
    "probs": lambda logits="logits", label="label", mask="loss_mask": (
        L.label_probability(logits, label, mask)
    ),
    "identity": lambda x="x", mask="loss_mask": F.col(x).cast("double"),
    "entries": lambda x="logits", mask="loss_mask": F.transform(x, lambda v: v.cast("double")),
}
#: Functions that give an array per token: only their extremes over all entries are reported.
ARRAYS = ("entries",)

MASKS: dict[str, Callable[..., M.MaskGroup]] = {
    "pass_mask": M.pass_mask,
    "per_label_masks": M.per_label_masks,
    "binned_masks": M.binned_masks,
    "timestep_binned_masks": M.timestep_binned_masks,
}


@dataclass(frozen=True)
class Mask:
    fn: str
    kwargs: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.fn not in MASKS:
            raise ValueError(f"unknown mask {self.fn!r}; known: {sorted(MASKS)}")

    def group(self) -> M.MaskGroup:
        return MASKS[self.fn](**self.kwargs)


@dataclass(frozen=True)
class Term:
    """A metric, the reductions to report, and the mask groups to split it by."""

    name: str
    fn: str
    reductions: tuple[str, ...] = ("mean",)
    weight: float = 0.0
    masks: tuple[Mask, ...] = ()
    kwargs: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.fn not in METRICS:
            raise ValueError(f"unknown metric {self.fn!r}; known: {sorted(METRICS)}")
        unknown = set(self.reductions) - set(REDUCTIONS)
        if unknown:
            raise ValueError(f"unknown reductions {sorted(unknown)}")
        if self.fn in ARRAYS and set(self.reductions) - {"max", "min"}:
            raise ValueError(f"{self.fn!r} has a max and a min only")


def sequence_terms(*masks: Mask) -> list[Term]:
    """The usual three terms: weighted cross-entropy, probability, accuracy."""
    return [
        Term("seq_cel", "cel", ("mean", "sum"), 1.0, masks),
        Term("seq_probs", "probs", ("mean",), 0.0, masks),
        Term("seq_acc", "matches", ("mean",), 0.0, masks),
    ]


MAGNITUDES = "magnitudes"


def presets(max_seq_size: int = 1024, max_t: int = 1024) -> dict[str, list[Term]]:
    """Terms by name.  ``combined`` puts several together; ``magnitudes`` has none of its own."""
    per_label, masked = Mask("per_label_masks"), Mask("pass_mask")
    by_length = Mask("binned_masks", {"max_seq_len": max_seq_size, "num_bins": 4})
    by_time = Mask("timestep_binned_masks", {"max_timestep": max_t, "num_bins": 4})
    return {
        "plain": sequence_terms(),
        "per_label": sequence_terms(per_label),
        "seq_len_binned": sequence_terms(by_length),
        "timestep_binned": sequence_terms(by_time),
        "masked": sequence_terms(masked),
        "per_label_seq_len_binned": sequence_terms(per_label, by_length),
        "masked_timestep_binned": sequence_terms(masked, by_time),
        "outliers": [Term("logits", "entries", ("max", "min"))],
        MAGNITUDES: [],
    }


def combined(names: str, **sizes) -> tuple[list[Term], bool]:
    """The terms of presets joined by ``+``, and whether magnitudes are among them."""
    known, parts = presets(**sizes), names.split("+")
    unknown = sorted(set(parts) - set(known))
    if unknown:
        raise ValueError(f"unknown presets {unknown}; known: {sorted(known)}")
    terms = [t for part in parts for t in known[part]]
    if len({t.name for t in terms}) < len(terms):
        raise ValueError(f"presets {names!r} repeat a term")
    return terms, MAGNITUDES in parts


def masked_reduction(value, mask, reduction: str) -> tuple[Column, Column]:
    """Aggregates ``(stored value, count)`` of one reduction over the masked rows.

    An empty maximum is -inf and an empty minimum +inf; only the mean counts
    rows, every other reduction counts as one.
    """
    v, m = F.col(value) if isinstance(value, str) else value, F.col(mask) if isinstance(mask, str) else mask
    inside, one = F.when(m, v), F.lit(1).cast("bigint")
    if reduction in ("sum", "mean"):
        total = F.coalesce(F.sum(inside), F.lit(0.0))
        return total, (F.count_if(m) if reduction == "mean" else one)
    if reduction == "max":
        return F.coalesce(F.max(inside), F.lit(-INF)), one
    if reduction == "min":
        return F.coalesce(F.min(inside), F.lit(INF)), one
    raise ValueError(f"no masked reduction {reduction!r}")


def _stored(term: Term, reduction: str) -> tuple[Column, Column]:
    """``masked_reduction`` read from the partial aggregates of one term."""
    one = F.lit(1).cast("bigint")
    total = F.coalesce(F.col(f"{term.name}__sum"), F.lit(0.0))
    return {
        "sum": (total, one),
        "mean": (total, F.coalesce(F.col("_tokens"), F.lit(0).cast("bigint"))),
        "max": (F.coalesce(F.col(f"{term.name}__max"), F.lit(-INF)), one),
        "min": (F.coalesce(F.col(f"{term.name}__min"), F.lit(INF)), one),
        "last": (F.col(f"{term.name}__last"), one),
    }[reduction]


def batch_metrics(
    predictions: DataFrame,
    terms: list[Term],
    batch: str = "batch_id",
    mask: str = "loss_mask",
    order: str | None = None,
) -> DataFrame:
    """Every term of every batch: ``batch, term, reduction, sub, key, value, n, weight``.

    A token yields one row for the whole mask and one per mask group it is in,
    never one per mask; all terms aggregate in one pass with a partial
    aggregation before the shuffle.  Masks without tokens are filled in, so a
    batch always reports every key.  ``last`` keeps the last value by ``order``.
    """
    groups = {}
    for term in terms:
        for m in term.masks:
            groups[(m.fn, repr(sorted(m.kwargs.items())))] = m.group()
    names = [""] + [n for g in groups.values() for n in g.names]
    member = F.array_compact(F.array(F.lit(""), *[g.member for g in groups.values()]))

    values = {t.name: METRICS[t.fn](**t.kwargs) for t in terms}
    extra = [F.col(order).alias("_order")] if order else []
    tokens = predictions.filter(F.col(mask)).select(
        batch, *extra, F.explode(member).alias("sub"), *[v.alias(k) for k, v in values.items()]
    )
    aggregates = [F.count(F.lit(1)).alias("_tokens")]
    for t in terms:
        used = {"sum" if r == "mean" else r for r in t.reductions}
        for how, agg, entry in (("sum", F.sum, None), ("max", F.max, F.array_max), ("min", F.min, F.array_min)):
            if how in used:
                aggregates.append(agg(entry(t.name) if t.fn in ARRAYS else t.name).alias(f"{t.name}__{how}"))
        if "last" in used:
            if not order:
                raise ValueError("the reduction 'last' needs an order column")
            aggregates.append(F.max_by(t.name, "_order").alias(f"{t.name}__last"))
    stats = tokens.groupBy(batch, "sub").agg(*aggregates)

    every = predictions.select(batch).distinct().withColumn(
        "sub", F.explode(F.array(*[F.lit(n) for n in names]))
    )
    filled = every.join(stats, [batch, "sub"], "left")
    rows = []
    for t in terms:
        subs = [""] + [n for m in t.masks for n in m.group().names]
        wanted = F.col("sub").isin(subs)
        for i, r in enumerate(t.reductions):
            value, n = _stored(t, r)
            weight = F.when((F.col("sub") == "") & F.lit(i == 0), F.lit(float(t.weight))).otherwise(F.lit(0.0))
            rows.append(
                F.when(
                    wanted,
                    F.struct(
                        F.lit(t.name).alias("term"),
                        F.lit(r).alias("reduction"),
                        F.concat_ws("/", F.lit(f"{t.name}/{r}"), F.nullif(F.col("sub"), F.lit(""))).alias("key"),
                        value.alias("value"),
                        n.alias("n"),
                        weight.alias("weight"),
                    ),
                )
            )
    return filled.select(batch, "sub", F.explode(F.array_compact(F.array(*rows))).alias("m")).select(
        batch, "sub", "m.*"
    )


def weighted_total(metrics: DataFrame, batch: str = "batch_id") -> DataFrame:
    """``full_loss`` per batch: the weighted first reduction of each term."""
    scalar = F.when(F.col("reduction") == "mean", F.col("value") / F.greatest(F.lit(1), F.col("n"))).otherwise(
        F.col("value")
    )
    weighted = F.when(F.col("weight") != 0, F.col("weight") * scalar).otherwise(F.lit(0.0))
    return metrics.groupBy(batch).agg(F.sum(weighted).alias("full_loss"))


def with_total(metrics: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The metrics of a batch and its ``full_loss/sum``."""
    total = weighted_total(metrics, batch).select(
        batch,
        F.lit("").alias("sub"),
        F.lit("full_loss").alias("term"),
        F.lit("sum").alias("reduction"),
        F.lit("full_loss/sum").alias("key"),
        F.col("full_loss").alias("value"),
        F.lit(1).cast("bigint").alias("n"),
        F.lit(0.0).alias("weight"),
    )
    return metrics.unionByName(total)


def accumulate(metrics: DataFrame, batch: str = "batch_id", by=()) -> DataFrame:
    """Fold batches into one value per key.

    Sums and means add up and divide by their added counts (so a ``sum`` is the
    average of the per-batch sums); extremes fold; ``last`` takes the last batch.
    """
    r = F.col("reduction")
    return metrics.groupBy(*by, "key", "reduction").agg(
        F.when(r == "max", F.max("value"))
        .when(r == "min", F.min("value"))
        .when(r == "last", F.max_by("value", batch))
        .otherwise(F.sum("value") / F.greatest(F.lit(1), F.sum("n")))
        .alias("value")
    )


def data_metrics(batches: DataFrame, by=()) -> DataFrame:
    """Tokens, loss tokens, samples and batches over batch descriptors."""
    return batches.groupBy(*by).agg(
        F.sum("tokens").alias("tokens"),
        F.sum("loss_tokens").alias("loss_tokens"),
        F.sum("samples").alias("samples"),
        F.count(F.lit(1)).alias("batches"),
    )


def ratio_metrics(data: DataFrame, seconds, accumulation_steps: int = 1, steps=None, keep=()) -> DataFrame:
    """Per-batch, per-sample and per-second ratios, safe against zero."""
    one = F.lit(1)
    merged = F.col("batches") / F.greatest(one, F.lit(accumulation_steps))
    s = F.greatest(F.lit(1e-6), F.lit(seconds) if isinstance(seconds, (int, float)) else F.col(seconds))
    out = {
        "toks_per_batch": F.col("tokens") / F.greatest(one, merged),
        "loss_toks_per_batch": F.col("loss_tokens") / F.greatest(one, merged),
        "loss_toks_per_sample": F.col("loss_tokens") / F.greatest(one, F.col("samples")),
        "loss_toks_pct": F.col("loss_tokens") / F.greatest(one, F.col("tokens")),
        "samples_per_batch": F.col("samples") / F.greatest(one, merged),
        "toks_per_sample": F.col("tokens") / F.greatest(one, F.col("samples")),
        "toks_per_sec": F.col("tokens") / s,
        "fwd_bwd_per_sec": F.col("batches") / s,
        "loss_toks_per_sec": F.col("loss_tokens") / s,
    }
    if steps is not None:
        out["updates_per_sec"] = F.greatest(one, F.lit(steps)) / s
    return data.select(*keep, *[c.alias(n) for n, c in out.items()])


def label_magnitudes(params: DataFrame, label: str = "label", value: str = "mag") -> DataFrame:
    """The mean of a parameter per label, under the label's metric name."""
    means = params.groupBy(label).agg(F.avg(value).alias("value"))
    return means.select(label, label_name(label).alias("name"), "value")
