"""Named token masks.

Each builder gives the names a mask group can take and a column that holds the
name of the mask a token belongs to, or null.  A token is in at most one mask
of a group, so a group costs one column, not one column per mask.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions.hashing import col
from curata.functions.residues import label_name, label_names


@dataclass(frozen=True)
class MaskGroup:
    names: list[str]
    member: Column


def pass_mask(flag="is_masked", name: str = "masked") -> MaskGroup:
    """The tokens that also carry a flag."""
    return MaskGroup([name], F.when(col(flag), F.lit(name)))


def per_label_masks(label="label", n_labels: int = 20) -> MaskGroup:
    """One mask per label."""
    inside = col(label).between(0, n_labels - 1)
    return MaskGroup(label_names(n_labels), F.when(inside, label_name(label)))


def _equal_width(value, top: float, bins: int, prefix: str) -> MaskGroup:
    edges = [top * i / bins for i in range(bins + 1)]
    names = [f"{prefix}{int(lo)}-{int(hi)}" for lo, hi in zip(edges, edges[1:])]
    v = col(value)
    member = F.lit(None).cast("string")
    for name, lo, hi in zip(names, edges, edges[1:]):
        member = F.coalesce(member, F.when((v >= lo) & (v < hi), F.lit(name)))
    return MaskGroup(names, member)


def binned_masks(length="seq_len", max_seq_len: float = 1024, num_bins: int = 2) -> MaskGroup:
    """Equal-width bins of sequence length; a length at or past the top is in none."""
    return _equal_width(length, max_seq_len, num_bins, "")


def timestep_binned_masks(timestep="timestep", max_timestep: float = 1024, num_bins: int = 4) -> MaskGroup:
    """Equal-width bins of the noise timestep."""
    return _equal_width(timestep, max_timestep, num_bins, "t")
