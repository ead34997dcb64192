"""The selection job: index to split, limited, sampled and dealt-out read plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from curata.operators import sampling, select
from curata.schema import CLUSTER_METHODS, check_cluster_column, check_columns
from curata.session import stage


@dataclass(frozen=True)
class SelectConfig:
    cluster_col: str = "foldseek_70"
    split_cols: tuple[str, ...] = ("foldseek_70", "mmseqs_30")
    ratios: tuple[float, float, float] = (0.9, 0.05, 0.05)
    limits: dict[str, tuple[int, int]] = field(default_factory=dict)
    max_resolution: float = 3.5
    min_plddt: float = 0.70
    min_ptm: float = 0.70
    num_workers: int = 8
    seed: int = 42
    gap: int = sampling.GAP
    hash_mode: str = "xxhash64"
    on_conflict: str = "drop"
    methods: tuple[str, ...] | None = CLUSTER_METHODS

    def __post_init__(self):
        for name in (self.cluster_col, *self.split_cols):
            check_cluster_column(name, self.methods)
        if self.cluster_col not in self.split_cols:
            raise ValueError(f"{self.cluster_col!r} must be one of {self.split_cols}")


class Selection:
    """The splits of an index and their epoch plans.

    The split index is written once to the staging folder; every split and
    every epoch reads it from there.
    """

    def __init__(self, index: DataFrame, cfg: SelectConfig = SelectConfig()):
        check_columns(index, [cfg.cluster_col, *cfg.split_cols])
        self.cfg = cfg
        good = select.quality_filter(index, cfg.max_resolution, cfg.min_plddt, cfg.min_ptm)
        split = select.leakage_safe_split(
            good, list(cfg.split_cols), cfg.ratios, mode=cfg.hash_mode, on_conflict=cfg.on_conflict
        )
        order = ["pdb", "chain", "shard_id", "offset"]
        self.index = stage(split, "selection")
        if cfg.limits:
            self.index = stage(select.limit_splits(self.index, cfg.cluster_col, order, cfg.limits), "limited")

    def split(self, name: str) -> DataFrame:
        return self.index.filter(self.index["split"] == name)

    def summary(self) -> DataFrame:
        return select.split_summary(self.index, self.cfg.cluster_col)

    def epoch_plan(self, name: str = select.TRAIN, epoch: int = 0, from_step: int = 0) -> DataFrame:
        """The reads of one epoch of a split; only train draws change with the epoch."""
        plan = sampling.epoch_plan(
            self.split(name),
            self.cfg.cluster_col,
            self.cfg.seed,
            epoch,
            self.cfg.num_workers,
            fixed=name != select.TRAIN,
            gap=self.cfg.gap,
            mode=self.cfg.hash_mode,
        )
        return sampling.resume_plan(plan, from_step) if from_step else plan
