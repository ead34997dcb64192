"""The sample job: sampled chains to assembled, cropped, packed and collated batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions import residues as R
from curata.operators import assembly, packing, pairs, sampling
from curata.operators.ordered import dense_index
from curata.session import stage


@dataclass(frozen=True)
class SampleConfig:
    min_seq_size: int = 16
    max_seq_size: int = 16_384
    homolog_threshold: float = 0.70
    asymmetric_only: bool = False
    batch_tokens: int = packing.BATCH_TOKENS
    buffer_size: int = packing.BUFFER
    num_workers: int = 8
    seed: int = 42
    construct: str = "backbone"

    def __post_init__(self):
        if self.max_seq_size > self.batch_tokens:
            raise ValueError("a sample of max_seq_size must fit into batch_tokens")


def chain_table(chains: DataFrame) -> DataFrame:
    """``pdb, chain, chain_idx, len`` from chain records; ``chain_idx`` numbers a record's chains."""
    listed = chains.select("pdb", "chain", F.length("sequence").cast("bigint").alias("len"))
    return dense_index(listed, 0, ["chain"], "chain_idx", by=["pdb"])


def residue_table(chains: DataFrame) -> DataFrame:
    """Residue rows from chain records."""
    items = F.arrays_zip(R.sequence_labels("sequence").alias("label"), F.col("coords"), F.col("atom_mask"))
    rows = chains.select("pdb", "chain", F.posexplode(items).alias("pos", "_r"))
    return rows.select("pdb", "chain", "pos", "_r.*")


def build(
    sampled: DataFrame,
    chains: DataFrame,
    members: DataFrame,
    transforms: DataFrame,
    chain_pairs: DataFrame | None = None,
    cfg: SampleConfig = SampleConfig(),
) -> tuple[DataFrame, DataFrame]:
    """Packing plan and residue rows for the sampled index rows.

    The plan has ``batch_id, sample_idx, worker_id, step, sample_id, len``; the
    residue rows are keyed by ``sample_id, idx``.  Batches are planned from
    lengths before residues without a backbone are removed.
    """
    table = chain_table(chains)
    chosen = assembly.choose_assembly(assembly.as_targets(sampled, table), members, cfg.seed)
    parts = stage(assembly.expand_members(chosen, members, table), "sample-chains")
    lengths = stage(
        assembly.sample_lengths(parts, members, transforms, cfg.max_seq_size, cfg.asymmetric_only), "sample-lengths"
    )
    plan = sampling.assign_workers(
        lengths.select("sample_id", F.col("sample_len").alias("len")), ["sample_id"], cfg.seed, cfg.num_workers
    )
    packed = packing.pack_batches(plan, cfg.batch_tokens, cfg.buffer_size)
    cropped = assembly.crop_chains(parts, lengths, cfg.max_seq_size, cfg.seed)
    placed = assembly.place_chains(cropped, members, transforms)
    homologs = None if chain_pairs is None else assembly.homologs(chain_pairs, cfg.homolog_threshold)
    rows = assembly.construct_samples(placed, residue_table(chains), homologs, cfg.min_seq_size, cfg.construct)
    return packed, rows


def homolog_pairs(records: DataFrame, matrix: str = "chain_tm_scores") -> DataFrame:
    """``chain_pairs`` of ``build`` from the score matrices of records."""
    return pairs.matrix_pairs(records, matrix, "chain_ids")


def batches(packed: DataFrame, rows: DataFrame, arrays) -> DataFrame:
    """The batches of ``build``, collated: one row each, with the residue columns ``arrays`` end to end.

    A sample is gathered in the order of its residues; it has ``max_seq_size``
    of them at most, and a batch has its token budget.
    """
    arrays = list(arrays)
    listed = rows.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("idx", *arrays))).alias("_r"))
    samples = listed.select("sample_id", *[F.col("_r")[a].alias(a) for a in arrays])
    return packing.collate(packed, samples, arrays)
