"""Choose an assembly per target chain, crop it, and build residue samples.

Everything is long-form: ``chains`` (pdb, chain, chain_idx, len), ``members``
(pdb, asmb_id, gen_id, chain), ``transforms`` (pdb, asmb_id, gen_id, copy,
matrix), ``residues`` (pdb, chain, pos, label, coords, atom_mask).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curata.functions import geometry as G
from curata.functions.hashing import sort_hash
from curata.functions.residues import CANONICAL
from curata.functions.text import chain_key
from curata.operators.ordered import top_per_group


def as_targets(df: DataFrame, chains: DataFrame) -> DataFrame:
    """``sample_id, pdb, target`` for index rows whose chain has data."""
    known = chains.select("pdb", F.col("chain").alias("target"))
    targets = df.select(chain_key().alias("sample_id"), "pdb", F.col("chain").alias("target"))
    return targets.join(known, ["pdb", "target"], "left_semi")


def choose_assembly(targets: DataFrame, members: DataFrame, seed, mode: str = "xxhash64") -> DataFrame:
    """Add ``asmb_id``: a seeded choice among the assemblies that list the target.

    Null when no assembly does; the chain then stands alone.
    """
    options = members.select("pdb", "asmb_id", F.col("chain").alias("target")).distinct()
    joined = targets.join(options, ["pdb", "target"], "left")
    order = [sort_hash(seed, "sample_id", "asmb_id", mode=mode), "asmb_id"]
    return top_per_group(joined, ["sample_id"], order, 1)


def expand_members(chosen: DataFrame, members: DataFrame, chains: DataFrame) -> DataFrame:
    """The chains of each sample that have data, with ``chain_idx`` and ``len``."""
    listed = members.select("pdb", "asmb_id", "chain").distinct()
    wide = chosen.join(listed, ["pdb", "asmb_id"], "left").withColumn(
        "chain", F.coalesce("chain", "target")
    )
    return wide.join(chains.select("pdb", "chain", "chain_idx", "len"), ["pdb", "chain"])


def sample_lengths(
    sample_chains: DataFrame,
    members: DataFrame,
    transforms: DataFrame,
    max_seq_size: int,
    asymmetric_only: bool = False,
) -> DataFrame:
    """``sample_id, full_len, expanded_len, keep_assembly, sample_len`` per sample.

    ``expanded_len`` counts every copy of every generator.  When it exceeds the
    maximum the sample falls back to its plain chains, cut at the maximum.
    """
    copies = transforms.groupBy("pdb", "asmb_id", "gen_id").agg(F.count(F.lit(1)).alias("_copies"))
    per_chain = (
        members.join(copies, ["pdb", "asmb_id", "gen_id"], "left")
        .groupBy("pdb", "asmb_id", "chain")
        .agg(F.sum(F.coalesce("_copies", F.lit(0))).alias("_copies"))
    )
    joined = sample_chains.join(per_chain, ["pdb", "asmb_id", "chain"], "left")
    lengths = joined.groupBy("sample_id").agg(
        F.sum("len").alias("full_len"),
        F.max(F.col("_copies").isNotNull()).alias("_has_assembly"),
        F.sum(F.col("len") * F.coalesce("_copies", F.lit(0))).alias("_expanded"),
    )
    use = F.col("_has_assembly") & F.lit(not asymmetric_only)
    expanded = F.when(use, F.col("_expanded")).otherwise(F.col("full_len"))
    fits = F.col("expanded_len") <= max_seq_size
    return (
        lengths.withColumn("expanded_len", expanded)
        .withColumn("keep_assembly", use & fits)
        .withColumn(
            "sample_len",
            F.when(fits, F.col("expanded_len")).otherwise(F.least(F.col("full_len"), F.lit(max_seq_size))),
        )
        .drop("_has_assembly", "_expanded")
    )


def crop_chains(
    sample_chains: DataFrame, lengths: DataFrame, max_seq_size: int, seed, mode: str = "xxhash64"
) -> DataFrame:
    """Add ``chain_no`` (target first, the others shuffled) and ``used`` residues.

    Samples that fit keep whole chains; others are cut from the front of the
    chain order.  Chains are not empty, so at most ``max_seq_size`` of them can
    contribute; the rest are dropped before the running sum.
    """
    joined = sample_chains.join(
        lengths.select("sample_id", "expanded_len", "keep_assembly"), "sample_id"
    ).filter("len > 0")
    order = [F.col("chain") != F.col("target"), sort_hash(seed, "sample_id", "chain", mode=mode), "chain"]
    ranked = top_per_group(joined, ["sample_id"], order, max_seq_size, rank="chain_no")
    before = W.partitionBy("sample_id").orderBy("chain_no").rowsBetween(W.unboundedPreceding, -1)
    room = F.lit(max_seq_size) - F.coalesce(F.sum("len").over(before), F.lit(0))
    fits = F.col("expanded_len") <= max_seq_size
    used = F.when(fits, F.col("len")).otherwise(F.least(F.col("len"), F.greatest(room, F.lit(0))))
    return ranked.withColumn("used", used).filter("used > 0").drop("expanded_len")


def homologs(chain_pairs: DataFrame, threshold: float = 0.70) -> DataFrame:
    """``pdb, target, chain`` for pairs that score at least ``threshold``.

    ``chain_pairs`` is long and directed: ``pdb, chain_a, chain_b, score``.
    """
    return chain_pairs.filter(F.col("score") >= threshold).select(
        "pdb", F.col("chain_a").alias("target"), F.col("chain_b").alias("chain")
    ).distinct()


def homolog_sets(targets: DataFrame, chain_pairs: DataFrame, threshold: float = 0.70) -> DataFrame:
    """The homologs of each target as a set; a target without scores has itself."""
    found = homologs(chain_pairs, threshold).groupBy("pdb", "target").agg(F.collect_set("chain").alias("_set"))
    own = F.array("target")
    return targets.join(found, ["pdb", "target"], "left").withColumn(
        "homologs", F.sort_array(F.array_union(own, F.coalesce("_set", own)))
    ).drop("_set")


def place_chains(sample_chains: DataFrame, members: DataFrame, transforms: DataFrame) -> DataFrame:
    """One row per placed copy of a chain: ``gen_id, copy, matrix`` added."""
    kept = (
        sample_chains.filter("keep_assembly")
        .join(members.select("pdb", "asmb_id", "gen_id", "chain"), ["pdb", "asmb_id", "chain"])
        .join(transforms, ["pdb", "asmb_id", "gen_id"])
    )
    gen_type, copy_type = dict(kept.dtypes)["gen_id"], dict(kept.dtypes)["copy"]
    plain = sample_chains.filter("not keep_assembly").withColumns(
        {
            "gen_id": F.lit(0).cast(gen_type),
            "copy": F.lit(0).cast(copy_type),
            "matrix": G.identity(),
        }
    )
    return kept.unionByName(plain)


def backbone_present(residues: DataFrame, atom_mask: str = "atom_mask") -> DataFrame:
    """Keep residues that have N, CA and C."""
    return residues.filter(F.forall(F.slice(atom_mask, 1, 3), lambda x: x))


def backbone_inputs(rows: DataFrame) -> DataFrame:
    """CA position, unit CA→CB vector, and the two training masks."""
    atoms = [G.point(F.col("coords")[i]) for i in range(3)]
    return rows.select(
        "sample_id",
        "idx",
        "chain_idx",
        "seq_idx",
        "label",
        G.pack(atoms[1]).alias("coords_ca"),
        G.pack(G.cb_direction(*atoms)).alias("coords_cb_unit"),
        (F.col("homo_mask") & ~F.col("trgt_mask")).alias("seq_mask"),
        (F.col("caa_mask") & F.col("trgt_mask")).alias("loss_mask"),
    )


# Construct functions by name; each turns placed residues into model inputs.
CONSTRUCTS: dict[str, Callable[[DataFrame], DataFrame]] = {"backbone": backbone_inputs}


def construct_samples(
    placed: DataFrame,
    residues: DataFrame,
    homolog_pairs: DataFrame | None = None,
    min_seq_size: int = 0,
    construct: str | Callable[[DataFrame], DataFrame] = "backbone",
) -> DataFrame:
    """Residue rows of every sample, expanded, masked and numbered by ``idx``.

    Copies run outside chains, chains outside residues.  Only the backbone
    atoms are carried, as no construct function reads more.  A sample is at
    most the crop size, so numbering it in one window is bounded.

    Residues are often exploded from a small file, whose size Spark takes for
    theirs; so their join is named, and they are never sent to every executor.
    """
    build = CONSTRUCTS[construct] if isinstance(construct, str) else construct
    valid = backbone_present(residues).select(
        "pdb", "chain", "pos", "label", F.slice(G.zero_nan("coords"), 1, 3).alias("coords")
    )
    # Homologs join the placed chains, so residues are shuffled for one join only.
    if homolog_pairs is not None:
        marked = homolog_pairs.withColumn("_homolog", F.lit(True))
        placed = placed.join(marked, ["pdb", "target", "chain"], "left")
    else:
        placed = placed.withColumn("_homolog", F.lit(None).cast("boolean"))
    rows = placed.join(valid.hint("merge"), ["pdb", "chain"]).filter(F.col("pos") < F.col("used"))
    is_target = F.col("chain") == F.col("target")
    rows = rows.select(
        "sample_id",
        "gen_id",
        "copy",
        "chain_no",
        "chain_idx",
        F.col("pos").alias("seq_idx"),
        "label",
        G.transform_atoms("matrix", "coords").alias("coords"),
        is_target.alias("trgt_mask"),
        (is_target | F.coalesce("_homolog", F.lit(False))).alias("homo_mask"),
        (F.col("label") < CANONICAL).alias("caa_mask"),
    )
    w = W.partitionBy("sample_id")
    ordered = w.orderBy("gen_id", "copy", "chain_no", "seq_idx")
    rows = rows.withColumns(
        {"idx": F.row_number().over(ordered) - 1, "_size": F.count(F.lit(1)).over(w)}
    )
    return rows.filter(F.col("_size") >= min_seq_size).drop("_size").transform(build)
