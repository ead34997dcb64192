"""Write indexes, shards, records, text exports and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.residues import RESIDUES
from curata.functions.text import chain_key

# Compression level of records, atoms and columns of the backbone export.
ZSTD_LEVEL = 10
BACKBONE = ("N", "CA", "C", "O", "CB")
ATOM_COLUMNS = """
group_PDB
id
type_symbol
label_atom_id
label_alt_id
label_comp_id
label_asym_id
label_entity_id
label_seq_id
Cartn_x
Cartn_y
Cartn_z
occupancy
B_iso_or_equiv
auth_seq_id
auth_asym_id
pdbx_PDB_model_num
"""


def write_index(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The chain index as Parquet."""
    df.write.mode(mode).parquet(path)


def write_records(df: DataFrame, path: str, partition_by=(), level: int = ZSTD_LEVEL, mode: str = "overwrite") -> None:
    """Nested records as zstd Parquet; reading them back gives the same rows."""
    writer = df.write.mode(mode).option("compression", "zstd")
    writer = writer.option("parquet.compression.codec.zstd.level", str(level))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_shards(
    records: DataFrame, path: str, source: str = "source", shard: str = "shard_no", order=(), level: int = ZSTD_LEVEL,
    together: int = 1,
) -> None:
    """One folder per source and shard, each written by one task.

    The layout step has bounded the bytes of a shard, so this holds for hot
    sources too; a source is spread over its shards.

    A file costs the same whatever it holds.  Of small shards, ``together``
    neighbours of a source share a folder ``shards=<first of them>``; there
    ``shard`` is a column of the file, whose rows stand shard by shard.
    """
    if together < 1:
        raise ValueError("a folder holds one shard at least")
    folder = shard
    if together > 1:
        folder = "shards"
        records = records.withColumn(folder, F.col(shard) - F.pmod(F.col(shard), F.lit(together)))
    placed = records.repartition(source, folder)
    if order or together > 1:
        placed = placed.sortWithinPartitions(source, folder, *([shard] if together > 1 else []), *order)
    write_records(placed, path, [source, folder], level)


def append_checkpoint(rows: DataFrame, path: str) -> None:
    """Index rows as JSON lines.  Call after the shards they describe are written."""
    rows.write.mode("append").json(path)


def fasta_text(pdb="pdb", chain="chain", sequence="sequence") -> Column:
    return F.concat(F.lit(">"), chain_key(pdb, chain), F.lit("\n"), F.col(sequence))


def write_fasta(chains: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One FASTA entry per chain."""
    chains.select(fasta_text().alias("value")).write.mode(mode).text(path)


def backbone_cif(atoms: DataFrame, by=("pdb", "chain"), keep=()) -> DataFrame:
    """One row per chain with the text of its backbone atoms as ``value``.

    ``atoms`` has one row per atom: ``seq_no`` (residue number from 1),
    ``slot``, ``resname``, ``atom``, ``x``, ``y``, ``z`` and ``b``.  The atoms
    of a chain are collected, as its file holds them all.
    """
    picked = atoms.filter(F.col("atom").isin(*BACKBONE))
    rows = picked.groupBy(*by, *keep).agg(
        F.sort_array(F.collect_list(F.struct("seq_no", "slot", "resname", "atom", "x", "y", "z", "b"))).alias("_a")
    )
    return rows.select(*by, *keep, _cif_text(F.col("_a")).alias("value"))


def _cif_text(atoms: Column) -> Column:
    """The atom loop of one chain from its atoms in order."""
    chain = F.col("chain").cast("string")
    line = lambda a, i: F.format_string(
        "ATOM %d %s %s . %s %s 1 %d %.3f %.3f %.3f 1.00 %.2f %d %s 1",
        i + 1,
        F.substring(a["atom"], 1, 1),
        a["atom"],
        a["resname"],
        chain,
        a["seq_no"],
        a["x"],
        a["y"],
        a["z"],
        a["b"],
        a["seq_no"],
        chain,
    )
    head = "\n".join(["loop_"] + [f"_atom_site.{c}" for c in ATOM_COLUMNS.split()])
    return F.concat_ws(
        "\n", F.concat(F.lit("data_"), chain), F.lit(head), F.array_join(F.transform(atoms, line), "\n"), F.lit("")
    )


def chain_cif(chains: DataFrame) -> DataFrame:
    """``pdb, chain, value``: the backbone text of each chain record, built inside its row."""
    names = F.create_map(*[F.lit(x) for name, one, _ in RESIDUES for x in (one, name)])
    atom_names = F.array(*[F.lit(a) for a in BACKBONE])
    slots = F.sequence(F.lit(0), F.lit(len(BACKBONE) - 1))

    def residue(xyz, i):
        letter = F.substring(F.col("sequence"), i + 1, F.lit(1))
        atom = lambda s: F.struct(
            (i + 1).alias("seq_no"),
            F.get(atom_names, s).alias("atom"),
            F.try_element_at(names, letter).alias("resname"),
            *[xyz[s][k].cast("double").alias(c) for k, c in enumerate("xyz")],
            F.get(F.get("bfactor", i), s).cast("double").alias("b"),
            F.get(F.get("atom_mask", i), s).alias("present"),
        )
        return F.transform(slots, atom)

    atoms = F.filter(F.flatten(F.transform("coords", residue)), lambda a: a["present"])
    return chains.select("pdb", "chain", _cif_text(atoms).alias("value"))


def write_backbone_cif(texts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Gzipped text, one file per chain under ``pdb=…/chain=…``, as structure tools expect."""
    writer = texts.select("pdb", "chain", "value").write.mode(mode).option("compression", "gzip")
    writer.partitionBy("pdb", "chain").text(path)


def write_cif_bundles(texts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Gzipped text with many chains in a file, each a data block that names its entry; an empty line ends it.

    A file for each chain (``write_backbone_cif``) costs far more than its few
    atoms; here there are as many files as partitions.
    """
    rest = F.substring(F.col("value"), F.instr("value", "\n"), F.length("value"))
    block = F.concat(
        F.lit("data_"), chain_key("pdb", "chain"), F.lit("\n_entry.id "), F.col("pdb").cast("string"), F.lit("\n#"), rest
    )
    texts.select(block.alias("value")).write.mode(mode).option("compression", "gzip").text(path)


def log_metrics(metrics: DataFrame, path: str, step: int, split: str) -> None:
    """Append ``step, split, key, value`` to the metric table."""
    metrics.select(
        F.lit(step).cast("bigint").alias("step"), F.lit(split).alias("split"), "key", "value"
    ).write.mode("append").parquet(path)


def log_stages(timings: DataFrame, path: str) -> None:
    """Append stage timings as JSON lines, rounded as in the stage log."""
    rounded = timings.select(
        "pdb_id",
        F.round("wall", 3).alias("wall"),
        *[F.round(c, 4).alias(c) for c in ("fetch", "cpu_wait", "write_lock_wait", "write", "total")],
        *[F.round(c, 1).alias(c) for c in ("raw_kb", "blob_kb")],
        "is_pdb_redo",
    )
    rounded.write.mode("append").json(path)
