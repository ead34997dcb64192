"""From atom rows to chain records: gates, first-wins choices, atom-14 arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curata.functions import residues as R
from curata.functions.geometry import IDENTITY, compose
from curata.functions.hashing import col
from curata.functions.text import strip_quotes
from curata.operators.ordered import top_per_group

# Accepted experimental methods.
METHODS = ("X-RAY DIFFRACTION", "ELECTRON MICROSCOPY")
MIN_CHAIN = 4


def matched_method(raw, methods=METHODS, override=None) -> Column:
    """The first accepted method named in a raw method text, or null.

    An override replaces the raw method without a check.
    """
    text = strip_quotes(F.coalesce(col(raw), F.lit("")))
    found = F.coalesce(*[F.when(F.contains(text, F.lit(m)), F.lit(m)) for m in methods])
    return found if override is None else F.coalesce(col(override), found)


def method_gate(df: DataFrame, raw: str = "raw_method", methods=METHODS, override=None) -> DataFrame:
    """Keep entries with an accepted method, named in ``method``."""
    return df.withColumn("method", matched_method(raw, methods, override)).filter("method is not null")


def resolution_gate(df: DataFrame, max_resolution: float = 3.5, resolution: str = "resolution") -> DataFrame:
    """Keep entries with a known resolution of at most ``max_resolution``; 0 means unset."""
    r = F.col(resolution)
    return df.filter((r != 0.0) & (r <= max_resolution))


def known_residues(atoms: DataFrame, resname: str = "resname") -> DataFrame:
    return atoms.filter(R.is_known_residue(resname))


def check_min_chain(min_chain_length: int) -> None:
    if min_chain_length < MIN_CHAIN:
        raise ValueError(f"chains need at least {MIN_CHAIN} residues, not {min_chain_length}")


def long_chains(residues: DataFrame, min_chain_length: int = MIN_CHAIN, by=("pdb", "chain")) -> DataFrame:
    """Keep the residues of chains with enough residues (one row per residue)."""
    check_min_chain(min_chain_length)
    keep = residues.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_chain_length)
    return residues.join(keep.select(*by), list(by), "left_semi")


def best_first(df: DataFrame, by, score: str, position) -> DataFrame:
    """The row with the highest score in each group; the first one of equals."""
    position = [position] if isinstance(position, str) else list(position)
    return top_per_group(df, by, [F.col(score).desc(), *position], 1)


def best_residues(atoms: DataFrame, site=("pdb", "chain", "seq_id")) -> DataFrame:
    """Where a site lists several residues, keep the atoms of the best occupied one.

    Candidates are the residue names at a site; the highest mean occupancy
    wins, the first listed of equals.  ``atom_no`` is the order in the file.
    """
    candidates = atoms.groupBy(*site, "resname").agg(
        F.avg("occ").alias("_occ"), F.min("atom_no").alias("_first")
    )
    best = best_first(candidates, list(site), "_occ", "_first")
    return atoms.join(best.select(*site, "resname"), [*site, "resname"], "left_semi")


def best_atoms(atoms: DataFrame, site=("pdb", "chain", "seq_id", "resname")) -> DataFrame:
    """One atom per name at each site: the highest occupancy, the first of equals."""
    return best_first(atoms, [*site, "atom"], "occ", "atom_no")


def residue_arrays(atoms: DataFrame, site=("pdb", "chain", "seq_id", "resname")) -> DataFrame:
    """One row per residue with 14-slot arrays, zero where an atom is missing."""
    slotted = atoms.withColumn("slot", R.atom_slot("resname", "atom"))
    entry = F.struct("slot", "x", "y", "z", "b", "occ")
    rows = slotted.groupBy(*site).agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", entry.alias("a"))))
        ).alias("_m")  # at most 14 entries
    )
    slots = F.sequence(F.lit(0), F.lit(R.SLOTS - 1))
    at = lambda i: F.try_element_at("_m", i)
    zero = F.lit(0.0)
    return rows.select(
        *site,
        R.residue_letter("resname").alias("letter"),
        F.transform(
            slots,
            lambda i: F.array(*[F.coalesce(at(i)[c], zero).cast("float") for c in "xyz"]),
        ).alias("coords"),
        F.transform(slots, lambda i: at(i).isNotNull()).alias("atom_mask"),
        F.transform(slots, lambda i: F.coalesce(at(i)["b"], zero).cast("float")).alias("bfactor"),
        F.transform(slots, lambda i: F.coalesce(at(i)["occ"], zero).cast("float")).alias("occupancy"),
    )


def chain_records(residues: DataFrame, by=("pdb", "chain"), order: str = "seq_id") -> DataFrame:
    """One row per chain: its sequence and per-residue arrays, in residue order.

    A chain is collected whole, because the record holds it whole; its length
    is bounded by the molecule, not by the data set.
    """
    fields = ["letter", "coords", "atom_mask", "bfactor", "occupancy"]
    rows = residues.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("_r"))
    nan = F.lit(float("nan")).cast("float")
    return rows.select(
        *by,
        F.array_join(F.col("_r")["letter"], "").alias("sequence"),
        F.col("_r")["coords"].alias("coords"),
        F.col("_r")["atom_mask"].alias("atom_mask"),
        F.col("_r")["bfactor"].alias("bfactor"),
        F.transform("_r", lambda r: nan).alias("plddt"),
        F.col("_r")["occupancy"].alias("occupancy"),
    )


def resolve_chains(atoms: DataFrame, min_chain_length: int = MIN_CHAIN) -> DataFrame:
    """Atom rows to chain records with one shuffle.

    The same as ``known_residues``, ``best_residues``, ``best_atoms``,
    ``residue_arrays``, ``long_chains`` and ``chain_records`` in turn, for atoms
    that were read from structure files.  A file is one row when it is parsed,
    so its chains are known to fit a task; placing atoms by (pdb, chain) then
    serves every later window and grouping.
    """
    check_min_chain(min_chain_length)
    chain, site = ["pdb", "chain"], ["pdb", "chain", "seq_id"]
    rows = known_residues(atoms).repartition(*chain)
    residue = W.partitionBy(*site, "resname")
    candidate = F.struct(F.avg("occ").over(residue).alias("occ"), (-F.min("atom_no").over(residue)).alias("first"))
    rows = rows.withColumn("_candidate", candidate)
    best = F.max("_candidate").over(W.partitionBy(*site))
    rows = rows.withColumn("_best", best).filter("_candidate = _best").drop("_candidate", "_best")
    order = W.partitionBy(*site, "resname", "atom").orderBy(F.col("occ").desc(), "atom_no")
    rows = rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")
    residues = residue_arrays(rows)
    residues = residues.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*chain)))
    return chain_records(residues.filter(F.col("_n") >= min_chain_length).drop("_n"))


def oper_combinations(expression) -> Column:
    """``"1,2"``, ``"(1-60)"`` or ``"(1,2)(3-5)"`` as an array of operator id lists."""
    groups = F.regexp_extract_all(F.regexp_replace(col(expression), r"[\s'\"]", ""), F.lit(r"[^()]+"), F.lit(0))

    def ids(group):
        def expand(item):
            ends = F.split(item, "-")
            span = F.sequence(ends[0].cast("int"), F.try_element_at(ends, F.lit(2)).cast("int"))
            return F.when(F.size(ends) == 2, F.transform(span, lambda i: i.cast("string"))).otherwise(
                F.array(item)
            )

        return F.flatten(F.transform(F.split(group, ","), expand))

    start = F.array(F.array().cast("array<string>"))
    return F.aggregate(
        groups,
        start,
        lambda acc, g: F.flatten(
            F.transform(acc, lambda head: F.transform(ids(g), lambda i: F.concat(head, F.array(i))))
        ),
    )


def assembly_transforms(generators: DataFrame, operators: DataFrame) -> DataFrame:
    """Row per (pdb, asmb_id, gen_id, copy) with its 16-number row-major matrix.

    ``generators`` has ``oper_expression``; ``operators`` has ``oper_id`` and
    ``matrix``.  A product of operator groups multiplies from left to right.
    """
    copies = generators.select(
        "pdb", "asmb_id", "gen_id", F.posexplode(oper_combinations("oper_expression")).alias("copy", "_ids")
    )
    factors = copies.select("pdb", "asmb_id", "gen_id", "copy", F.posexplode("_ids").alias("_k", "oper_id"))
    factors = factors.join(operators, ["pdb", "oper_id"])
    identity = F.array(*[F.lit(x) for x in IDENTITY])
    product = F.aggregate("_f", identity, lambda acc, f: compose(acc, f["matrix"]))
    return (
        factors.groupBy("pdb", "asmb_id", "gen_id", "copy")
        .agg(F.sort_array(F.collect_list(F.struct("_k", "matrix"))).alias("_f"))
        .select("pdb", "asmb_id", "gen_id", "copy", product.alias("matrix"))
    )


def generator_members(generators: DataFrame, chains: DataFrame) -> DataFrame:
    """Row per (pdb, asmb_id, gen_id, chain) for chains that have data.

    Generators and assemblies left without chains disappear by themselves.
    """
    members = generators.select(
        "pdb", "asmb_id", "gen_id", F.posexplode(F.array_distinct("chains")).alias("chain_no", "chain")
    )
    return members.join(chains.select("pdb", "chain").distinct(), ["pdb", "chain"], "left_semi")


def nest_assemblies(members: DataFrame, transforms: DataFrame) -> DataFrame:
    """The nested form per record: assemblies, each a list of generators.

    Generators whose operators are all unknown keep an empty transform list.
    """
    key = ["pdb", "asmb_id", "gen_id"]
    chains = members.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("chain_no", "chain"))).alias("_c")
    )
    xforms = transforms.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("copy", "matrix"))).alias("_x"))
    square = lambda m: F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice(m, r * 4 + 1, 4).cast("array<float>")
    )
    generator = F.struct(
        F.col("_c")["chain"].alias("chains"),
        F.transform(F.coalesce(F.col("_x"), F.array().cast(xforms.schema["_x"].dataType)), lambda x: square(x["matrix"])).alias(
            "asmb_xforms"
        ),
    )
    per_assembly = (
        chains.join(xforms, key, "left")
        .select(*key, generator.alias("g"))
        .groupBy("pdb", "asmb_id")
        .agg(
            F.min("gen_id").alias("_order"),
            F.sort_array(F.collect_list(F.struct("gen_id", "g"))).alias("_g"),
        )
    )
    return (
        per_assembly.groupBy("pdb")
        .agg(F.sort_array(F.collect_list(F.struct("_order", F.col("_g")["g"].alias("g")))).alias("_a"))
        .select("pdb", F.col("_a")["g"].alias("assemblies"))
    )
