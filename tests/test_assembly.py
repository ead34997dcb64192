"""Samples from assemblies."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import assembly as A


def test_residues_are_not_broadcast(spark, tmp_path):
    """A small file explodes to many residues; Spark takes the file's size for theirs."""
    spark.createDataFrame([("p", "A", "x" * 50)], "pdb string, chain string, text string").write.parquet(f"{tmp_path}/chains")
    chains = spark.read.parquet(f"{tmp_path}/chains")
    rows = chains.select("pdb", "chain", F.posexplode(F.split("text", "")).alias("pos", "letter"))
    atom = F.array(*[F.lit(1.0).cast("float")] * 3)
    residues = rows.select(
        "pdb", "chain", "pos", F.lit(3).alias("label"), F.array(atom, atom, atom).alias("coords"),
        F.array(F.lit(True), F.lit(True), F.lit(True)).alias("atom_mask"),
    )
    placed = chains.select(
        "pdb", "chain", F.lit("p_A").alias("sample_id"), F.lit("A").alias("target"), F.lit(0).alias("chain_idx"),
        F.lit(0).alias("chain_no"), F.lit(40).alias("used"), F.lit(0).alias("gen_id"), F.lit(0).alias("copy"), A.G.identity().alias("matrix"),
    )
    built = A.construct_samples(placed, residues)
    assert "BroadcastHashJoin" not in built._jdf.queryExecution().executedPlan().toString()
    assert built.count() == 40
