"""Reconcile source catalogues, look up clusters, resume, keep rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.hashing import col
from curata.functions.text import chain_key, trailing_number


def reconcile(listed: DataFrame, refined: DataFrame, id_col: str = "pdb", max_entries: int = -1) -> DataFrame:
    """Split listed ids into refined and listed-only ones.

    Returns ``id_col`` and ``is_refined``.  Refined ids that are not listed are
    left out, because only the listing applied the catalogue's filters.  With
    ``max_entries`` half of the places go to listed-only ids and the rest to
    refined ones, each in id order.
    """
    listed = listed.select(id_col).distinct()
    refined_ids = refined.select(id_col).distinct().withColumn("is_refined", F.lit(True))
    both = listed.join(refined_ids, id_col, "left").withColumn(
        "is_refined", F.coalesce("is_refined", F.lit(False))
    )
    if max_entries <= 0:
        return both
    plain = both.filter("not is_refined").orderBy(id_col).limit(max_entries // 2)
    places = plain.unionByName(both.filter("is_refined")).orderBy("is_refined", id_col)
    return places.limit(max_entries)


def intersect_ids(a: DataFrame, b: DataFrame, id_col: str = "pdb") -> DataFrame:
    return a.select(id_col).intersect(b.select(id_col))


def except_ids(a: DataFrame, b: DataFrame, id_col: str = "pdb") -> DataFrame:
    return a.select(id_col).subtract(b.select(id_col))


def union_sources(parts: dict[str, DataFrame], label: str = "source") -> DataFrame:
    """All rows of several sources, each marked with its source."""
    out = None
    for name, part in parts.items():
        marked = part.withColumn(label, F.lit(name))
        out = marked if out is None else out.unionByName(marked, allowMissingColumns=True)
    return out


def source_label(is_refined="is_refined") -> Column:
    # The two source labels.
    return F.when(col(is_refined), F.lit("pdb_redo")).otherwise(F.lit("rcsb"))


def ordered_distinct(array_col) -> Column:
    """Distinct items of an array in order of first appearance."""
    return F.array_distinct(array_col)


def cluster_columns(
    df: DataFrame, clusters: DataFrame, columns, pdb="pdb", chain="chain", missing: str = "empty"
) -> DataFrame:
    """Add several cluster columns at once from a table keyed by ``member``.

    Chains without a cluster get ``""``, so all of them count as one cluster;
    with ``missing="singleton"`` each is a cluster of its own.
    """
    if missing not in ("empty", "singleton"):
        raise ValueError(f"missing is 'empty' or 'singleton', not {missing!r}")
    found = clusters.select(F.col("member").alias("_member"), *columns)
    joined = df.withColumn("_member", chain_key(pdb, chain)).join(found, "_member", "left")
    default = F.lit("") if missing == "empty" else F.col("_member")
    return joined.withColumns({c: F.coalesce(F.col(c), default) for c in columns}).drop("_member")


def cluster_lookup(
    df: DataFrame, clusters: DataFrame, out: str, pdb="pdb", chain="chain", missing: str = "empty"
) -> DataFrame:
    """Add the cluster representative of each chain as column ``out``, from ``rep, member`` rows."""
    named = clusters.select("member", F.col("rep").alias(out))
    return cluster_columns(df, named, [out], pdb, chain, missing)


def remaining(work: DataFrame, done: DataFrame, id_col: str = "pdb") -> DataFrame:
    """Work whose id is not done yet."""
    return work.join(done.select(id_col).distinct(), id_col, "left_anti")


def next_shard(rows: DataFrame, shard: str = "shard_id") -> DataFrame:
    """The first free shard number after the checkpointed rows; 0 when there are none."""
    return rows.agg((F.coalesce(F.max(trailing_number(shard)), F.lit(-1)) + 1).alias("next_shard"))


def outcome_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Success, skipped and failed counts."""
    s = F.col(status)
    return df.agg(
        F.count_if(s == "success").alias("success"),
        F.count_if(s == "skipped").alias("skipped"),
        F.count_if(s == "failed").alias("failed"),
    )


def first_failed(checks: dict[str, Column]) -> Column:
    """The name of the first check that fails or gives null, or null."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])


def split_rejects(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with the first failed check.

    A check that gives null counts as failed, so ``try_*`` expressions turn
    unreadable values into rejects instead of ending the job.
    """
    marked = df.withColumn("reject_reason", first_failed(checks))
    good = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, marked.filter(F.col("reject_reason").isNotNull())
