"""Choose index rows: quality filter, leakage-safe split, limits, summary."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curata.functions.hashing import TEST_SEED, VAL_SEED, below, union_share
from curata.operators.ordered import top_per_group
from curata.schema import check_columns

TRAIN, VAL, TEST = "train", "val", "test"


def quality_filter(
    df: DataFrame,
    max_resolution: float = 3.5,
    min_plddt: float = 0.70,
    min_ptm: float = 0.70,
    resolution: str = "resolution",
    plddt: str = "mean_plddt",
    ptm: str = "ptm",
) -> DataFrame:
    """Keep rows of sufficient quality.

    NaN sorts above every number: a record without predicted scores (NaN)
    passes the two lower bounds, one without a resolution fails the upper.
    """
    return df.filter(
        (F.col(resolution) <= max_resolution) & (F.col(plddt) >= min_plddt) & (F.col(ptm) >= min_ptm)
    )


def _any_below(share: float, seed: int, cluster_cols, mode: str):
    return reduce(or_, [below(share, seed, c, mode=mode) for c in cluster_cols])


def leakage_safe_split(
    df: DataFrame,
    cluster_cols,
    ratios=(0.9, 0.05, 0.05),
    pdb: str = "pdb",
    mode: str = "xxhash64",
    on_conflict: str = "drop",
    test_seed: int = TEST_SEED,
    val_seed: int = VAL_SEED,
) -> DataFrame:
    """Add ``split``; clusters and records never leak from train into the others.

    A row is test when the hash of any of its cluster ids falls below the test
    share, else validation likewise, else train.  Rows of a record that also
    has rows in test are dropped (``on_conflict="drop"``) or moved to test
    (``"promote"``); then the same for train rows against validation.

    Both rules read one aggregate per record: a record with a test row keeps
    only its test rows, so its validation rows never decide anything.  The
    aggregate combines before the shuffle and only records with a test or
    validation row enter the join, so a record with very many rows is safe.
    """
    train, val, test = ratios
    if abs(train + val + test - 1.0) > 1e-9:
        raise ValueError(f"split ratios must sum to 1, got {ratios}")
    if on_conflict not in ("drop", "promote"):
        raise ValueError(f"on_conflict is 'drop' or 'promote', not {on_conflict!r}")
    check_columns(df, [pdb, *cluster_cols])

    n = len(cluster_cols)
    test_share = union_share(test, n)
    val_share = union_share(val / (1 - test), n) if test < 1 else 0.0
    flagged = df.withColumns(
        {
            "_test": _any_below(test_share, test_seed, cluster_cols, mode),
            "_val": _any_below(val_share, val_seed, cluster_cols, mode),
        }
    )
    held = (
        flagged.filter("_test or _val")
        .groupBy(pdb)
        .agg(F.max("_test").alias("_any_test"), F.max("_val").alias("_any_val"))
    )
    joined = flagged.join(held, pdb, "left").withColumns(
        {
            "_any_test": F.coalesce("_any_test", F.lit(False)),
            "_any_val": F.coalesce("_any_val", F.lit(False)),
        }
    )
    if on_conflict == "promote":
        split = F.when(F.col("_any_test"), TEST).when(F.col("_any_val"), VAL).otherwise(TRAIN)
    else:
        joined = joined.filter("_test or (not _any_test and (_val or not _any_val))")
        split = F.when(F.col("_test"), TEST).when(F.col("_val"), VAL).otherwise(TRAIN)
    return joined.withColumn("split", split).drop("_test", "_val", "_any_test", "_any_val")


def limit_clusters(
    df: DataFrame,
    cluster_col: str,
    order,
    num_clusters: int = -1,
    max_samples_per_cluster: int = -1,
) -> DataFrame:
    """Keep the first clusters in id order and the first rows of each; -1 is off.

    ``order`` is the row order within a cluster and must be total.
    """
    if num_clusters != -1:
        first = df.select(cluster_col).distinct().orderBy(cluster_col).limit(num_clusters)
        df = df.join(first, cluster_col, "left_semi")
    if max_samples_per_cluster != -1:
        df = top_per_group(df, [cluster_col], order, max_samples_per_cluster)
    return df


def limit_splits(df: DataFrame, cluster_col: str, order, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """``limit_clusters`` with its own limits per split: ``{split: (clusters, samples)}``.

    Every split reads ``df`` for itself, so give a written table (``stage``).
    """
    parts = []
    for name in (TRAIN, VAL, TEST):
        part = df.filter(F.col("split") == name)
        parts.append(limit_clusters(part, cluster_col, order, *limits.get(name, (-1, -1))))
    return reduce(DataFrame.unionByName, parts)


def cluster_count(df: DataFrame, cluster_col: str, approximate: bool = False) -> DataFrame:
    """The number of distinct clusters."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(F.col(cluster_col)).alias("n_clusters"))


def split_summary(df: DataFrame, cluster_col: str) -> DataFrame:
    """Samples and clusters per split, and each split's share of their sums."""
    per_split = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct(cluster_col).alias("clusters")
    )
    everything = W.partitionBy()  # three rows
    return per_split.withColumns(
        {
            "samples_pct": 100.0 * F.col("samples") / F.sum("samples").over(everything),
            "clusters_pct": 100.0 * F.col("clusters") / F.sum("clusters").over(everything),
        }
    )
