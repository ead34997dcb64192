"""Quality filter, split, limits and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions.hashing import TEST_SEED, VAL_SEED, union_share
from curata.operators import select as S
from curata.queries.common import LINE_INDEX, LINE_KEYS, below_of, line_index, table
from curata.session import stage

CLUSTERS = ["l_partkey", "l_suppkey"]
RATIOS = (0.9, 0.05, 0.05)
LIMITS = {"train": (200, 3), "val": (100, 2), "test": (50, -1)}

_test = " OR ".join(below_of(union_share(RATIOS[2], 2), TEST_SEED, c) for c in CLUSTERS)
_val = " OR ".join(below_of(union_share(RATIOS[1] / (1 - RATIOS[2]), 2), VAL_SEED, c) for c in CLUSTERS)
SPLIT_SQL = f"""
SELECT pdb, chain, l_partkey, l_suppkey, split FROM (
  SELECT *, max(CASE WHEN split = 'val' THEN 1 ELSE 0 END) OVER (PARTITION BY pdb) AS any_val FROM (
    SELECT *, CASE WHEN is_test THEN 'test' WHEN {_val} THEN 'val' ELSE 'train' END AS split FROM (
      SELECT *, bool_or(is_test) OVER (PARTITION BY pdb) AS any_test FROM (
        SELECT *, ({_test}) AS is_test FROM ({LINE_INDEX})))
    WHERE is_test OR NOT any_test))
WHERE NOT (split = 'train' AND any_val = 1)
"""


def quality_filter(spark, folder):
    lines = table(spark, folder, "lineitem")
    scored = lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_quantity") / 10).alias("resolution"),
        F.when(F.col("l_returnflag") == "N", F.lit(float("nan")))
        .otherwise(1 - F.col("l_discount") * 4)
        .alias("mean_plddt"),
        (1 - F.col("l_tax") * 5).alias("ptm"),
    )
    return S.quality_filter(scored)


def split(spark, folder):
    return S.leakage_safe_split(line_index(spark, folder), CLUSTERS, RATIOS, mode="md5")


def split_promoted(spark, folder):
    return S.leakage_safe_split(
        line_index(spark, folder), CLUSTERS, RATIOS, mode="md5", on_conflict="promote"
    )


def split_summary(spark, folder):
    return S.split_summary(split(spark, folder), "l_partkey").withColumns(
        {"samples_pct": F.round("samples_pct", 6), "clusters_pct": F.round("clusters_pct", 6)}
    )


def cluster_count(spark, folder):
    return S.cluster_count(line_index(spark, folder), "l_partkey")


def limit_clusters(spark, folder):
    return S.limit_clusters(line_index(spark, folder), "l_partkey", LINE_KEYS, 500, 2)


def limit_splits(spark, folder):
    return S.limit_splits(stage(split(spark, folder), "split"), "l_partkey", LINE_KEYS, LIMITS)


def _limited(name):
    clusters, rows = LIMITS[name]
    few = "" if rows < 0 else f"QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(LINE_KEYS)}) <= {rows}"
    return f"""
    SELECT * FROM split WHERE split = '{name}' AND l_partkey IN (
      SELECT DISTINCT l_partkey FROM split WHERE split = '{name}' ORDER BY l_partkey LIMIT {clusters}) {few}"""


QUERIES = {
    "quality_filter": quality_filter,
    "leakage_safe_split": split,
    "leakage_safe_split_promote": split_promoted,
    "split_summary": split_summary,
    "cluster_count": cluster_count,
    "limit_clusters": limit_clusters,
    "limit_splits": limit_splits,
}

SQL = {
    "quality_filter": """
SELECT * FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 10 AS resolution,
         CASE WHEN l_returnflag = 'N' THEN CAST('NaN' AS DOUBLE) ELSE 1 - l_discount * 4 END AS mean_plddt,
         1 - l_tax * 5 AS ptm
  FROM lineitem)
WHERE resolution <= 3.5 AND mean_plddt >= CAST(0.7 AS DOUBLE) AND ptm >= CAST(0.7 AS DOUBLE)
""",
    "leakage_safe_split": SPLIT_SQL,
    "leakage_safe_split_promote": f"""
SELECT pdb, chain, l_partkey, l_suppkey,
       CASE WHEN bool_or(is_test) OVER (PARTITION BY pdb) THEN 'test'
            WHEN bool_or(is_val) OVER (PARTITION BY pdb) THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, ({_test}) AS is_test, ({_val}) AS is_val FROM ({LINE_INDEX}))
""",
    "split_summary": f"""
SELECT split, samples, clusters,
       round(100.0 * samples / sum(samples) OVER (), 6) AS samples_pct,
       round(100.0 * clusters / sum(clusters) OVER (), 6) AS clusters_pct
FROM (SELECT split, count(*) AS samples, count(DISTINCT l_partkey) AS clusters FROM ({SPLIT_SQL}) GROUP BY split)
""",
    "cluster_count": "SELECT count(DISTINCT l_partkey) AS n_clusters FROM lineitem",
    "limit_clusters": f"""
SELECT * FROM ({LINE_INDEX})
WHERE l_partkey IN (SELECT DISTINCT l_partkey FROM lineitem ORDER BY 1 LIMIT 500)
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(LINE_KEYS)}) <= 2
""",
    "limit_splits": f"WITH split AS ({SPLIT_SQL}) "
    + " UNION ALL ".join(f"SELECT * FROM ({_limited(n)})" for n in LIMITS),
}
