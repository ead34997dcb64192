"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def wide_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for steps that compute much per row."""
    return spread(table(spark, folder, name))


def line_index(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as chain index: record = order, chain = line, two clusterings."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("pdb"),
        F.col("l_linenumber").alias("chain"),
        "l_partkey",
        "l_suppkey",
    )
    return spread(lines)  # the md5 draws cost more than the scan


LINE_INDEX = "SELECT l_orderkey AS pdb, l_linenumber AS chain, l_partkey, l_suppkey FROM lineitem"
LINE_KEYS = ["pdb", "chain", "l_partkey", "l_suppkey"]



def md5_of(seed, *keys: str) -> str:
    """SQL for the hex digest of a seed and keys."""
    return f"md5(concat_ws(':', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"


def uniform_of(seed, *keys: str) -> str:
    """SQL for the md5 uniform of a seed and keys."""
    return f"(CAST('0x' || substr({md5_of(seed, *keys)}, 1, 13) AS BIGINT) / 4503599627370496.0)"


def below_of(share: float, seed, *keys: str) -> str:
    return f"(substr({md5_of(seed, *keys)}, 1, 13) < '{int(share * 16**13):013x}')"


def packing_of(plan: str, budget: int, buffer: int) -> str:
    """SQL tables ``plan`` and ``packed`` for packing (worker_id, step, sample_id, len) under a budget."""
    return f"""
plan AS MATERIALIZED ({plan}),
ends AS (SELECT worker_id, max(step) AS last FROM plan GROUP BY worker_id),
run AS (
  SELECT worker_id, CAST(-1 AS BIGINT) AS seen, []::STRUCT(len BIGINT, step BIGINT)[] AS buf, CAST(0 AS BIGINT) AS used,
    CAST(0 AS BIGINT) AS batch, CAST(-1 AS BIGINT) AS slot, NULL::STRUCT(len BIGINT, step BIGINT) AS pick FROM ends
  UNION ALL
  SELECT worker_id, seen, CASE WHEN pick IS NULL THEN full_buf ELSE list_filter(full_buf, lambda w: w <> pick) END,
    used + coalesce(pick.len, 0), batch, slot, pick
  FROM (
    SELECT worker_id, seen, full_buf, used, batch, CASE WHEN place THEN slot + 1 ELSE slot END AS slot,
      CASE WHEN place THEN list_max(list_filter(full_buf, lambda w: w.len <= {budget} - used)) END AS pick
    FROM (
      SELECT worker_id, seen, full_buf, place, CASE WHEN closed THEN 0 ELSE used END AS used,
        CASE WHEN closed THEN batch + 1 ELSE batch END AS batch, CASE WHEN closed THEN -1 ELSE slot END AS slot
      FROM (
        SELECT *, place AND used > 0 AND used + list_min(list_transform(full_buf, lambda w: w.len)) > {budget} AS closed
        FROM (
          SELECT *, len(full_buf) >= {buffer} OR (seen > last AND len(full_buf) > 0) AS place
          FROM (
            SELECT r.worker_id, r.seen + 1 AS seen, r.used, r.batch, r.slot, e.last,
              CASE WHEN p.step IS NULL THEN r.buf ELSE list_append(r.buf, {{'len': p.len, 'step': p.step}}) END AS full_buf
            FROM run r JOIN ends e ON e.worker_id = r.worker_id LEFT JOIN plan p ON p.worker_id = r.worker_id AND p.step = r.seen + 1
            WHERE r.seen < e.last OR len(r.buf) > 0)))))),
packed AS (SELECT p.worker_id, p.step, p.sample_id, p.len, CAST(r.slot AS INTEGER) AS sample_idx,
    concat_ws('/', p.worker_id, 0, r.batch) AS batch_id
  FROM run r JOIN plan p ON p.worker_id = r.worker_id AND p.step = r.pick.step WHERE r.pick IS NOT NULL)"""
