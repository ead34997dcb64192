"""Epoch samples, coalesced reads, worker plans and resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions.hashing import epoch_seed
from curata.functions.text import epoch_seconds
from curata.operators import sampling as P
from curata.queries.common import LINE_INDEX, LINE_KEYS, line_index, md5_of, table

EPOCH = 3
SEED = epoch_seed(42, EPOCH)
GAP = 1800
DAY = 86_400
WORKERS = 7


def epoch_sample(spark, folder):
    return P.epoch_sample(line_index(spark, folder), "l_partkey", LINE_KEYS, epoch=EPOCH, mode="md5")


def epoch_sample_fixed(spark, folder):
    """Validation and test draws ignore the epoch."""
    return P.epoch_sample(
        line_index(spark, folder), "l_suppkey", LINE_KEYS, epoch=EPOCH, fixed=True, mode="md5"
    )


def _event_ranges(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "user_id", epoch_seconds("ts").alias("offset"), F.floor(F.col("value") * 10).alias("size")
    )


def coalesce_ranges(spark, folder):
    return P.coalesce_ranges(_event_ranges(spark, folder), ["user_id"], gap=GAP, segment=DAY)


def assign_reads(spark, folder):
    rows = P.assign_reads(_event_ranges(spark, folder), ["user_id"], gap=GAP, segment=DAY)
    return rows.select("event_id", "user_id", "offset", "size", "byte_start")


def assign_workers(spark, folder):
    reads = coalesce_ranges(spark, folder)
    return P.assign_workers(reads, ["user_id", "byte_start"], SEED, WORKERS, mode="md5").select(
        "user_id", "byte_start", "worker_id", "step"
    )


def resume_plan(spark, folder):
    return P.resume_plan(assign_workers(spark, folder), 100)


def _index(spark, folder):
    """Order lines with a place in shards: one blob per order, shards by order range."""
    lines = table(spark, folder, "lineitem")
    order = F.col("l_orderkey")
    return lines.select(
        order.alias("pdb"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("chain"),
        F.concat(F.lit("shard/"), (order % 64).cast("string")).alias("shard_id"),
        (F.lit(512) + F.floor(order / 64) * 4096).alias("offset"),
        (F.lit(512) + order % 3000).alias("size"),
        "l_suppkey",
        "l_partkey",
    )


def epoch_plan(spark, folder):
    """The whole plan: one row per cluster, coalesced, shuffled, dealt to workers."""
    return P.epoch_plan(
        _index(spark, folder), "l_partkey", epoch=EPOCH, num_workers=WORKERS, gap=8192, mode="md5"
    )


def read_once(spark, folder):
    """Chains of an order share its blob, which is attached after reading it once."""
    entries = _index(spark, folder).select("pdb", "chain", "offset")
    blobs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pdb"),
        (F.lit(512) + F.floor(F.col("o_orderkey") / 64) * 4096).alias("offset"),
        F.col("o_totalprice").alias("blob"),
    )
    return P.read_once(entries, blobs)


QUERIES = {
    "epoch_sample": epoch_sample,
    "epoch_sample_fixed": epoch_sample_fixed,
    "coalesce_ranges": coalesce_ranges,
    "assign_reads": assign_reads,
    "assign_workers": assign_workers,
    "resume_plan": resume_plan,
    "epoch_plan": epoch_plan,
    "read_once": read_once,
}


def _sample(cluster, seed):
    keys = ", ".join(LINE_KEYS)
    return f"""SELECT * FROM ({LINE_INDEX})
QUALIFY row_number() OVER (PARTITION BY {cluster} ORDER BY {md5_of(seed, *LINE_KEYS)}, {keys}) = 1"""


def islands(source: str, by: str, gap: int) -> str:
    """SQL that adds byte_start to rows (by, offset, size)."""
    return f"""
SELECT *, max(opened) OVER (PARTITION BY {by} ORDER BY "offset" RANGE UNBOUNDED PRECEDING) AS byte_start FROM (
  SELECT *, CASE WHEN prev_end IS NULL OR "offset" - prev_end > {gap} THEN "offset" END AS opened FROM (
    SELECT *, max("offset" + size) OVER (PARTITION BY {by} ORDER BY "offset", size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM ({source})))"""


EVENT_RANGES = """SELECT event_id, user_id, epoch_us(ts) // 1000000 AS "offset", CAST(floor(value * 10) AS BIGINT) AS size FROM events"""
_reads = islands(EVENT_RANGES, "user_id", GAP)
COALESCED = f"""SELECT user_id, byte_start, max("offset" + size) AS byte_end, count(*) AS n_entries,
  CAST(sum(size) AS BIGINT) AS entry_bytes FROM ({_reads}) GROUP BY user_id, byte_start"""


def _workers(source, keys, seed):
    order = f"{md5_of(seed, *keys)}, {', '.join(keys)}"
    return f"""SELECT * EXCLUDE (i), CAST(i % {WORKERS} AS INTEGER) AS worker_id, CAST(i // {WORKERS} AS BIGINT) AS step
FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i FROM ({source}))"""


_assigned = _workers(f"SELECT user_id, byte_start FROM ({COALESCED})", ["user_id", "byte_start"], SEED)
_index_sql = """SELECT l_orderkey AS pdb, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS chain,
  'shard/' || (l_orderkey % 64) AS shard_id, 512 + (l_orderkey // 64) * 4096 AS "offset",
  512 + l_orderkey % 3000 AS size, l_suppkey, l_partkey FROM lineitem"""
_epoch = f"""SELECT * FROM ({_index_sql})
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {md5_of(SEED, 'pdb', 'chain')}, pdb, chain) = 1"""
_epoch_reads = f"""SELECT shard_id, byte_start, max("offset" + size) AS byte_end, count(*) AS n_entries,
  CAST(sum(size) AS BIGINT) AS entry_bytes FROM ({islands(_epoch, 'shard_id', 8192)}) GROUP BY shard_id, byte_start"""

SQL = {
    "epoch_sample": _sample("l_partkey", SEED),
    "epoch_sample_fixed": _sample("l_suppkey", 42),
    "coalesce_ranges": COALESCED,
    "assign_reads": f'SELECT event_id, user_id, "offset", size, byte_start FROM ({_reads})',
    "assign_workers": _assigned,
    "resume_plan": f"SELECT * FROM ({_assigned}) WHERE step >= 100",
    "epoch_plan": _workers(_epoch_reads, ["shard_id", "byte_start"], SEED),
    "read_once": """
SELECT l_orderkey AS pdb, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS chain,
       512 + (l_orderkey // 64) * 4096 AS "offset", o_totalprice AS blob
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
}
