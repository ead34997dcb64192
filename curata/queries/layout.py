"""Byte layout, shards, index rows and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions.text import meta_json, meta_struct
from curata.operators import layout as L
from curata.queries.common import md5_of, table
from curata.session import staging_path
from curata.sinks import writers

TARGET = 65_536
LANES = 3
TOGETHER = 256  # of these small shards; 16 MB


def _documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "source", F.col("n_chars").alias("size"))


def byte_layout(spark, folder):
    return L.byte_layout(_documents(spark, folder), "doc_id", target=TARGET, mode="md5")


def index_rows(spark, folder):
    """One to three chains per document share its byte range."""
    chains = F.transform(F.sequence(F.lit(0), (F.col("size") % 3).cast("int")), lambda i: F.char(i + 65))
    placed = byte_layout(spark, folder).withColumn("chain_ids", chains)
    return L.index_rows(placed).select("doc_id", "chain", "shard_id", "offset", "size")


def exact_shards(spark, folder):
    return L.exact_shards(_documents(spark, folder), "doc_id", target=TARGET, lanes=LANES, first_shard=5, mode="md5")


def shard_round_trip(spark, folder):
    """Whole documents written as shards and read back, summarised per shard."""
    placed = byte_layout(spark, folder).select("doc_id", "shard_no", "offset")
    path = staging_path(spark, "shards")
    documents = table(spark, folder, "documents").join(placed, "doc_id")
    writers.write_shards(documents, path, order=["offset"], together=TOGETHER)
    back = spark.read.parquet(path)
    return back.groupBy("source", F.col("shard_no").cast("bigint").alias("shard_no")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum(F.length("text")).alias("chars"),
        F.max("offset").alias("last_offset"),
    )


def record_round_trip(spark, folder):
    """Conversations as nested records (chains by name, metadata, NaN) written and read back."""
    turns = table(spark, folder, "conversations")
    chain = F.struct(
        F.col("turn").cast("string").alias("name"),
        F.struct(F.col("text").alias("sequence"), F.array(F.lit(float("nan")).cast("float")).alias("plddt")).alias("data"),
    )
    records = turns.groupBy("conv_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(chain))).alias("chains"), F.lit(float("nan")).alias("ptm")
    )
    path = staging_path(spark, "records")
    writers.write_records(records, path)
    back = spark.read.parquet(path)
    rows = back.select("conv_id", "ptm", F.explode("chains").alias("turn", "data"))
    return rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.md5("data.sequence").alias("text_md5"),
        F.isnan("ptm").alias("ptm_is_nan"),
        F.isnan(F.col("data.plddt")[0]).alias("plddt_is_nan"),
    )


def meta_round_trip(spark, folder):
    """Metadata to JSON text and back."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("resolution"), F.col("o_orderpriority").alias("method")
    )
    packed = orders.select("o_orderkey", meta_json("resolution", "method").alias("meta"))
    return packed.select("o_orderkey", meta_struct("meta", "resolution double, method string").alias("m")).select(
        "o_orderkey", "m.*"
    )


QUERIES = {
    "byte_layout": byte_layout,
    "index_rows": index_rows,
    "shard_ids_exact": exact_shards,
    "shard_round_trip": shard_round_trip,
    "record_round_trip": record_round_trip,
    "meta_round_trip": meta_round_trip,
}

_order = f"{md5_of(0, 'doc_id')}, doc_id"
_padded = "512 + CAST(ceil(n_chars / 512.0) AS BIGINT) * 512"
_layout = f"""
SELECT doc_id, source, size, shard_no, start - min(start) OVER (PARTITION BY source, shard_no) + 512 AS "offset",
       source || '/' || lpad(CAST(shard_no AS VARCHAR), 6, '0') AS shard_id
FROM (SELECT *, start // {TARGET} AS shard_no FROM (
  SELECT doc_id, source, n_chars AS size, CAST(coalesce(sum({_padded}) OVER (PARTITION BY source ORDER BY {_order}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents))"""
_lane = f"CAST('0x' || substr({md5_of(0, 'doc_id')}, 1, 8) AS BIGINT) % {LANES}"

SQL = {
    "byte_layout": _layout,
    "index_rows": f"""
SELECT doc_id, chr(CAST(65 + i AS INTEGER)) AS chain, shard_id, "offset", size
FROM ({_layout}), range(3) AS r(i) WHERE i <= size % 3""",
    "shard_ids_exact": f"""
WITH RECURSIVE entries AS (
  SELECT doc_id, source, n_chars AS size, {_lane} AS lane, {_padded} AS padded,
         row_number() OVER (PARTITION BY source, {_lane} ORDER BY {_order}) AS i FROM documents),
run AS (
  SELECT doc_id, source, size, lane, i, CAST(0 AS BIGINT) AS shard, CAST(512 AS BIGINT) AS "offset", padded AS used
  FROM entries WHERE i = 1
  UNION ALL
  SELECT e.doc_id, e.source, e.size, e.lane, e.i,
         CASE WHEN r.used >= {TARGET} THEN r.shard + 1 ELSE r.shard END,
         CASE WHEN r.used >= {TARGET} THEN 512 ELSE r.used + 512 END,
         CASE WHEN r.used >= {TARGET} THEN e.padded ELSE r.used + e.padded END
  FROM run r JOIN entries e ON e.source = r.source AND e.lane = r.lane AND e.i = r.i + 1),
lanes AS (SELECT source, lane, max(shard) + 1 AS n FROM run GROUP BY source, lane),
starts AS (SELECT source, lane, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY lane
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM lanes)
SELECT doc_id, run.source, size, first + shard + 5 AS shard_no, "offset",
       run.source || '/' || lpad(CAST(first + shard + 5 AS VARCHAR), 6, '0') AS shard_id
FROM run JOIN starts ON run.source = starts.source AND run.lane = starts.lane""",
    "shard_round_trip": f"""
SELECT l.source, shard_no, count(*) AS entries, CAST(sum(length(text)) AS BIGINT) AS chars, max("offset") AS last_offset
FROM ({_layout}) l JOIN documents d ON l.doc_id = d.doc_id GROUP BY l.source, shard_no""",
    "record_round_trip": """
SELECT conv_id, turn, md5(text) AS text_md5, true AS ptm_is_nan, true AS plddt_is_nan FROM conversations""",
    "meta_round_trip": "SELECT o_orderkey, o_totalprice AS resolution, o_orderpriority AS method FROM orders",
}
