"""Catalogues, lookups, resume, rejects and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import text as X
from curata.operators import catalog as C
from curata.operators.select import quality_filter
from curata.queries.common import table
from curata.schema import cluster_column
from curata.session import staging_path
from curata.sinks import writers
from curata.sources import catalogs as R
from curata.sources.index import read_index


def _listed(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("pdb"))


def _refined(spark, folder):
    """Ids of which some are not listed."""
    return table(spark, folder, "orders").select((F.col("o_custkey") * 3).alias("pdb"))


def reconcile_sources(spark, folder):
    rows = C.reconcile(_listed(spark, folder), _refined(spark, folder))
    return rows.withColumn("source", C.source_label())


def reconcile_capped(spark, folder):
    return C.reconcile(_listed(spark, folder), _refined(spark, folder), max_entries=301)


def set_operations(spark, folder):
    a, b = _listed(spark, folder), _refined(spark, folder)
    return C.union_sources({"both": C.intersect_ids(a, b), "listed_only": C.except_ids(a, b)})


def cluster_lookup(spark, folder):
    """Clusters written as TSV and read back, joined to order lines."""
    orders = table(spark, folder, "orders")
    path = staging_path(spark, "clusters")
    orders.select("o_orderpriority", F.concat_ws("_", "o_orderkey", F.lit("1"))).write.csv(path, sep="\t")
    clusters = R.read_clusters(spark, path)
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("pdb"), F.col("l_linenumber").cast("string").alias("chain"), "l_partkey"
    )
    return C.cluster_lookup(lines, clusters, "foldseek_70")


def _checkpoint(spark, folder):
    """Index rows of finished orders, as a JSON checkpoint in the staging folder."""
    path = staging_path(spark, "checkpoint")
    done = table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F")
    rows = done.select(
        F.col("o_orderkey").cast("string").alias("pdb"),
        F.lit("A").alias("chain"),
        F.lit("rcsb").alias("source"),
        X.shard_name(F.lit("experimental"), F.floor(F.col("o_orderkey") / 100)).alias("shard_id"),
        F.lit(512).cast("bigint").alias("offset"),
        F.col("o_custkey").alias("size"),
        F.col("o_totalprice").alias("resolution"),
        F.lit("X-RAY DIFFRACTION").alias("method"),
        F.lit("2020-01-01").alias("deposit_date"),
        F.lit(float("nan")).alias("mean_plddt"),
        F.lit(float("nan")).alias("ptm"),
    )
    writers.append_checkpoint(rows, path)
    return R.read_checkpoint(spark, path)


def checkpoint_round_trip(spark, folder):
    return _checkpoint(spark, folder)


def resume_remaining(spark, folder):
    work = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("pdb"))
    return C.remaining(work, _checkpoint(spark, folder))


def next_shard(spark, folder):
    return C.next_shard(_checkpoint(spark, folder))


def _entry_id(n):
    """Some numbers as ids of the usual form, some not."""
    return F.concat((n % 10).cast("string"), F.lpad(F.lower(F.conv(n.cast("string"), 10, 36)), 3, "a"))


def listing_ids(spark, folder):
    """Directory listing lines to ids: directories only, ids of the usual form only."""
    n = F.col("c_custkey")
    name = F.when(n % 7 == 0, F.concat(F.lit("x"), _entry_id(n))).otherwise(_entry_id(n))
    kind = F.when(n % 5 == 0, F.lit("-rw-r--r--")).otherwise(F.lit("drwxr-xr-x"))
    lines = table(spark, folder, "customer").select(
        F.concat_ws(" ", kind, F.lit("        4096 2024/01/01 00:00:00"), name).alias("value")
    )
    return R.listing_names(lines)


def search_ids(spark, folder):
    """Search result pages, one per nation, to distinct lower-case ids."""
    hits = table(spark, folder, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 1000)).agg(
        F.collect_list(F.struct(F.upper(_entry_id(F.col("c_custkey") % 997)).alias("identifier"))).alias("result_set")
    )
    return R.search_ids(hits.select(F.to_json(F.struct("result_set")).alias("value")))


def holdings_ids(spark, folder):
    """Holdings documents, whose keys are ids."""
    orders = table(spark, folder, "orders")
    text = F.concat(F.lit('{"'), F.upper(_entry_id(F.col("o_custkey"))), F.lit('": {"mmcif": ["/a"]}}'))
    return R.holdings_ids(orders.select(text.alias("value")))


def union_sources(spark, folder):
    parts = {
        "documents": table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"),
        "benchmark": table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text"),
    }
    rows = C.union_sources(parts)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def ordered_distinct(spark, folder):
    """Distinct words of each text in order of first appearance."""
    words = F.split(F.btrim("text"), r"\s+")
    return table(spark, folder, "benchmark").select(
        "item_id", F.array_join(C.ordered_distinct(words), " ").alias("words")
    )


def split_rejects(spark, folder):
    """Event properties that cannot be read go to a reject table with the reason."""
    events = table(spark, folder, "events").withColumn(
        "k", F.get_json_object("props", "$.k").try_cast("int")
    )
    good, bad = C.split_rejects(
        events, {"props": F.col("k") >= 10, "value": F.col("value") > 1, "type": F.col("event_type") != "error"}
    )
    kept = good.select("event_id", F.lit("").alias("reject_reason"))
    return kept.unionByName(bad.select("event_id", "reject_reason"))


def outcome_counts(spark, folder):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") < 5, "skipped").otherwise("success")
    return C.outcome_counts(table(spark, folder, "events").withColumn("status", status))


def index_scan(spark, folder):
    """An index with two cluster columns written, checked on reading, and filtered at the scan."""
    lines = table(spark, folder, "lineitem")
    rows = lines.select(
        F.col("l_orderkey").cast("string").alias("pdb"),
        F.col("l_linenumber").cast("string").alias("chain"),
        C.source_label(F.col("l_returnflag") == "R").alias("source"),
        F.lit("experimental/000000").alias("shard_id"),
        F.col("l_partkey").alias("offset"),
        F.col("l_suppkey").alias("size"),
        (F.col("l_quantity") / 10).alias("resolution"),
        F.lit("X-RAY DIFFRACTION").alias("method"),
        F.lit("").alias("deposit_date"),
        F.lit(float("nan")).alias("mean_plddt"),
        F.lit(float("nan")).alias("ptm"),
        F.col("l_partkey").cast("string").alias(cluster_column("foldseek", 0.7)),
        F.col("l_suppkey").cast("string").alias(cluster_column("mmseqs", 0.3)),
    )
    path = staging_path(spark, "index")
    writers.write_index(rows, path)
    index = read_index(spark, path, "foldseek_70", ["foldseek_70", "mmseqs_30"])
    return quality_filter(index).select("pdb", "chain", "source", "offset", "size", "resolution", "mmseqs_30")


QUERIES = {
    "index_scan": index_scan,
    "reconcile_sources": reconcile_sources,
    "reconcile_capped": reconcile_capped,
    "set_operations": set_operations,
    "cluster_lookup": cluster_lookup,
    "checkpoint_round_trip": checkpoint_round_trip,
    "resume_remaining": resume_remaining,
    "next_shard": next_shard,
    "listing_ids": listing_ids,
    "search_ids": search_ids,
    "holdings_ids": holdings_ids,
    "union_sources": union_sources,
    "ordered_distinct": ordered_distinct,
    "split_rejects": split_rejects,
    "outcome_counts": outcome_counts,
}


def _base36(n: str) -> str:
    """SQL for the lower-case base-36 digits of a number below 36^5, padded or cut to 3."""
    digit = lambda d: f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(({n} // {36**d}) % 36 AS INTEGER) + 1, 1)"
    full = " || ".join(digit(d) for d in (4, 3, 2, 1, 0))
    stripped = f"(CASE WHEN ltrim({full}, '0') = '' THEN '0' ELSE ltrim({full}, '0') END)"
    return f"lpad({stripped}, 3, 'a')"


def _id_sql(n: str) -> str:
    return f"(CAST({n} % 10 AS VARCHAR) || {_base36(n)})"


_refined_sql = "SELECT DISTINCT o_custkey * 3 AS pdb FROM orders"
_both_sql = f"SELECT c_custkey AS pdb, c_custkey IN ({_refined_sql}) AS is_refined FROM customer"

SQL = {
    "index_scan": """
SELECT CAST(l_orderkey AS VARCHAR) AS pdb, CAST(l_linenumber AS VARCHAR) AS chain,
  CASE WHEN l_returnflag = 'R' THEN 'pdb_redo' ELSE 'rcsb' END AS source, l_partkey AS "offset", l_suppkey AS size,
  l_quantity / 10 AS resolution, CAST(l_suppkey AS VARCHAR) AS mmseqs_30 FROM lineitem WHERE l_quantity / 10 <= 3.5::DOUBLE""",
    "reconcile_sources": f"""
SELECT pdb, is_refined, CASE WHEN is_refined THEN 'pdb_redo' ELSE 'rcsb' END AS source FROM ({_both_sql})""",
    "reconcile_capped": f"""
WITH b AS ({_both_sql}), plain AS (SELECT * FROM b WHERE NOT is_refined ORDER BY pdb LIMIT 150)
SELECT * FROM plain UNION ALL
SELECT pdb, is_refined FROM (SELECT *, row_number() OVER (ORDER BY pdb) AS rn FROM b WHERE is_refined)
WHERE rn <= 301 - (SELECT count(*) FROM plain)""",
    "set_operations": f"""
SELECT pdb, 'both' AS source FROM (SELECT c_custkey AS pdb FROM customer INTERSECT ({_refined_sql}))
UNION ALL SELECT pdb, 'listed_only' AS source FROM (SELECT c_custkey AS pdb FROM customer EXCEPT ({_refined_sql}))""",
    "cluster_lookup": """
SELECT CAST(l_orderkey AS VARCHAR) AS pdb, CAST(l_linenumber AS VARCHAR) AS chain, l_partkey,
       coalesce(o_orderpriority, '') AS foldseek_70
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = 1""",
    "checkpoint_round_trip": """
SELECT CAST(o_orderkey AS VARCHAR) AS pdb, 'A' AS chain, 'rcsb' AS source,
       'experimental/' || lpad(CAST(o_orderkey // 100 AS VARCHAR), 6, '0') AS shard_id,
       CAST(512 AS BIGINT) AS "offset", o_custkey AS size, o_totalprice AS resolution, 'X-RAY DIFFRACTION' AS method,
       '2020-01-01' AS deposit_date, CAST('NaN' AS DOUBLE) AS mean_plddt, CAST('NaN' AS DOUBLE) AS ptm
FROM orders WHERE o_orderstatus = 'F'""",
    "resume_remaining": "SELECT CAST(o_orderkey AS VARCHAR) AS pdb FROM orders WHERE o_orderstatus <> 'F'",
    "next_shard": """
SELECT CAST(max(o_orderkey // 100) + 1 AS INTEGER) AS next_shard FROM orders WHERE o_orderstatus = 'F'""",
    "listing_ids": f"""
SELECT DISTINCT {_id_sql('c_custkey')} AS pdb FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0""",
    "search_ids": f"SELECT DISTINCT {_id_sql('(c_custkey % 997)')} AS pdb FROM customer",
    "holdings_ids": f"SELECT DISTINCT {_id_sql('o_custkey')} AS pdb FROM orders",
    "union_sources": """
SELECT 'documents' AS source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents
UNION ALL SELECT 'benchmark', count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark""",
    "ordered_distinct": r"""
SELECT item_id, string_agg(word, ' ' ORDER BY first_at) AS words FROM (
  SELECT item_id, word, min(i) AS first_at FROM (
    SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
    FROM (SELECT item_id, regexp_split_to_array(trim(text, E' \n\t'), '\s+') AS w FROM benchmark))
  GROUP BY item_id, word) GROUP BY item_id""",
    "split_rejects": """
SELECT event_id, CASE WHEN NOT coalesce(k >= 10, false) THEN 'props' WHEN NOT value > 1 THEN 'value'
  WHEN event_type = 'error' THEN 'type' ELSE '' END AS reject_reason
FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "outcome_counts": """
SELECT count(*) FILTER (WHERE event_type <> 'error' AND value >= 5) AS success,
       count(*) FILTER (WHERE event_type <> 'error' AND value < 5) AS skipped,
       count(*) FILTER (WHERE event_type = 'error') AS failed FROM events""",
}
