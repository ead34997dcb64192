"""Streaming queries run over the tables as files that have arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions.text import epoch_seconds
from curata.queries.common import md5_of, table
from curata.operators import sampling as P
from curata.session import staging_path
from curata.streaming import ingest as I

GAP = 2700
DELAY = 7200


def _stream(spark, folder, name):
    return I.file_stream(spark, folder, table(spark, folder, name).schema, f"{name}.parquet")


def _run_in_parts(spark, folder, name, part, n, start):
    """Let a table arrive in ``n`` parts and run ``start(stream)`` after each: one micro-batch a part.

    A part arrives as the files that its tasks write, however many.  All runs
    share the checkpoint of ``start``, so each one takes only what is new.
    """
    rows, path = table(spark, folder, name), staging_path(spark, "arrivals")
    for k in range(n):
        rows.filter(part == k).write.parquet(f"{path}/part={k}")
        I.run_available(start(I.file_stream(spark, f"{path}/*", rows.schema)))
    return I.file_stream(spark, f"{path}/*", rows.schema)


def stream_ingest(spark, folder):
    """Order lines arrive in three batches, one per order is stored, and a second run adds nothing twice."""
    path = staging_path(spark, "ingest")
    part = F.least(F.floor((F.col("l_linenumber") - 1) / 2), F.lit(2))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    ingest = lambda lines: I.start_ingest(lines.select(*keys), path, "l_orderkey", keys)
    lines = _run_in_parts(spark, folder, "lineitem", part, 3, ingest)
    I.run_available(ingest(lines))
    return I.ingested(spark, path, "index")


def stream_running_metrics(spark, folder):
    """Event values as metric rows in three batches, every reduction, as last merged."""
    path = staging_path(spark, "running")
    kinds = F.array(*[F.lit(r) for r in ("sum", "mean", "max", "min", "last")])

    def merge(events):
        rows = events.select(
            F.col("event_type").alias("key"),
            F.explode(kinds).alias("reduction"),
            "value",
            F.lit(2).cast("bigint").alias("n"),
            F.col("event_id").alias("batch_id"),
        )
        return I.start_updates(I.running_metrics(rows), path, ["key", "reduction"])

    _run_in_parts(spark, folder, "events", F.col("event_id") % 3, 3, merge)
    out = I.latest(spark, path)
    return out.select("key", "reduction", F.round("value", 6).alias("value"))


def _timed(spark, folder):
    return _stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_activity(spark, folder):
    """Active intervals per second and type, as far as the watermark has passed."""
    path = staging_path(spark, "activity")
    spans = _timed(spark, folder).withColumn(
        "until", F.timestamp_micros(F.unix_micros("ts") + F.floor("value") * F.lit(1_000_000))
    )
    edges = I.stage_activity(spans, "event_type", "ts", "until", f"{DELAY} seconds")
    done = I.run_available(I.start_append(edges, path))
    rows = I.activity_levels(spark.read.parquet(f"{path}/data"), "event_type", I.watermark(done) or 0)
    wall = epoch_seconds(F.timestamp_seconds("second").cast("timestamp_ntz"))
    return rows.select("event_type", wall.alias("second"), "active")


def stream_bursts(spark, folder):
    """Bursts of events per user, as far as the watermark has passed."""
    path = staging_path(spark, "bursts")
    I.run_available(I.start_append(I.bursts(_timed(spark, folder), "user_id", "ts", f"{GAP} seconds", f"{DELAY} seconds"), path))
    rows = spark.read.parquet(f"{path}/data")
    whole = lambda c: epoch_seconds(F.col(c).cast("timestamp_ntz")).alias(c)
    return rows.select("user_id", "n", whole("first_at"), whole("last_at"))


def resume_state(spark, folder):
    """A plan of two splits continued from saved (epoch, step) positions."""
    orders = table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test").alias("split"),
        F.floor(F.col("o_orderkey") / 1000).alias("epoch"),
        "o_orderkey",
    )
    plan = P.assign_workers(orders, ["o_orderkey"], 5, 4, mode="md5")
    saved = table(spark, folder, "orders").groupBy(
        F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").alias("split")
    ).agg(F.floor(F.max("o_orderkey") / 2000).alias("epoch"), F.lit(100).cast("bigint").alias("step"))
    return I.resume_from(plan, saved.filter("split is not null")).select("split", "epoch", "o_orderkey", "worker_id", "step")


QUERIES = {
    "stream_ingest": stream_ingest,
    "stream_running_metrics": stream_running_metrics,
    "stream_activity": stream_activity,
    "stream_bursts": stream_bursts,
    "resume_state": resume_state,
}

_split = "CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END"
_plan = f"""SELECT {_split} AS split, o_orderkey // 1000 AS epoch, o_orderkey, CAST(i % 4 AS INTEGER) AS worker_id, CAST(i // 4 AS BIGINT) AS step
FROM (SELECT *, row_number() OVER (ORDER BY {md5_of(5, 'o_orderkey')}, o_orderkey) - 1 AS i FROM orders)"""
_us = "epoch_us(ts)"
_sec = f"{_us} // 1000000"

SQL = {
    "stream_ingest": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1""",
    "stream_running_metrics": """
SELECT event_type AS key, r AS reduction, round(CASE r WHEN 'max' THEN max(value) WHEN 'min' THEN min(value)
  WHEN 'last' THEN arg_max(value, event_id) ELSE sum(value) / (2 * count(*)) END, 6) AS value
FROM events, (SELECT unnest(['sum', 'mean', 'max', 'min', 'last']) AS r) GROUP BY event_type, r""",
    "stream_activity": f"""
WITH s AS (SELECT event_type, unnest(range({_sec}, {_sec} + CAST(floor(value) AS BIGINT) + 1)) AS second FROM events)
SELECT event_type, second, count(*) AS active FROM s
WHERE second + 1 <= (SELECT max(second) FROM s) - {DELAY} GROUP BY event_type, second""",
    "stream_bursts": f"""
SELECT user_id, count(*) AS n, min(t) // 1000000 AS first_at, max(t) // 1000000 AS last_at FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS burst FROM (
    SELECT user_id, event_id, {_us} AS t,
      CASE WHEN {_us} - lag({_us}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {GAP} * 1000000::BIGINT THEN 0 ELSE 1 END AS new FROM events))
GROUP BY user_id, burst HAVING max(t) + {GAP} * 1000000::BIGINT <= (SELECT max({_us}) // 1000 * 1000 FROM events) - {DELAY} * 1000000::BIGINT""",
    "resume_state": f"""
WITH p AS ({_plan}), saved AS (SELECT split, max(o_orderkey) // 2000 AS e FROM p WHERE split <> 'test' GROUP BY split)
SELECT p.split, epoch, o_orderkey, worker_id, step FROM p LEFT JOIN saved USING (split)
WHERE e IS NULL OR epoch > e OR (epoch = e AND step >= 100)""",
}
