"""Stage summaries, phases, peaks, timelines and rates over the event table as a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions.text import epoch_seconds
from curata.operators import profile as O
from curata.queries.common import table
from curata.session import staging_path
from curata.sources import catalogs

STAGES = ["click", "error", "purchase", "signup", "view"]
EPOCH = 1_704_067_200  # the first second of 2024


def _events(spark, folder):
    return table(spark, folder, "events").withColumn("second", epoch_seconds("ts"))


def stage_summary(spark, folder):
    out = O.stage_summary(_events(spark, folder), "event_type", "value")
    return out.withColumn("avg_value", F.round("avg_value", 6))


def small_group_summary(spark, folder):
    """Groups around the size from which the p95 differs from the maximum."""
    groups = _events(spark, folder).withColumn("grp", F.floor(F.sqrt(F.col("event_id").cast("double"))))
    out = O.stage_summary(groups, "grp", "value")
    return out.withColumn("avg_value", F.round("avg_value", 6))


def profile_summary(spark, folder):
    """Several metrics of a log as rows, then min, average and max of each."""
    log = table(spark, folder, "lineitem")
    out = O.profile_summary(log, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])
    return out.withColumn("avg_value", F.round("avg_value", 6))


def phase_breakdown(spark, folder):
    phase = F.when(F.col("event_type") != "view", F.col("event_type"))
    return O.phase_breakdown(_events(spark, folder).withColumn("phase", phase), "phase", "second")


def peak_topk(spark, folder):
    return O.peak_topk(_events(spark, folder), "user_id", "value", 10)


def _timeline(spark, folder):
    spans = _events(spark, folder).select(
        "event_type", (F.col("second") - EPOCH).alias("t0"), (F.col("second") - EPOCH + F.col("value")).alias("t1")
    )
    return O.concurrency_timeline(spans, "event_type", "t0", "t1")


def concurrency_timeline(spark, folder):
    return _timeline(spark, folder)


def timeline_pivot(spark, folder):
    return O.timeline_pivot(_timeline(spark, folder), "event_type", STAGES)


def stage_intervals(spark, folder):
    """Stage log rows to stage intervals, and their concurrency at the busiest."""
    log = _events(spark, folder).select(
        (F.col("second") - EPOCH).cast("double").alias("wall"),
        (F.col("value") / 4).alias("fetch"),
        F.col("value").alias("cpu_wait"),
        F.lit(0.5).alias("write_lock_wait"),
        (F.col("event_id") % 8).cast("double").alias("write"),
    )
    spans = O.stage_intervals(log)
    return O.peak_topk(O.concurrency_timeline(spans, "stage", "t0", "t1"), "stage", "active", 3)


def stage_report(spark, folder):
    """Every stage and size of a stage log; one size in three was not measured."""
    log = _events(spark, folder).select(
        (F.col("value") / 4).alias("fetch"),
        F.col("value").alias("cpu_wait"),
        F.lit(0.5).alias("write_lock_wait"),
        (F.col("event_id") % 8).cast("double").alias("write"),
        (F.col("value") * 1.25 + F.lit(0.5) + F.col("event_id") % 8).alias("total"),
        (F.col("user_id") * 2).alias("raw_kb"),
        F.col("user_id").alias("blob_kb"),
        F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("event_id") % 16).alias("pool_active"),
    )
    return O.stage_report(log).withColumn("avg_value", F.round("avg_value", 5))


def rate_from_lag(spark, folder):
    rates = O.rate_per_second(
        _events(spark, folder), ["user_id"], "second", "value", tie=["event_id"], scale=1 / 1024
    )
    return rates.select("event_id", "user_id", F.round("rate", 8).alias("rate"))


def rate_fixed_interval(spark, folder):
    rates = O.rate_per_second(
        _events(spark, folder), ["event_type"], "second", "value", tie=["event_id"], interval=2.0
    )
    return rates.select("event_id", F.round("rate", 6).alias("rate"))


def _profile_log(spark, folder):
    """Events as a profile log in JSON lines, written and read back."""
    v, n = F.col("value"), F.col("event_id")
    other = F.struct(n.cast("int").alias("pid"), F.concat(F.lit("u"), F.col("user_id")).alias("name"), v.alias("cpu_pct"))
    log = table(spark, folder, "events").select(
        n.cast("double").alias("elapsed_s"),
        F.col("event_type").alias("phase"),
        (v % 100).alias("sys_cpu_pct"),
        (n % 8).cast("int").alias("cores_active"),
        F.lit(8).alias("cores_total"),
        *[(v * i).alias(c) for i, c in enumerate(("sys_mem_pct", "sys_mem_used_mb", "proc_rss_mb", "proc_cpu_pct"), 1)],
        (n % 32).cast("int").alias("proc_threads"),
        *[(v + i).alias(c) for i, c in enumerate(("proc_io_read_mb", "proc_io_write_mb", "net_recv_mbps", "net_send_mbps"))],
        F.array(other).alias("top_other_procs"),
    )
    path = staging_path(spark, "profile")
    log.write.json(path)
    return catalogs.read_profile_log(spark, path)


def profile_log_summary(spark, folder):
    """Minimum, average and maximum of every profiled metric of a log file."""
    return O.profile_summary(_profile_log(spark, folder)).withColumn("avg_value", F.round("avg_value", 5))


def top_processes(spark, folder):
    """The busiest other processes of a log file."""
    return O.top_processes(_profile_log(spark, folder), 10)


QUERIES = {
    "profile_log_summary": profile_log_summary,
    "top_processes": top_processes,
    "stage_summary": stage_summary,
    "stage_summary_small_groups": small_group_summary,
    "profile_summary": profile_summary,
    "phase_breakdown": phase_breakdown,
    "peak_topk": peak_topk,
    "concurrency_timeline": concurrency_timeline,
    "timeline_pivot": timeline_pivot,
    "stage_intervals": stage_intervals,
    "stage_report": stage_report,
    "rate_from_lag": rate_from_lag,
    "rate_fixed_interval": rate_fixed_interval,
}

_sec = "epoch_us(ts) // 1000000"


def _summary(group, source="events"):
    return f"""
SELECT grp AS {group}, n, lo AS min_value, round(mean, 6) AS avg_value, hi AS max_value,
       CASE WHEN n >= 20 THEN v[CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1] ELSE hi END AS p95_value
FROM (SELECT {group} AS grp, count(*) AS n, min(value) AS lo, avg(value) AS mean, max(value) AS hi, list_sort(list(value)) AS v
      FROM {source} GROUP BY 1)"""


_spans = f"SELECT event_type, {_sec} - {EPOCH} AS t0, CAST(floor({_sec} - {EPOCH} + value) AS BIGINT) AS t1 FROM events"
_active = f"""SELECT event_type, unnest(range(t0, t1 + 1)) AS second FROM ({_spans}) WHERE t1 >= t0"""
_stages = f"""
SELECT 'fetch' AS stage, wall AS t0, wall + f AS t1 FROM log UNION ALL
SELECT 'cpu', wall + f, wall + f + value FROM log UNION ALL
SELECT 'write', wall + f + value, wall + f + value + (0.5::DOUBLE + w) FROM log"""

_metric_sql = {
    "sys_cpu_pct": "value % 100", "proc_cpu_pct": "value * 4", "proc_threads": "event_id % 32", "proc_rss_mb": "value * 3",
    "sys_mem_pct": "value * 1", "proc_io_read_mb": "value + 0", "proc_io_write_mb": "value + 1", "net_recv_mbps": "value + 2",
    "net_send_mbps": "value + 3", "cores_active": "event_id % 8",
}

_report = {
    "fetch": "value / 4", "cpu_wait": "value", "write_lock_wait": "0.5::DOUBLE", "write": "event_id % 8",
    "total": "value * 1.25::DOUBLE + 0.5::DOUBLE + event_id % 8",
}
_sizes = {"raw_kb": "user_id * 2", "blob_kb": "user_id", "pool_active": "CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id % 16 END"}

SQL = {
    "stage_report": " UNION ALL ".join(
        [
            f"SELECT '{m}' AS metric, count(*) AS n, min(v) AS min_value, round(avg(v), 5) AS avg_value, "
            "CASE WHEN count(*) >= 20 THEN list_sort(list(v))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] ELSE max(v) END AS p95_value, "
            f"max(v) AS max_value FROM (SELECT ({e})::DOUBLE AS v FROM events)"
            for m, e in _report.items()
        ]
        + [
            f"SELECT '{m}', count(*), min(v), round(avg(v), 5), NULL::DOUBLE, max(v) FROM (SELECT ({e})::DOUBLE AS v FROM events) WHERE v >= 0"
            for m, e in _sizes.items()
        ]
    ),
    "profile_log_summary": " UNION ALL ".join(
        f"SELECT '{m}' AS metric, min(v) AS min_value, round(avg(v), 5) AS avg_value, max(v) AS max_value FROM (SELECT ({e})::DOUBLE AS v FROM events)"
        for m, e in _metric_sql.items()
    ),
    "top_processes": """
SELECT 'u' || user_id AS name, max(value) AS peak FROM events GROUP BY user_id ORDER BY peak DESC, name LIMIT 10""",
    "stage_summary": _summary("event_type"),
    "stage_summary_small_groups": _summary("grp", "(SELECT *, CAST(floor(sqrt(event_id)) AS BIGINT) AS grp FROM events)").replace(
        "SELECT grp AS grp, n", "SELECT grp, n", 1
    ),
    "profile_summary": """
SELECT metric, min(value) AS min_value, round(avg(value), 6) AS avg_value, max(value) AS max_value FROM (
  UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber INTO NAME metric VALUE value) GROUP BY metric""",
    "phase_breakdown": f"""
SELECT CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS phase, count(*) AS n,
       min({_sec}) AS first_at, max({_sec}) AS last_at FROM events GROUP BY 1""",
    "peak_topk": "SELECT user_id, max(value) AS peak FROM events GROUP BY user_id ORDER BY peak DESC, user_id LIMIT 10",
    "concurrency_timeline": f"""
SELECT event_type, second, count(*) AS active FROM ({_active}) GROUP BY event_type, second""",
    "timeline_pivot": "SELECT second, "
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{s}') AS {s}" for s in STAGES)
    + f" FROM ({_active}) GROUP BY second",
    "stage_intervals": f"""
WITH log AS (SELECT CAST({_sec} - {EPOCH} AS DOUBLE) AS wall, value / 4 AS f, value, CAST(event_id % 8 AS DOUBLE) AS w FROM events)
SELECT stage, max(active) AS peak FROM (
  SELECT stage, second, count(*) AS active FROM (
    SELECT stage, unnest(range(CAST(floor(t0) AS BIGINT), CAST(floor(t1) AS BIGINT) + 1)) AS second FROM ({_stages}))
  GROUP BY stage, second) GROUP BY stage""",
    "rate_from_lag": f"""
SELECT event_id, user_id, round((value - v) / nullif(s - ps, 0) / (1.0 / 1024), 8) AS rate FROM (
  SELECT event_id, user_id, value, {_sec} AS s, lag(value) OVER w AS v, lag({_sec}) OVER w AS ps FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY {_sec}, event_id))""",
    "rate_fixed_interval": f"""
SELECT event_id, round((value - lag(value) OVER (PARTITION BY event_type ORDER BY {_sec}, event_id)) / 2.0, 6) AS rate FROM events""",
}
