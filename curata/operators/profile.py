"""Summaries of stage and profile logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curata.operators.ordered import PIECE_ROWS, previous_value, running_total
from curata.session import stage as stage_table

ACCURACY = 10_000

# The stages and the profiled metrics that are summarised, and
# the number of samples from which a p95 differs from the maximum.
STAGES = ("fetch", "cpu_wait", "write_lock_wait", "write", "total")
SIZES = ("raw_kb", "blob_kb", "pool_active")
PROFILE_METRICS = (
    "sys_cpu_pct",
    "proc_cpu_pct",
    "proc_threads",
    "proc_rss_mb",
    "sys_mem_pct",
    "proc_io_read_mb",
    "proc_io_write_mb",
    "net_recv_mbps",
    "net_send_mbps",
    "cores_active",
)
P95_FROM = 20


def unpivot(df: DataFrame, columns, name: str, value: str, keep=()) -> DataFrame:
    """Columns to (name, value) rows, as doubles."""
    cast = [F.col(c).cast("double").alias(c) for c in columns]
    keep = list(keep)
    return df.select(*keep, *cast).unpivot([F.col(k) for k in keep], list(columns), name, value)


def ranked_value(df: DataFrame, by: str, value: str, share: float, out: str, accuracy: int = ACCURACY) -> DataFrame:
    """The exact value at position ``int(share * n)`` of each group's sorted values.

    Two bounded-size approximate percentiles bracket the position; only rows
    inside the bracket (about ``2 n / accuracy`` of them) are counted by
    distinct value and ranked, and rows below it are merely counted.  No group
    is ever collected or sorted as a whole.
    """
    margin = 2.0 / accuracy
    lo, hi = max(0.0, share - margin), min(1.0, share + margin)
    bounds = df.groupBy(by).agg(
        F.percentile_approx(value, F.array(F.lit(lo), F.lit(hi)), F.lit(accuracy)).alias("_bounds"),
        F.count(F.lit(1)).alias("_n"),
    )
    bounds = bounds.select(
        F.col(by),
        F.when(F.lit(lo) > 0, F.col("_bounds")[0]).alias("_lo"),
        F.when(F.lit(hi) < 1, F.col("_bounds")[1]).alias("_hi"),
        F.floor(F.col("_n") * F.lit(share)).alias("_at"),
    )
    # One row per group: once written, its true size lets Spark choose to broadcast it.
    joined = df.select(by, value).join(stage_table(bounds, "bounds"), by)
    in_bracket = F.coalesce(F.col(value) >= F.col("_lo"), F.lit(True)) & F.coalesce(
        F.col(value) <= F.col("_hi"), F.lit(True)
    )
    below = F.coalesce(F.col(value) < F.col("_lo"), F.lit(False))
    # One row per distinct value in the bracket, and one row (null) for all values below it.
    counted = (
        joined.filter(in_bracket | below)
        .withColumn("_v", F.when(in_bracket, F.col(value)))
        .groupBy(by, "_v")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_at").alias("_at"))
    )
    upto = F.sum("_c").over(W.partitionBy(by).orderBy(F.col("_v").asc_nulls_first()))
    return (
        counted.withColumn("_upto", upto)
        .filter("_v is not null and _upto > _at")
        .groupBy(by)
        .agg(F.min("_v").alias(out))
    )


def stage_summary(df: DataFrame, stage: str, value: str, exact: bool = True) -> DataFrame:
    """Min, average, p95 and max per stage; below 20 samples p95 is the maximum.

    ``exact=False`` takes the approximate percentile in the same single pass.
    """
    basic = [
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("min_value"),
        F.avg(value).alias("avg_value"),
        F.max(value).alias("max_value"),
    ]
    if exact:
        p95 = ranked_value(df, stage, value, 0.95, "_p95")
        out = df.groupBy(stage).agg(*basic).join(p95, stage, "left")
    else:
        out = df.groupBy(stage).agg(*basic, F.percentile_approx(value, F.lit(0.95)).alias("_p95"))
    return out.withColumn(
        "p95_value", F.when(F.col("n") >= P95_FROM, F.col("_p95")).otherwise(F.col("max_value"))
    ).drop("_p95")


def stage_report(log: DataFrame) -> DataFrame:
    """A stage log in short: ``metric, n, min_value, avg_value, p95_value, max_value``.

    One row for each of ``STAGES`` with its p95, and one for each of
    ``SIZES``; a negative size was not measured and does not count.
    """
    timed = stage_summary(unpivot(log, STAGES, "metric", "value").filter("value IS NOT NULL"), "metric", "value")
    sizes = unpivot(log, [c for c in SIZES if c in log.columns], "metric", "value").filter("value >= 0")
    basic = sizes.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"), F.avg("value").alias("avg_value"), F.max("value").alias("max_value")
    )
    return timed.unionByName(basic.withColumn("p95_value", F.lit(None).cast("double")))


def metric_summary(df: DataFrame, metric: str, value: str) -> DataFrame:
    """Min, average and max per metric."""
    return df.groupBy(metric).agg(
        F.min(value).alias("min_value"), F.avg(value).alias("avg_value"), F.max(value).alias("max_value")
    )


def profile_summary(log: DataFrame, metrics=PROFILE_METRICS) -> DataFrame:
    """``metric_summary`` over the columns of a profile log."""
    return metric_summary(unpivot(log, metrics, "metric", "value"), "metric", "value")


def phase_breakdown(df: DataFrame, phase: str, time: str) -> DataFrame:
    """Samples, first and last time per phase."""
    return df.groupBy(F.coalesce(F.col(phase), F.lit("unknown")).alias(phase)).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("first_at"), F.max(time).alias("last_at")
    )


def peak_topk(df: DataFrame, name: str, value: str, k: int = 10) -> DataFrame:
    """The ``k`` names with the highest peak."""
    peaks = df.groupBy(name).agg(F.max(value).alias("peak"))
    return peaks.orderBy(F.col("peak").desc(), name).limit(k)


def top_processes(log: DataFrame, k: int = 10) -> DataFrame:
    """The other processes with the highest CPU peak in a profile log."""
    seen = log.select(F.inline("top_other_procs"))
    return peak_topk(seen, "name", "cpu_pct", k)


def stage_intervals(log: DataFrame) -> DataFrame:
    """Stage intervals ``(stage, t0, t1)`` of a stage log."""
    fetched = F.col("wall") + F.col("fetch")
    computed = fetched + F.col("cpu_wait")
    written = computed + F.col("write_lock_wait") + F.col("write")
    spans = [("fetch", F.col("wall"), fetched), ("cpu", fetched, computed), ("write", computed, written)]
    parts = [F.struct(F.lit(n).alias("stage"), a.alias("t0"), b.alias("t1")) for n, a, b in spans]
    return log.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def concurrency_timeline(
    df: DataFrame, stage: str, start: str, end: str, last_second=None, width: int = 86_400
) -> DataFrame:
    """Intervals active in each second per stage, the second of the end included.

    Each interval adds +1 at its first second and -1 after its last; these sum
    per second before any shuffle, and a running total gives the count.  An
    interval costs two rows however long it lasts.
    """
    t0, t1 = F.floor(F.col(start)), F.floor(F.col(end))
    if last_second is not None:
        t1 = F.least(t1, F.lit(last_second))
    spans = df.select(F.col(stage), t0.alias("_t0"), t1.alias("_t1")).filter("_t1 >= _t0")
    edges = spans.select(
        stage,
        F.inline(
            F.array(
                F.struct(F.col("_t0").alias("second"), F.lit(1).alias("_d")),
                F.struct((F.col("_t1") + 1).alias("second"), F.lit(-1).alias("_d")),
            )
        ),
    )
    # At most one row per stage and second; written, as four passes read it.
    deltas = stage_table(edges.groupBy(stage, "second").agg(F.sum("_d").alias("_d")), "edges")
    levels = running_total(deltas, [stage], "second", "_d", "active", width)
    # The level holds until the next edge.
    backwards = levels.withColumn("_back", -F.col("second"))
    until = previous_value(backwards, [stage], "_back", [], "second", "_next")
    return until.filter("active > 0").select(
        stage, F.explode(F.sequence(F.col("second"), F.col("_next") - 1)).alias("second"), "active"
    )


def timeline_pivot(timeline: DataFrame, stage: str, stages) -> DataFrame:
    """One column per stage, one row per second with any activity."""
    wide = timeline.groupBy("second").pivot(stage, list(stages)).agg(F.sum("active"))
    return wide.na.fill(0, list(stages))


def rate_per_second(
    df: DataFrame, by, time: str, value: str, tie=(), interval=None, scale: float = 1.0, width: int = PIECE_ROWS
) -> DataFrame:
    """Change against the previous sample of a series, per unit of time.

    Divides by ``interval`` if it is given, otherwise by the time between the
    samples.  The first sample of a series has no rate.  ``width`` rows are
    ordered by one task.
    """
    now = F.struct(F.col(value).alias("value"), F.col(time).alias("time"))
    df = previous_value(df.withColumn("_now", now), by, time, tie, "_now", "_last", width)
    change = F.col(value) - F.col("_last.value")
    if interval is None:
        span = F.nullif(F.col(time) - F.col("_last.time"), F.lit(0))
    else:
        span = F.lit(interval)
    return df.withColumn("rate", change / span / F.lit(scale)).drop("_now", "_last")
