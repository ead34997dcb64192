"""Streaming forms: ingest, running metrics, activity, bursts and resume.

Every query has its checkpoint beside its output in shared storage, so a
restart continues where the last committed batch ended.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators.ordered import previous_value, running_total, top_per_group
from curata.session import stage, table_exists

BUCKETS = 64


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(writer) -> object:
    """Process what has arrived and stop; the finished query."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def bucket_of(keys) -> Column:
    """The bucket of a key: a hash of its columns."""
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def present(df: DataFrame) -> list[int]:
    """The buckets that a table has rows in: at most ``BUCKETS`` numbers."""
    return sorted(row.bucket for row in df.select("bucket").distinct().collect())


def logged(spark: SparkSession, path: str, before: int, buckets: list[int]) -> DataFrame:
    """What the ingest logged in batches before this number, in these buckets; no other folder is read."""
    rows = spark.read.option("basePath", f"{path}/index").parquet(f"{path}/index")
    return rows.filter((F.col("batch") < before) & F.col("bucket").isin(buckets))


def start_ingest(records: DataFrame, path: str, key: str, index_columns) -> object:
    """A writer that stores arriving records once and logs them after they are stored.

    Each micro-batch keeps one record per key, the first in order of the index
    columns, drops keys that earlier batches logged, writes the records, and
    only then their index rows.  Both go to a folder of that batch, so a batch
    that runs again replaces its own output.  The index lies in buckets of the
    key's hash, and a batch reads the buckets of its own keys alone: one of a
    few keys reads a few folders however long the index has grown.
    """
    index_columns = list(index_columns)

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = top_per_group(batch, [key], [F.col(c) for c in index_columns], 1).withColumn("bucket", bucket_of([key]))
        if number and table_exists(spark, f"{path}/index/batch=0"):
            first = stage(first, "arrived")
            done = logged(spark, path, number, present(first))
            first = first.join(done.select("bucket", key), ["bucket", key], "left_anti")
        data, index = f"{path}/data/batch={number}", f"{path}/index/batch={number}"
        first.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        stored = spark.read.schema(first.schema).parquet(data)
        rows = stored.select(key, *[c for c in index_columns if c != key], "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(index)

    return records.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint")


def ingested(spark: SparkSession, path: str, part: str = "index") -> DataFrame:
    """What the ingest has logged (``index``) or stored (``data``)."""
    return spark.read.option("basePath", f"{path}/{part}").parquet(f"{path}/{part}").drop("batch", "bucket")


def running_metrics(metrics: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Running value per key over a stream of per-batch metric rows.

    ``metrics`` has ``key, reduction, value, n``; sums and means add up,
    extremes fold, ``last`` takes the row of the latest batch.
    """
    r = F.col("reduction")
    folded = metrics.groupBy("key", "reduction").agg(
        F.sum("value").alias("_sum"),
        F.sum("n").alias("_n"),
        F.max("value").alias("_max"),
        F.min("value").alias("_min"),
        F.max(F.struct(batch, "value")).alias("_last"),
    )
    value = (
        F.when(r == "max", F.col("_max"))
        .when(r == "min", F.col("_min"))
        .when(r == "last", F.col("_last.value"))
        .otherwise(F.col("_sum") / F.greatest(F.lit(1), F.col("_n")))
    )
    return folded.select("key", "reduction", value.alias("value"))


def start_updates(df: DataFrame, path: str, keys) -> object:
    """A writer for changing results: each micro-batch merges its changed keys into one current table.

    The table lies in buckets of the keys' hash.  A batch writes the buckets
    it touches anew, under its own number, and then a manifest that names the
    number of every bucket; readers follow the newest manifest.  What neither
    the new manifest nor the one before it names is deleted, so the table
    grows with the keys, not with the batches.  A batch that runs again
    starts from the manifest before it and writes the same.
    """
    keys = list(keys)

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed = stage(batch.withColumn("bucket", bucket_of(keys)), "changed")
        touched = present(changed)
        if not touched:
            return
        before = _manifest(spark, path, number)
        held = {b: n for b, n in before.items() if b in touched}
        if held:
            kept = _buckets(spark, path, held).join(changed.select(*keys), keys, "left_anti")
            changed = changed.unionByName(kept.select(changed.columns))
        version = f"{path}/data/version={number}"
        changed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(version)
        after = before | {b: number for b in touched}
        rows = spark.createDataFrame(sorted(after.items()), "bucket int, version long").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{path}/manifest/version={number}")
        _drop_unnamed(spark, path, before, after)

    return df.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint")


def _versions(spark: SparkSession, path: str) -> list[tuple[int, object]]:
    """Numbers and paths of the folders ``version=n`` under ``path``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [status.getPath() for status in files.listStatus(root)]
    return sorted((int(n.getName().split("=")[1]), n) for n in names if n.getName().startswith("version="))


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Bucket to version in the newest finished manifest (of those before a number)."""
    for number, _ in reversed(_versions(spark, f"{path}/manifest")):
        folder = f"{path}/manifest/version={number}"
        if (before is None or number < before) and table_exists(spark, folder):
            return {row.bucket: row.version for row in spark.read.parquet(folder).collect()}
    return {}


def _buckets(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame:
    folders = [f"{path}/data/version={n}/bucket={b}" for b, n in sorted(versions.items())]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("version")


def _drop_unnamed(spark: SparkSession, path: str, *manifests: dict[int, int]) -> None:
    """Delete buckets of versions that no reader and no repeated batch may still follow."""
    named = {(bucket, number) for manifest in manifests for bucket, number in manifest.items()}
    newest = max(number for _, number in named)
    for number, folder in _versions(spark, f"{path}/data"):
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.listStatus(folder) if number < newest else ():
            name = status.getPath().getName()
            if name.startswith("bucket=") and (int(name.split("=")[1]), number) not in named:
                files.delete(status.getPath(), True)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest value of every key."""
    return _buckets(spark, path, _manifest(spark, path)).drop("bucket")


def stage_activity(intervals: DataFrame, stage: str, start: str, end: str, delay: str) -> DataFrame:
    """Intervals that start and end in each second per stage, for seconds the watermark has passed.

    An interval is two rows however long it lasts, at its first and its last
    second; they add up before any shuffle, so a hot stage is many keys.
    ``activity_levels`` turns the finished seconds into active intervals.
    """
    edge = lambda c, starts, ends: F.struct(
        F.date_trunc("second", c).alias("_at"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends")
    )
    edges = intervals.filter(F.col(end) >= F.col(start)).select(stage, F.inline(F.array(edge(start, 1, 0), edge(end, 0, 1))))
    return (
        edges.withWatermark("_at", delay)
        .groupBy(F.window("_at", "1 second"), stage)
        .agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
        .select(stage, F.unix_seconds("window.start").alias("second"), "starts", "ends")
    )


def watermark(query) -> int | None:
    """Seconds of the event time that a finished query has passed, or None if it had nothing to do."""
    progress = query.lastProgress
    text = progress["eventTime"].get("watermark") if progress else None
    return int(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp()) if text else None


def activity_levels(edges: DataFrame, stage: str, until: int, width: int = 86_400) -> DataFrame:
    """``stage, second, active``: intervals active in each second that ends by ``until``.

    An interval counts in its first second, its last one, and all between.
    """
    known = edges.filter(F.col("second") < until).withColumn("_d", F.col("starts") - F.col("ends"))
    levels = running_total(known, [stage], "second", "_d", "_after", width)
    nexts = previous_value(levels.withColumn("_back", -F.col("second")), [stage], "_back", [], "second", "_next")
    between = F.when(
        F.col("second") + 1 < F.coalesce("_next", F.lit(until)),
        F.transform(
            F.sequence(F.col("second") + 1, F.coalesce("_next", F.lit(until)) - 1),
            lambda s: F.struct(s.alias("second"), F.col("_after").alias("active")),
        ),
    )
    here = F.array(F.struct(F.col("second"), (F.col("_after") + F.col("ends")).alias("active")))
    every = F.concat(here, F.coalesce(between, F.array().cast("array<struct<second:bigint,active:bigint>>")))
    return nexts.select(stage, F.inline(every)).filter("active > 0")


def bursts(events: DataFrame, by: str, time: str, gap: str, delay: str) -> DataFrame:
    """Events of a key that follow each other within ``gap``, once the burst is over."""
    return (
        events.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("_session"), by)
        .agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))
        .drop("_session")
    )


def start_append(df: DataFrame, path: str) -> object:
    """A writer for final results as Parquet files."""
    return (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
    )


def resume_from(plan: DataFrame, state: DataFrame) -> DataFrame:
    """Skip the finished steps of each split.

    ``state`` has one row ``split, epoch, step`` per split, ``plan`` has
    ``split, epoch, step``; splits without state start from the beginning.
    """
    at = state.select("split", F.col("epoch").alias("_epoch"), F.col("step").alias("_step"))
    ahead = (F.col("epoch") > F.col("_epoch")) | (
        (F.col("epoch") == F.col("_epoch")) & (F.col("step") >= F.col("_step"))
    )
    return plan.join(at, "split", "left").filter(F.col("_epoch").isNull() | ahead).drop("_epoch", "_step")
