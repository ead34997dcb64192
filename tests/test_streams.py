from __future__ import annotations

from pyspark.sql import functions as F

from curata.queries import streams


def test_parts_arrive_as_the_files_of_their_tasks(spark, tmp_path, monkeypatch):
    """One micro-batch a part, however many files; no single task writes or reads a whole part."""
    monkeypatch.setattr(streams, "staging_path", lambda _, label: f"{tmp_path}/{label}")
    events = spark.range(600).select(
        F.col("id").alias("event_id"), F.concat(F.lit("t"), F.col("id") % 2).alias("event_type"), (F.col("id") % 7).cast("double").alias("value")
    )
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams, "table", lambda s, folder, name: s.read.parquet(f"{folder}/{name}.parquet").repartition(4))
    got = {(r.key, r.reduction): r.value for r in streams.stream_running_metrics(spark, str(tmp_path)).collect()}
    for key in (0, 1):
        values = [i % 7 for i in range(600) if i % 2 == key]
        assert got[f"t{key}", "sum"] == round(sum(values) / (2 * len(values)), 6)
        assert got[f"t{key}", "last"] == (598 + key) % 7
    for k in range(3):
        assert len(list((tmp_path / "arrivals" / f"part={k}").glob("*.parquet"))) == 4
    offsets = [p.name for p in (tmp_path / "running" / "checkpoint" / "offsets").iterdir() if p.name.isdigit()]
    assert sorted(offsets) == ["0", "1", "2"]
