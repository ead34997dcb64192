from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException

from curata.operators import packing as K
from curata.queries import assemblies


def rule(samples, budget, buffer_size):
    """Batches of a single stream of (id, length), by the written rule."""
    waiting, batches, batch, used = [], [], [], 0

    def step():
        nonlocal batch, used
        if used and used + min(w[1] for w in waiting) > budget:
            batches.append(batch)
            batch, used = [], 0
        fits = [w for w in waiting if w[1] <= budget - used]
        pick = max(fits, key=lambda w: (w[1], w[2]))
        waiting.remove(pick)
        batch.append(pick[0])
        used += pick[1]

    for arrival, (name, length) in enumerate(samples):
        waiting.append((name, length, arrival))
        if len(waiting) >= buffer_size:
            step()
    while waiting:
        step()
    return batches + ([batch] if batch else [])


def plan(spark, samples, workers=1):
    rows = [(i % workers, i // workers, name, length) for i, (name, length) in enumerate(samples)]
    return spark.createDataFrame(rows, "worker_id int, step bigint, sample_id string, len bigint")


def batches_of(packed):
    out = {}
    for r in packed.orderBy("batch_id", "sample_idx").collect():
        out.setdefault((r.worker_id, *map(int, r.batch_id.split("/")[1:])), []).append(r.sample_id)
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize("seed", range(4))
def test_one_worker_follows_the_rule(spark, seed):
    rng = random.Random(seed)
    samples = [(f"s{i}", rng.choice([5, 10, rng.randrange(1, 100)])) for i in range(300)]
    packed = K.pack_batches(plan(spark, samples).repartition(7), 100, 8)
    assert batches_of(packed) == rule(samples, 100, 8)


def test_every_sample_once_and_batches_within_budget(spark):
    rng = random.Random(9)
    samples = [(f"s{i}", rng.randrange(1, 64)) for i in range(1000)]
    packed = K.pack_batches(plan(spark, samples, 5), 64, 16)
    rows = packed.toPandas()
    assert sorted(rows.sample_id) == sorted(s for s, _ in samples)
    assert rows.groupby("batch_id").len.sum().max() <= 64
    spans = K.prefix_lengths(packed).toPandas()
    assert (spans[spans.sample_idx == 0].cu_start == 0).all() and (spans.cu_end - spans.cu_start == spans.len).all()


def test_lanes_are_streams_of_their_own(spark):
    samples = [(f"s{i}", 1 + i % 7) for i in range(100)]
    lanes = plan(spark, samples).selectExpr("*", "step div 40 as lane")
    packed = K.pack_batches(lanes, 10, 4, lane="lane")
    want = rule(samples[:40], 10, 4) + rule(samples[40:80], 10, 4) + rule(samples[80:], 10, 4)
    assert batches_of(packed) == want


def test_oversized_samples_are_refused(spark):
    with pytest.raises(PySparkException, match="longer than the batch budget"):
        K.pack_batches(plan(spark, [("big", 11)]), 10, 4).collect()


def test_collate_drops_failed_samples(spark):
    packed = spark.createDataFrame(
        [("b", 0, "x"), ("b", 1, "y"), ("b", 2, "z"), ("c", 0, "y")], "batch_id string, sample_idx int, sample_id string"
    )
    samples = spark.createDataFrame([("x", [1, 2]), ("z", [3, 4, 5]), ("y", [])], "sample_id string, labels array<int>")
    row = K.collate(packed, samples, ["labels"]).collect()
    assert len(row) == 1
    row = row[0]
    assert (row.batch_id, row.labels, row.sample_idx, row.cu_seqlens) == ("b", [1, 2, 3, 4, 5], [0, 0, 1, 1, 1], [0, 2, 5])
    assert (row.max_seqlen, row.samples, row.sample_ids) == (3, 2, ["x", "z"])


def test_a_sample_over_the_budget_is_a_batch_of_its_own(spark):
    samples = [("x", 250), ("a", 40), ("b", 50), ("y", 101), ("c", 60), ("z", 0), ("d", 100)]
    for buffer_size in (1, 3, 16):
        batches = batches_of(K.pack_batches(plan(spark, samples), 100, buffer_size, alone=True))
        assert sorted(s for b in batches for s in b) == sorted(s for s, _ in samples)
        sizes = dict(samples)
        assert all(len(b) == 1 or sum(sizes[s] for s in b) <= 100 for b in batches)
    first = K.pack_batches(plan(spark, samples[:1]), 100, 8, alone=True).collect()
    assert [(r.batch_id, r.sample_idx) for r in first] == [("0/0/0", 0)]


def test_documents_over_the_budget_are_packed(spark, tmp_path):
    lengths = [300_000, 70_000, 10, 20, 65_536]
    rows = [(i, "x" * n) for i, n in enumerate(lengths)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.len for r in assemblies.pack_lanes(spark, str(tmp_path)).collect()) == sorted(lengths)
    batches = assemblies.pack_documents(spark, str(tmp_path)).collect()
    assert sum(r.tokens for r in batches) == sum(lengths)
    assert all(r.tokens <= 4 * 65_536 or r.samples == 1 for r in batches)
