from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.functions import masks, residues
from curata.operators import corruption, metrics as M
from curata.plans import evaluate, registry

SCHEMA = (
    "batch_id bigint, pos int, logits array<double>, label int, loss_mask boolean, is_masked boolean, "
    "timestep int, seq_len int, x double"
)


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(0)
    rows = []
    for b, n in ((0, 30), (1, 7), (2, 5)):
        for i in range(n):
            rows.append((b, i, rng.normal(size=20).tolist(), int(rng.integers(0, 27)) if b else int(rng.integers(0, 20)),
                         bool(rng.random() < 0.7) and b != 2, bool(rng.random() < 0.5), int(rng.integers(0, 1100)),
                         [100, 256, 1024][i % 3], float(rng.normal())))
    rows = [(*r[:3], r[3], r[4] and r[3] < 20, *r[5:]) for r in rows]
    return spark.createDataFrame(rows, SCHEMA).cache()


def loss(row):
    z = np.array(row.logits)
    return float(np.log(np.exp(z - z.max()).sum()) + z.max() - z[row.label])


def as_dict(df):
    return {(r.batch_id, r.key): (r.value, r.n) for r in df.collect()}


def test_values_and_empty_masks(predictions):
    terms = [M.Term("ce", "cel", ("mean", "sum", "max", "min"), 2.0, (M.Mask("per_label_masks"),)), M.Term("acc", "matches", ("mean",))]
    got = as_dict(M.with_total(M.batch_metrics(predictions, terms)))
    rows = predictions.collect()
    for b in (0, 1):
        ours = [loss(r) for r in rows if r.batch_id == b and r.loss_mask]
        assert got[b, "ce/mean"] == (pytest.approx(sum(ours)), len(ours))
        assert got[b, "ce/max"] == (pytest.approx(max(ours)), 1) and got[b, "ce/sum"][1] == 1
        assert got[b, "full_loss/sum"][0] == pytest.approx(2 * sum(ours) / len(ours))
        hits = [float(np.argmax(r.logits) == r.label) for r in rows if r.batch_id == b and r.loss_mask]
        assert got[b, "acc/mean"] == (sum(hits), len(hits))
    # the third batch is fully masked
    assert got[2, "ce/mean"] == (0.0, 0) and got[2, "ce/max"] == (-math.inf, 1) and got[2, "ce/min"] == (math.inf, 1)
    assert got[2, "full_loss/sum"] == (0.0, 1)
    for name in residues.label_names(20):
        own = [loss(r) for r in rows if r.batch_id == 0 and r.loss_mask and residues.LETTERS[r.label] == name]
        assert got[0, f"ce/mean/{name}"] == (pytest.approx(sum(own)), len(own))


def test_bins_are_half_open(spark):
    df = spark.createDataFrame([(0,), (255,), (256,), (1023,), (1024,), (5000,)], "seq_len int")
    group = masks.binned_masks("seq_len", 1024, 4)
    assert group.names == ["0-256", "256-512", "512-768", "768-1024"]
    assert [r.m for r in df.select(group.member.alias("m")).collect()] == ["0-256", "0-256", "256-512", "768-1024", None, None]
    assert masks.timestep_binned_masks("t", 10, 4).names == ["t0-2", "t2-5", "t5-7", "t7-10"]


def test_accumulation_over_batches(predictions):
    terms = [M.Term("ce", "cel", ("mean", "sum", "max")), M.Term("w", "identity", ("last",), kwargs={"x": "x"})]
    per_batch = M.batch_metrics(predictions, terms, order="pos")
    got = {r.key: r.value for r in M.accumulate(per_batch).collect()}
    rows = [r for r in predictions.collect() if r.loss_mask]
    every = [loss(r) for r in rows]
    assert got["ce/mean"] == pytest.approx(sum(every) / len(every))
    assert got["ce/sum"] == pytest.approx(sum(every) / 3)  # the average of three per-batch sums
    assert got["ce/max"] == pytest.approx(max(every))
    # splitting the token stream differently leaves the mean alone
    other = predictions.withColumn("batch_id", F.col("pos").cast("bigint") % 2)
    again = {r.key: r.value for r in M.accumulate(M.batch_metrics(other, terms, order="x")).collect()}
    assert again["ce/mean"] == pytest.approx(got["ce/mean"])


def test_plans_and_ratios(predictions, spark):
    accumulated = evaluate.evaluate(predictions, "seq_len_binned")
    keys = {r.key for r in accumulated.collect()}
    assert {"seq_cel/mean", "seq_cel/sum/0-256", "seq_acc/mean/768-1024", "full_loss/sum"} <= keys
    batches = spark.createDataFrame([(100, 40, 4), (50, 10, 1)], "tokens bigint, loss_tokens bigint, samples bigint")
    out = {r.key: r.value for r in evaluate.step_metrics(accumulated, batches, 2.0, "train", 1, 1).collect()}
    assert out["train/data/toks_per_batch"] == 75 and out["train/throughput/toks_per_sec"] == 75
    assert out["train/data/loss_toks_pct"] == pytest.approx(50 / 150) and out["train/throughput/updates_per_sec"] == 0.5
    empty = batches.filter("tokens < 0")
    assert all(r.value in (0.0, None) for r in evaluate.step_metrics(accumulated.limit(0), empty, 2.0, "val").collect())


def test_names_are_checked():
    for bad in (lambda: M.Term("a", "nope"), lambda: M.Term("a", "cel", ("median",)), lambda: M.Mask("nope")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        registry.lookup("metric", "nope")
    registry.register("metric", "twice", lambda x="x", mask="loss_mask": F.col(x) * 2)
    assert M.Term("t", "twice").fn == "twice"
    with pytest.raises(ValueError):
        registry.register("metric", "twice", lambda: None)
    registry.unregister("metric", "twice")


def residue_rows(spark):
    return spark.range(4000).select((F.col("id") / 200).cast("int").alias("sample_id"), (F.col("id") % 200).alias("pos"), (F.col("id") % 25).cast("int").alias("label"))


def test_corruption(spark):
    rows = residue_rows(spark)
    only = F.col("label") < 20
    out = corruption.corrupt_labels(rows, 1, "constant", rate=0.3, only_mask=only).toPandas()
    hit = out[out.is_corrupted]
    assert 0.2 < len(hit) / (out.label < 20).sum() < 0.4 and (hit.label < 20).all() and hit.corrupted_label.between(0, 19).all()
    assert (out[~out.is_corrupted].label == out[~out.is_corrupted].corrupted_label).all()
    masked = corruption.corrupt_labels(rows, 1, "constant", rate=0.3, random_label=False).toPandas()
    assert (masked[masked.is_corrupted].corrupted_label == residues.MASK).all()
    none = corruption.corrupt_labels(rows, 1, "none", also_mask=F.col("pos") == 0).toPandas()
    assert (none.is_corrupted == (none.pos == 0)).all()
    linear = corruption.corrupt_labels(rows, 1, "linear", 10).toPandas()
    assert linear.groupby("sample_id").t.nunique().max() == 1 and linear.t.between(0, 9).all()
    assert not linear[linear.t == 0].is_corrupted.any()
    same = corruption.corrupt_labels(rows.repartition(7), 1, "linear", 10).toPandas()
    key = ["sample_id", "pos"]
    assert linear.sort_values(key).corrupted_label.tolist() == same.sort_values(key).corrupted_label.tolist()
    inverted = corruption.corrupt_labels(rows, 1, "constant", rate=0.3, compat_inverted=True).toPandas()
    assert (inverted[inverted.is_corrupted].label == inverted[inverted.is_corrupted].corrupted_label).all()
    with pytest.raises(ValueError):
        corruption.corrupt_labels(rows, 1, "cosine")
