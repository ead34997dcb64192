from __future__ import annotations

import random

import pytest

from curata.operators import profile as O


@pytest.mark.parametrize("n", [1, 19, 20, 21, 2000])
def test_p95_is_exact(spark, n):
    rng = random.Random(n)
    values = [rng.choice([1.0, 2.0, rng.random() * 100]) for _ in range(n)]
    df = spark.createDataFrame([("s", v) for v in values], "stage string, value double").repartition(5)
    row = O.stage_summary(df, "stage", "value").first()
    ordered = sorted(values)
    want = ordered[int(n * 0.95)] if n >= 20 else ordered[-1]
    assert (row.p95_value, row.min_value, row.max_value, row.n) == (want, ordered[0], ordered[-1], n)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.95, 0.999])
def test_ranked_value_with_a_coarse_bracket(spark, share):
    rng = random.Random(1)
    rows = [(g, float(rng.randrange(50) if g == "ties" else rng.random())) for g in ("ties", "free") for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r.x for r in O.ranked_value(df, "g", "v", share, "x", accuracy=100).collect()}
    for g in got:
        ordered = sorted(v for h, v in rows if h == g)
        assert got[g] == ordered[int(share * len(ordered))]


def test_timeline_counts_the_end_second(spark):
    rows = [("a", 0.5, 2.0), ("a", 1.0, 1.2), ("a", 5.0, 5.0), ("b", 0.0, 9.9), ("b", 3.0, 2.0)]
    df = spark.createDataFrame(rows, "stage string, t0 double, t1 double")
    got = {(r.stage, r.second): r.active for r in O.concurrency_timeline(df, "stage", "t0", "t1", last_second=8, width=3).collect()}
    want = {("a", 0): 1, ("a", 1): 2, ("a", 2): 1, ("a", 5): 1} | {("b", s): 1 for s in range(9)}
    assert got == want
    wide = O.timeline_pivot(O.concurrency_timeline(df, "stage", "t0", "t1"), "stage", ["a", "b"])
    assert {r.second: (r.a, r.b) for r in wide.collect()}[1] == (2, 1)


def test_stage_log_summaries(spark):
    log = spark.createDataFrame([(0.0, 1.0, 2.0, 0.5, 0.5)], "wall double, fetch double, cpu_wait double, write_lock_wait double, write double")
    spans = {r.stage: (r.t0, r.t1) for r in O.stage_intervals(log).collect()}
    assert spans == {"fetch": (0, 1), "cpu": (1, 3), "write": (3, 4)}
    phases = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", 3.0)], "phase string, t double")
    got = {r.phase: (r.n, r.first_at, r.last_at) for r in O.phase_breakdown(phases, "phase", "t").collect()}
    assert got == {"a": (2, 1.0, 3.0), "unknown": (1, 2.0, 2.0)}


def test_rates(spark):
    df = spark.createDataFrame([("p", 0, 10.0), ("p", 2, 30.0), ("p", 5, 30.0)], "k string, t bigint, v double")
    rates = O.rate_per_second(df, ["k"], "t", "v", width=2).orderBy("t")
    assert [r.rate for r in rates.collect()] == [None, 10.0, 0.0]
    fixed = O.rate_per_second(df, ["k"], "t", "v", interval=4.0, scale=5.0).orderBy("t")
    assert [r.rate for r in fixed.collect()] == [None, 1.0, 0.0]


def test_peaks(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 5.0), ("x", 7.0), ("z", 5.0)], "name string, v double")
    assert [(r.name, r.peak) for r in O.peak_topk(df, "name", "v", 2).collect()] == [("x", 7.0), ("y", 5.0)]
