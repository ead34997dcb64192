from __future__ import annotations

import random

import pytest

from curata.operators import ordered as O
from curata.operators import sampling as P


def ranges(spark, rows):
    return spark.createDataFrame(rows, "shard_id string, offset bigint, size bigint")


@pytest.mark.parametrize(
    "rows, gap, want",
    [
        ([("s0", 512, 1000)], 64, [("s0", 512, 1512, 1)]),
        ([("s0", 100, 50), ("s0", 200, 50)], 100, [("s0", 100, 250, 2)]),
        ([("s0", 100, 50), ("s0", 1000, 50)], 10, [("s0", 100, 150, 1), ("s0", 1000, 1050, 1)]),
        ([("s0", 100, 50), ("s1", 100, 50)], 10000, [("s0", 100, 150, 1), ("s1", 100, 150, 1)]),
        ([("s0", 500, 50), ("s0", 100, 50), ("s0", 300, 50)], 200, [("s0", 100, 550, 3)]),
        ([("s0", 0, 10), ("s0", 30, 10)], 20, [("s0", 0, 40, 2)]),  # gap at the threshold
        ([("s0", 0, 10), ("s0", 31, 10)], 20, [("s0", 0, 10, 1), ("s0", 31, 41, 1)]),
        ([("s0", 0, 100), ("s0", 10, 5), ("s0", 105, 5)], 10, [("s0", 0, 110, 3)]),  # nested
        ([("s0", 0, 10), ("s0", 0, 10), ("s0", 0, 30)], 0, [("s0", 0, 30, 3)]),  # shared blob
    ],
)
@pytest.mark.parametrize("segment", [7, 1 << 20])
def test_read_groups(spark, rows, gap, want, segment):
    got = P.coalesce_ranges(ranges(spark, rows), gap=gap, segment=segment)
    assert sorted(tuple(r)[:4] for r in got.select("shard_id", "byte_start", "byte_end", "n_entries").collect()) == want


@pytest.mark.parametrize("seed", range(4))
def test_read_groups_against_a_scan(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{rng.choice([0, 0, 0, 1, 2])}", rng.randrange(3000), rng.randrange(1, 120)) for _ in range(300)]
    gap = rng.randrange(0, 20)
    want = []
    for shard in sorted({r[0] for r in rows}):
        group = None
        for _, start, size in sorted(r for r in rows if r[0] == shard):
            if group and start - group[1] <= gap:
                group[1], group[2] = max(group[1], start + size), group[2] + 1
            else:
                group = [start, start + size, 1]
                want.append((shard, group))
    got = P.coalesce_ranges(ranges(spark, rows), gap=gap, segment=97)
    cells = sorted(tuple(r) for r in got.select("shard_id", "byte_start", "byte_end", "n_entries").collect())
    assert cells == sorted((s, *g) for s, g in want)


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        (f"pdb{c:03d}", chain, f"cluster_{c % 7}", "shard/000000", 512 + c * 2048, 1024)
        for c in range(20)
        for chain in "ABC"
    ]
    return spark.createDataFrame(
        rows, "pdb string, chain string, foldseek_70 string, shard_id string, offset bigint, size bigint"
    )


def plan(index, **kwargs):
    return [tuple(r) for r in P.epoch_plan(index, "foldseek_70", gap=0, **kwargs).orderBy("worker_id", "step").collect()]


def test_epoch_plans(index):
    assert P.epoch_sample(index, "foldseek_70").count() == 7
    assert plan(index, epoch=1) == plan(index.repartition(9), epoch=1)
    assert plan(index, epoch=1) != plan(index, epoch=2)
    assert plan(index, epoch=1, fixed=True) == plan(index, epoch=2, fixed=True)


def test_workers_share_all_reads_without_overlap(index):
    got = P.epoch_plan(index, "foldseek_70", num_workers=3, gap=0).toPandas()
    assert not got.byte_start.duplicated().any()
    for worker, rows in got.groupby("worker_id"):
        assert sorted(rows.step) == list(range(len(rows)))
    sizes = got.groupby("worker_id").size()
    assert sizes.max() - sizes.min() <= 1


def test_resume_is_a_suffix(index):
    whole = P.epoch_plan(index, "foldseek_70", num_workers=2, gap=0)
    rest = P.resume_plan(whole, 2)
    assert sorted(map(tuple, rest.collect())) == sorted(tuple(r) for r in whole.collect() if r.step >= 2)


def test_dense_index_and_prefix_sum_in_pieces(spark):
    rows = [("hot", f"k{i}", i % 11) for i in range(500)] + [("cold", f"k{i}", 3) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, k string, v bigint")
    for digits in (1, 3):
        numbered = O.dense_index(df, 1, ["k"], "i", by=["g"], digits=digits).toPandas()
        for _, part in numbered.groupby("g"):
            assert sorted(part.i) == list(range(len(part)))
        sums = O.prefix_sum(df, 1, ["g"], ["k"], "v", "s", digits=digits).toPandas().merge(numbered)
        for _, part in sums.groupby("g"):
            part = part.sort_values("i")
            assert list(part.s) == [0, *part.v.cumsum()[:-1]]


def test_running_total_and_previous_value_across_segments(spark):
    rng = random.Random(2)
    rows = [("a", t, rng.randrange(10)) for t in sorted(rng.sample(range(1000), 200))]
    df = spark.createDataFrame(rows, "g string, t bigint, v bigint")
    total = {r.t: r.s for r in O.running_total(df, ["g"], "t", "v", "s", 50).collect()}
    before = {r.t: r.p for r in O.previous_value(df, ["g"], "t", [], "v", "p", 50).collect()}
    run, last = 0, None
    for _, t, v in rows:
        run += v
        assert total[t] == run and before[t] == last
        last = v


def test_read_once(spark, index):
    blobs = spark.createDataFrame([("pdb000", 512, "x"), ("pdb999", 1, "y")], "pdb string, offset bigint, blob string")
    got = P.read_once(index.select("pdb", "chain", "offset"), blobs).collect()
    assert sorted((r.pdb, r.chain, r.blob) for r in got) == [("pdb000", c, "x") for c in "ABC"]
