from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from curata.functions.hashing import below, epoch_seed, uniform, union_share
from curata.operators import select as S
from curata.schema import check_cluster_column, cluster_column


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(5)
    rows = [
        (f"p{rng.randrange(400):03d}", f"{i}", f"a{rng.randrange(300)}", f"b{rng.randrange(200)}") for i in range(2000)
    ]
    rows += [("hot", f"h{i}", f"a{rng.randrange(300)}", f"b{rng.randrange(200)}") for i in range(1000)]
    return spark.createDataFrame(rows, "pdb string, chain string, foldseek_70 string, mmseqs_30 string").cache()


COLUMNS = ["foldseek_70", "mmseqs_30"]


@pytest.mark.parametrize("mode", ["md5", "xxhash64"])
def test_train_shares_no_record_and_no_cluster(index, mode):
    rows = S.leakage_safe_split(index, COLUMNS, (0.8, 0.1, 0.1), mode=mode).toPandas()
    train, held = rows[rows.split == "train"], rows[rows.split != "train"]
    assert len(train) and len(held)
    assert not set(train.pdb) & set(held.pdb)
    for c in COLUMNS:
        # a train row has no cluster whose hash puts it into test or validation
        tests = set(rows[rows.split == "test"][c]) if c else set()
        assert not (set(train[c]) & {x for x in tests if _is_low(index, c, x, mode)})
    per_record = rows.groupby("pdb").split.nunique()
    assert per_record.max() == 1


def _is_low(index, column, value, mode):
    from curata.functions.hashing import TEST_SEED

    spark = index.sparkSession
    share = union_share(0.1, 2)
    return spark.range(1).select(below(share, TEST_SEED, F.lit(value), mode=mode).alias("x")).first().x


def test_split_does_not_depend_on_partitioning(index):
    a = S.leakage_safe_split(index, COLUMNS).orderBy("pdb", "chain").collect()
    b = S.leakage_safe_split(index.repartition(13), COLUMNS).orderBy("pdb", "chain").collect()
    assert a == b


def test_promote_keeps_every_row(index):
    assert S.leakage_safe_split(index, COLUMNS, on_conflict="promote").count() == index.count()


def test_split_arguments(index):
    with pytest.raises(ValueError):
        S.leakage_safe_split(index, COLUMNS, (0.9, 0.2, 0.1))
    with pytest.raises(ValueError):
        S.leakage_safe_split(index, ["absent_30"])


def test_shares_are_close_to_the_target(spark):
    rows = spark.range(20000).select(*[below(0.2, 7, "id", mode=m).alias(m) for m in ("md5", "xxhash64")])
    got = rows.agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in ("md5", "xxhash64")]).first()
    assert abs(got.md5 - 0.2) < 0.01 and abs(got.xxhash64 - 0.2) < 0.01
    low, high = spark.range(5000).select(uniform(1, "id").alias("u")).agg(F.min("u"), F.max("u")).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1


def test_nan_passes_lower_bounds_and_null_does_not(spark):
    nan = float("nan")
    rows = [(1, 2.0, nan, nan), (2, nan, nan, nan), (3, 4.0, 0.9, 0.9), (4, 3.5, 0.7, 0.7), (5, 2.0, None, nan)]
    df = spark.createDataFrame(rows, "id int, resolution double, mean_plddt double, ptm double")
    assert sorted(r.id for r in S.quality_filter(df).collect()) == [1, 4]


def test_limits(index):
    one = S.limit_clusters(index, "foldseek_70", ["pdb", "chain"], 5, 2).toPandas()
    first = sorted(index.toPandas().foldseek_70.unique())[:5]
    assert set(one.foldseek_70) == set(first)
    assert one.groupby("foldseek_70").size().max() == 2


def test_large_limits_per_cluster_use_salts_and_stay_exact(index):
    k = 1001
    hot = index.withColumn("one", F.lit("x"))
    got = S.limit_clusters(hot, "one", ["pdb", "chain"], max_samples_per_cluster=k).select("pdb", "chain").collect()
    want = index.orderBy("pdb", "chain").limit(k).select("pdb", "chain").collect()
    assert sorted(got) == sorted(want)


def test_summary_shares(index):
    rows = S.split_summary(S.leakage_safe_split(index, COLUMNS), "foldseek_70").toPandas()
    assert abs(rows.samples_pct.sum() - 100) < 1e-9 and abs(rows.clusters_pct.sum() - 100) < 1e-9


def test_column_names():
    assert cluster_column("foldseek", 0.29) == "foldseek_29"
    assert cluster_column("mmseqs", 0.05) == "mmseqs_05"
    check_cluster_column("mmseqs_100")
    for bad in ("mmseqs", "mmseqs_5", "other_30"):
        with pytest.raises(ValueError):
            check_cluster_column(bad)


def test_epoch_seeds():
    assert epoch_seed(42, 3, fixed=True) == 42
    assert epoch_seed(42, 0) == 42 and epoch_seed(42, 1) != epoch_seed(42, 2)
