"""A third of all rows on one key: the same results, and no step that takes the key whole."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from curata.operators import layout, ordered, profile, sampling, select
from curata.session import spread, staging_root

N = 30_000


@pytest.fixture(scope="module")
def skewed(spark):
    hot = F.col("id") % 3 == 0
    key = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n))
    return spark.range(N).select(
        F.col("id"),
        F.when(hot, -1).otherwise(key(500, 1)).alias("pdb"),
        F.when(hot, -1).otherwise(key(300, 2)).alias("c1"),
        key(200, 3).alias("c2"),
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("s"), key(9, 4).cast("string"))).alias("source"),
        key(1 << 22, 5).alias("offset"),
        (key(900, 6) + 1).alias("size"),
    ).cache()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_split_has_no_window_over_records(skewed):
    out = select.leakage_safe_split(skewed, ["c1", "c2"], (0.8, 0.1, 0.1))
    assert "Window" not in plan_of(out)
    assert out.groupBy("pdb").agg(F.count_distinct("split").alias("n")).agg(F.max("n")).first()[0] == 1


def test_first_rows_are_limited_before_the_shuffle(skewed):
    plan = plan_of(sampling.epoch_sample(skewed, "c1", ["id"]))
    assert len(re.findall("WindowGroupLimit", plan)) == 2


def test_pieces_of_the_hot_source_are_small(skewed):
    pieces = ordered.hash_order(skewed, 0, ["id"]).groupBy("source", "_piece").count()
    assert pieces.agg(F.max("count")).first()[0] < N / 3 / 100
    placed = layout.byte_layout(skewed.select("id", "source", "size"), "id", target=1 << 18)
    totals = placed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shard_no", "offset").alias("places"))
    assert all(r.n == r.places for r in totals.collect())


def test_ordered_results_match_plain_windows(spark, skewed):
    points = skewed.groupBy("source", "offset").agg(F.sum("size").alias("size"))
    got = ordered.running_total(points, ["source"], "offset", "size", "total", 1 << 12)
    points.createOrReplaceTempView("points")
    want = spark.sql("select *, sum(size) over (partition by source order by offset) as total from points")
    assert got.exceptAll(want.select(*got.columns)).isEmpty()
    ranked = {r.source: r.x for r in profile.ranked_value(skewed, "source", "size", 0.95, "x").collect()}
    hot = sorted(r.size for r in skewed.filter("source = 'hot'").select(F.col("size").alias("size")).toPandas().itertuples())
    assert ranked["hot"] == hot[int(0.95 * len(hot))]


def test_no_registered_plan_has_a_cross_join(spark):
    import os

    import __spark_entry__ as entry

    folder = os.environ.get("CURATA_TEST_TABLES", "/root/testdata/sf0.001")
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    for name, query in entry.queries().items():
        if name.startswith("stream"):
            continue
        plan = plan_of(query(spark, folder))
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_spread_leaves_large_inputs_alone(spark):
    many = spark.range(0, 1000, 1, 70)
    assert spread(many) is many
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


class _Session:
    """A session whose checkpoint settings a test can choose."""

    def __init__(self, conf, context_dir, master):
        self.conf = {"spark.checkpoint.dir": conf} if conf else {}
        self.sparkContext = self
        self.context_dir, self.master = context_dir, master

    def getCheckpointDir(self):
        return self.context_dir

    def setCheckpointDir(self, path):
        self.context_dir = f"file:{path}/x"


def test_staging_folder_is_read_from_the_session(spark):
    assert staging_root(_Session("hdfs:///shared/", None, "yarn")) == "hdfs:///shared"
    assert staging_root(_Session(None, "hdfs:///set", "yarn")) == "hdfs:///set"
    with pytest.raises(ValueError):
        staging_root(_Session(None, None, "yarn"))
    local = _Session(None, None, "local[8]")
    assert staging_root(local) == staging_root(local) != ""
    assert staging_root(spark) == (spark.conf.get("spark.checkpoint.dir", None) or staging_root(spark)).rstrip("/")
