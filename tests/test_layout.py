from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from curata.operators import layout as L
from curata.schema import RECORD
from curata.sinks import writers


@pytest.mark.parametrize(("lanes", "target", "first"), [(1, 20_000, 0), (4, 20_000, 3), (2, 1, 5), (3, 1 << 30, 0)])
def test_exact_shards_against_a_writer_per_lane(spark, lanes, target, first):
    rng = random.Random(lanes)
    rows = [(f"k{i}", "hot" if i % 3 else f"s{i % 7}", rng.randrange(1, 5000)) for i in range(600)]
    df = spark.createDataFrame(rows, "pdb string, source string, size bigint").repartition(5)
    want, counts = {}, {}
    digest = lambda k: hashlib.md5(f"0:{k}".encode()).hexdigest()
    lane_of = lambda k: int(digest(k)[:8], 16) % lanes
    for source in {r[1] for r in rows}:
        shard_base = first
        for lane in range(lanes):
            shard, used = 0, 0
            mine = sorted(((digest(k), k, z) for k, s, z in rows if s == source and lane_of(k) == lane))
            for _, k, z in mine:
                if used >= target:
                    shard, used = shard + 1, 0
                want[k] = (shard_base + shard, used + 512)
                used += 512 + -(-z // 512) * 512
            shard_base += (shard + 1) if mine else 0
        counts[source] = shard_base
    got = {r.pdb: (r.shard_no, r.offset) for r in L.exact_shards(df, "pdb", target=target, lanes=lanes, first_shard=first, mode="md5").collect()}
    assert got == want


def test_parallel_layout_fills_shards(spark):
    rows = [(f"k{i}", "hot", 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "pdb string, source string, size bigint")
    placed = L.byte_layout(df, "pdb", target=50_000).toPandas().sort_values(["shard_no", "offset"])
    for _, shard in placed.groupby("shard_no"):
        assert list(shard.offset) == [512 + 1536 * i for i in range(len(shard))]
        assert len(shard) * 1536 < 50_000 + 1536


def test_records_survive_a_round_trip(spark, tmp_path):
    nan = float("nan")
    chain = ("AC", [[[1.0, 2.0, 3.0]] * 14] * 2, [[True] * 14] * 2, [[30.0] * 14] * 2, [nan, nan], [[1.0] * 14] * 2)
    matrix = [[1.0, 0.0, 0.0, 5.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    record = ("1abc", {"A": chain}, [[(["A"], [matrix, matrix])]], 2.0, "X-RAY DIFFRACTION", "2020-01-01", "rcsb", nan, nan, [[1.0]], [[1.0]])
    df = spark.createDataFrame([record], RECORD)
    writers.write_records(df, f"{tmp_path}/r")
    back = spark.read.schema(RECORD).parquet(f"{tmp_path}/r")
    assert str(back.first()) == str(df.first())
    assert back.select(F.isnan("ptm"), F.isnan(F.col("chains")["A"]["plddt"][0])).first() == (True, True)


def test_missing_clusters(spark):
    from curata.operators import catalog as K

    chains = spark.createDataFrame([("1abc", "A"), ("1abc", "B")], "pdb string, chain string")
    clusters = spark.createDataFrame([("r", "1abc_A")], "rep string, member string")
    rows = lambda **kw: {r.chain: r.c for r in K.cluster_lookup(chains, clusters, "c", **kw).collect()}
    assert rows() == {"A": "r", "B": ""} and rows(missing="singleton") == {"A": "r", "B": "1abc_B"}
    with pytest.raises(ValueError):
        rows(missing="null")


def test_catalogues(spark):
    from curata.operators import catalog as K
    from curata.sources import catalogs as R

    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "pdb string")
    listed, refined = ids("1abc", "2def", "4jkl", "5mno"), ids("1abc", "2def", "3ghi")
    got = {r.pdb: r.is_refined for r in K.reconcile(listed, refined).collect()}
    assert got == {"1abc": True, "2def": True, "4jkl": False, "5mno": False}
    many = ids(*[f"{i:04d}" for i in range(20)])
    for cap in (1, 6, 7):
        capped = K.reconcile(many, ids(*[f"{i:04d}" for i in range(0, 20, 2)]), max_entries=cap).collect()
        assert len(capped) <= cap and sum(not r.is_refined for r in capped) == cap // 2
    lines = spark.createDataFrame(
        [("drwxr-xr-x 4096 2024/01/01 00:00:00 1abc",), ("-rw-r--r-- 1 2024/01/01 00:00:00 2def",), ("drwxr-xr-x 4096 2024/01/01 00:00:00 ab",)],
        "value string",
    )
    assert [r.pdb for r in R.listing_names(lines).collect()] == ["1abc"]
    assert [r.pdb for r in R.listing_names(lines, "[0-9a-z]{2}").collect()] == ["ab"]
    docs = spark.createDataFrame([('{"result_set": [{"identifier": "1ABC"}, {"identifier": "1abc"}]}',)], "value string")
    assert [r.pdb for r in R.search_ids(docs).collect()] == ["1abc"]
    held = spark.createDataFrame([('{"1ABC": {"a": 1}, "2DEF": {}}',)], "value string")
    assert sorted(r.pdb for r in R.holdings_ids(held).collect()) == ["1abc", "2def"]


def test_small_shards_share_folders(spark, tmp_path):
    rows = [(f"k{i}", f"s{i % 2}", i // 10, i) for i in range(400)]
    df = spark.createDataFrame(rows, "pdb string, source string, shard_no bigint, offset bigint").repartition(7)
    writers.write_shards(df, f"{tmp_path}/s", order=["offset"], together=16)
    folders = {str(p.parent.relative_to(tmp_path / "s")) for p in (tmp_path / "s").rglob("*.parquet")}
    assert folders == {f"source=s{s}/shards={n}" for s in (0, 1) for n in (0, 16, 32)}
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(tuple(r) for r in back.select(df.columns).collect()) == sorted(rows)
    for file in (tmp_path / "s").rglob("*.parquet"):
        places = [(r.shard_no, r.offset) for r in spark.read.parquet(str(file)).collect()]
        assert places == sorted(places)


def test_chains_share_files(spark, tmp_path):
    from curata.sources import mmcif

    rows = [(f"{p}_x", c, r + 1, s, "ALA", a, p + r / 2, s / 4, -1.5, 2.5)
            for p in range(30) for c in ("A", "b_C") for r in range(3) for s, a in enumerate(["N", "CA"])]
    atoms = spark.createDataFrame(
        rows, "pdb string, chain string, seq_no int, slot int, resname string, atom string, x double, y double, z double, b double"
    )
    writers.write_cif_bundles(writers.backbone_cif(atoms).coalesce(2), f"{tmp_path}/c")
    assert len(list((tmp_path / "c").glob("*.gz"))) <= 2
    blocks = mmcif.read_bundles(spark, f"{tmp_path}/c")
    assert blocks.count() == 60
    got = mmcif.atom_rows(blocks).select("pdb", "chain", "seq_id", "resname", "atom", "x", "y", "z", "b").collect()
    assert sorted(map(tuple, got)) == sorted((p, c, r, n, a, x, y, z, b) for p, c, r, _, n, a, x, y, z, b in rows)
