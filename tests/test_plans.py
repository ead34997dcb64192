"""The whole way: files to index, index to plan, plan to batches; and restarts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from curata.functions.text import chain_key
from curata.operators import curate as C
from curata.plans import curate, samples, select
from curata.schema import RECORD
from curata.sources import catalogs, index as index_source, mmcif
from curata.streaming import ingest

EYE = [float(i % 5 == 0) for i in range(16)]
SHIFT = EYE[:3] + [10.0] + EYE[4:]
LETTERS = "ACDEFGHIKLMNPQRSTVWY"


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    from conftest import cif_text

    texts = []
    for i in range(12):
        a, b = LETTERS[i:] + LETTERS[: i // 2], LETTERS[::-1][: 8 + i]
        texts.append((f"f{i}", cif_text(f"1a{i:02d}", chains=[("A", a), ("B", b), ("C", a)], assemblies=[[(["A", "B"], [EYE, SHIFT])]]), i % 3 == 0))
    texts.append(("bad", cif_text("9zzz", resolution=9.0), False))
    files = spark.createDataFrame(texts, "path string, content string, is_refined boolean")
    out = str(tmp_path_factory.mktemp("curated") / "out")
    config = curate.CurateConfig(shard_bytes=40_000, export_cif=True)
    clusters = curate.ClusterConfig(seq_thresholds=(0.3, 0.5), structure_thresholds=(0.7,))
    index = curate.run(spark, files, out, config, clusters)
    return files, curate.folder(out, config), config, clusters, index, out


def test_index(spark, job):
    files, out, config, clusters, index, root = job
    rows = index.toPandas()
    assert len(rows) == 36 and set(rows.source) == {"rcsb", "pdb_redo"}
    assert rows.groupby("pdb").offset.nunique().max() == 1 and rows.shard_id.str.fullmatch(r"experimental/\d{6}").all()
    assert rows.shard_id.nunique() > 1 and rows.mean_plddt.isna().all()
    assert set(clusters.columns) <= set(rows.columns)
    same = rows.pivot(index="pdb", columns="chain", values="mmseqs_30")
    assert (same.A == same.C).all()
    reps = set(rows.pdb + "_" + rows.chain)
    assert set(rows.mmseqs_30) <= reps and set(rows.foldseek_70) <= reps
    loaded = index_source.read_index(spark, index.inputFiles()[0].rsplit("/", 1)[0], "foldseek_70", ["foldseek_70", "mmseqs_30"])
    assert loaded.count() == 36
    with pytest.raises(ValueError):
        index_source.read_index(spark, index.inputFiles()[0].rsplit("/", 1)[0], "foldseek_50", ["foldseek_50"])
    assert catalogs.read_checkpoint(spark, f"{out}/checkpoint").count() == 36
    assert spark.read.text(f"{out}/fasta").filter("value like '>%'").count() == 36


def test_records(spark, job):
    out = job[1]
    records = spark.read.parquet(f"{out}/records")
    for field in RECORD.fields:
        assert field.name in records.columns
    row = records.filter("pdb = '1a02'").first()
    assert sorted(row.chains) == ["A", "B", "C"] and row.chain_ids == ["A", "B", "C"]
    m = row.chain_seq_identity
    assert [m[i][i] for i in range(3)] == [1, 1, 1] and m[0][2] == 1 and m[0][1] == m[1][0]
    a, b = row.chains["A"].sequence, row.chains["B"].sequence
    if m[0][1] is not None:
        distance = spark.range(1).select(F.levenshtein(F.lit(a), F.lit(b))).first()[0]
        assert abs(m[0][1] - (1 - distance / max(len(a), len(b)))) < 1e-6
    assert len(row.assemblies) == 1 and len(row.assemblies[0][0].asmb_xforms) == 2
    shards = spark.read.parquet(f"{out}/shards")
    assert shards.select("pdb").distinct().count() == shards.count() == 12


def test_backbone_files(spark, job):
    out = job[1]
    files = mmcif.read_text(spark, f"{out}/cif/*/*/*/*.gz")
    files = files.withColumn("pdb", F.regexp_extract("path", "pdb=([^/]+)", 1))
    back = mmcif.atom_rows(files)
    atoms = mmcif.atom_rows(spark.read.parquet(f"{out}/accepted")).filter(F.col("atom").isin("N", "CA", "C", "O", "CB"))
    columns = ["pdb", "chain", "seq_id", "resname", "atom", "x", "y", "z", "b"]
    assert back.count() == atoms.count() > 0 and back.select(columns).exceptAll(atoms.select(columns)).isEmpty()


def test_finished_steps_are_not_run_again(spark, job):
    files, out, config, clusters, index, root = job
    broken = files.withColumn("content", F.raise_error(F.lit("must not be read")).cast("string"))
    again = curate.run(spark, broken, root, config, clusters)
    assert again.count() == index.count()


def test_more_files_and_other_settings(spark, job, tmp_path):
    files, out, config, clusters, index, root = job
    half, grown = files.filter("path < 'f2'"), str(tmp_path / "grown")
    first = curate.run(spark, half, grown, config, clusters)
    assert 0 < first.count() < index.count()
    both = curate.run(spark, files, grown, config, clusters)
    same = [c for c in index.columns if c not in ("shard_id", "offset")]
    order = lambda df: sorted(map(str, df.select(same).collect()))
    assert order(both) == order(index)
    old, new = ({r.pdb: r.shard_id for r in df.select("pdb", "shard_id").collect()} for df in (first, both))
    assert all(new[p] == s for p, s in old.items()) and not set(old.values()) & {s for p, s in new.items() if p not in old}
    strict = curate.run(spark, half, grown, curate.CurateConfig(shard_bytes=40_000, min_chain_length=15), clusters)
    assert 0 < strict.count() < first.count()


def test_selection_and_samples(spark, job):
    files, out, config, clusters, index, root = job
    cfg = select.SelectConfig(ratios=(0.6, 0.2, 0.2), num_workers=2)
    chosen = select.Selection(index, cfg)
    assert chosen.summary().agg(F.sum("samples")).first()[0] <= 36
    first, second = chosen.epoch_plan(epoch=0).count(), chosen.epoch_plan(epoch=0, from_step=1).count()
    assert first > second >= 0
    assert chosen.epoch_plan("test", 1).collect() == chosen.epoch_plan("test", 2).collect()

    accepted, chains = spark.read.parquet(f"{out}/accepted"), spark.read.parquet(f"{out}/chains")
    generators = mmcif.generator_rows(accepted)
    members = C.generator_members(generators, chains)
    transforms = C.assembly_transforms(generators, mmcif.operator_rows(accepted))
    config = samples.SampleConfig(min_seq_size=4, max_seq_size=64, batch_tokens=128, buffer_size=4, num_workers=2)
    packed, rows = samples.build(index.select("pdb", "chain"), chains, members, transforms, None, config)
    plan = packed.toPandas()
    assert len(plan) == 36 and plan.groupby("batch_id").len.sum().max() <= 128
    sizes = {r.sample_id: r.n for r in rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    lens = {r.pdb + "_" + r.chain: len(r.sequence) for r in chains.select("pdb", "chain", "sequence").collect()}
    for row in plan.itertuples():
        pdb, chain = row.sample_id.split("_")
        alone, both = lens[row.sample_id], lens[f"{pdb}_A"] + lens[f"{pdb}_B"]
        want = alone if chain == "C" else (2 * both if 2 * both <= 64 else min(both, 64))
        assert row.len == want == sizes[row.sample_id]
    shown = [c for c, kind in rows.dtypes if c not in ("sample_id", "idx") and "map<" not in kind][:2]
    collated = samples.batches(packed, rows, shown).toPandas()
    assert sorted(collated.cu_seqlens.map(lambda c: int(c[-1]))) == sorted(plan.groupby("batch_id").len.sum())
    assert collated.samples.sum() == 36 and all(len(r[shown[0]]) == r.cu_seqlens[-1] for _, r in collated.iterrows())
    records = spark.read.parquet(f"{out}/records")
    found = {(r.pdb, r.chain_a, r.chain_b): r.score for r in samples.homolog_pairs(records).collect()}
    matrices = {r.pdb: (r.chain_ids, r.chain_tm_scores) for r in records.collect()}
    assert found == {
        (pdb, a, b): m[i][j] for pdb, (ids, m) in matrices.items() for i, a in enumerate(ids) for j, b in enumerate(ids)
        if i != j and m[i][j] is not None
    }
    target = rows.filter("loss_mask").groupBy("sample_id").count().count()
    assert target == 36
    with pytest.raises(ValueError):
        samples.SampleConfig(max_seq_size=200, batch_tokens=100)


def test_stream_ingest_keeps_first_rows_across_restarts(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "pdb string, chain string, body string"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    add([("1abc", "A", "x"), ("1abc", "B", "y"), ("2def", "A", "z")])
    stream = lambda: ingest.file_stream(spark, source, spark.read.parquet(source).schema)
    ingest.run_available(ingest.start_ingest(stream(), path, "pdb", ["pdb", "chain"]))
    add([("2def", "A", "late"), ("3ghi", "A", "new")])
    ingest.run_available(ingest.start_ingest(stream(), path, "pdb", ["pdb", "chain"]))
    assert sorted((r.pdb, r.chain) for r in ingest.ingested(spark, path).collect()) == [("1abc", "A"), ("2def", "A"), ("3ghi", "A")]
    bodies = {r.pdb: r.body for r in ingest.ingested(spark, path, "data").collect()}
    assert bodies == {"1abc": "x", "2def": "z", "3ghi": "new"}


def test_resume_state(spark):
    plan = spark.createDataFrame([(s, e, t) for s in ("train", "val") for e in (0, 1) for t in range(3)], "split string, epoch int, step int")
    state = spark.createDataFrame([("train", 1, 1)], "split string, epoch int, step int")
    got = sorted(map(tuple, ingest.resume_from(plan, state).collect()))
    assert got == [("train", 1, 1), ("train", 1, 2)] + [("val", e, t) for e in (0, 1) for t in range(3)]


def test_chain_key(spark):
    assert spark.range(1).select(chain_key(F.lit("1abc"), F.lit("A")).alias("k")).first().k == "1abc_A"
