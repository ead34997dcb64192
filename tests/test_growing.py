"""Pairs that do not multiply, structures under shifts, clusters and streams that grow, rejects, methods by name."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.functions.hashing import below
from curata.operators import clustering as C
from curata.operators import growing as G
from curata.operators import ordered as O
from curata.operators import pairs as S
from curata.operators import profile, sift
from curata.plans import curate, registry
from curata.streaming import ingest

SHARE = {
    S.UNION: lambda x, y: len(x & y) / len(x | y),
    S.SMALLER: lambda x, y: len(x & y) / min(len(x), len(y)),
    S.LARGER: lambda x, y: len(x & y) / max(len(x), len(y)),
}


def token_sets(seed, n=120):
    """Sets of which some are edited copies of others, with a few tokens that most hold."""
    r = random.Random(seed)
    made = []
    for i in range(n):
        if made and r.random() < 0.5:
            base = set(r.choice(made))
            for _ in range(r.choice([0, 1, 2, 5])):
                base ^= {r.randrange(60)}
        else:
            base = set(r.sample(range(60), r.randint(1, 12))) | ({100, 101} if r.random() < 0.6 else set())
        made.append(base or {i})
    return made


def pairs_by_hand(sets, at_least, over):
    return {(a, b) for (a, x), (b, y) in combinations(enumerate(sets), 2) if SHARE[over](x, y) >= at_least}


@pytest.mark.parametrize("over", [S.UNION, S.SMALLER, S.LARGER])
@pytest.mark.parametrize("at_least", [0.3, 0.5, 0.8, 1.0])
def test_similar_pairs_equal_all_pairs(spark, monkeypatch, at_least, over):
    monkeypatch.setattr(S, "HOT", 7)
    sets = token_sets(int(at_least * 10) + over)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, t array<long>").repartition(3)
    found = [(r.a, r.b) for r in S.similar_pairs(df, [], "id", "t", at_least, over).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs_by_hand(sets, at_least, over)


def test_a_token_of_all_rows_does_not_multiply(spark):
    n = 100_000
    own = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.col("id") * 3 + k + 10)
    df = spark.range(n).select("id", F.concat(own, F.array(F.lit(1).cast("long"))).alias("t"))
    twin = spark.createDataFrame([(n, [10, 11, 12, 1]), (n + 1, [13, 14, 15, 9_999_999, 1])], "id long, t array<long>")
    sets = df.unionByName(twin).select(F.col("id").alias("_id"), F.col("t").alias("_tokens"), F.size("t").alias("_n"))
    rows = S.occurrences(sets, [], 0.5)
    assert S.candidate_pairs(rows, rows, [], 0.5).count() <= 20
    found = S.similar_pairs(df.unionByName(twin), [], "id", "t", 0.5)
    assert sorted((r.a, r.b) for r in found.collect()) == [(0, n), (1, n + 1)]


def test_holders_of_a_hot_token_are_cut_by_salt(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 50)
    df = spark.range(300).select("id", F.array(F.lit(1).cast("long")).alias("t"))
    sets = df.select(F.col("id").alias("_id"), F.col("t").alias("_tokens"), F.size("t").alias("_n"))
    rows = S.occurrences(sets, [], 1.0)
    met = S.candidate_pairs(rows, rows, [], 1.0)
    assert met.select("_salt").distinct().count() == 6 and met.count() == 300 * 299 // 2


# --- structures under a shift ------------------------------------------------


def walk(seed, n):
    """A chain of points about 3.8 apart."""
    r = np.random.default_rng(seed)
    steps = r.normal(size=(n, 3))
    return (3.8 * steps / np.linalg.norm(steps, axis=1)[:, None]).cumsum(0)


def turned(points, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    return points @ q + [5.0, -7.0, 11.0]


def test_a_cut_chain_is_found_at_its_offset(spark):
    whole = {i: walk(i, 60) for i in range(6)}
    rows = [(f"w{i}", p) for i, p in whole.items()] + [(f"x{i}", turned(p[5:], i)) for i, p in whole.items()]
    df = spark.createDataFrame([(n, [float(v) for v in p.ravel()]) for n, p in rows], "id string, trace array<double>")
    worded = df.select("id", S.shape_words("trace").alias("words"))
    placed = S.shifted_pairs(worded, [], "id", "words", 0.3)
    found = {(r.a, r.b): r for r in S.structure_scores(placed.withColumn("score", F.lit(0.0)), df, [], "id", "trace").collect()}
    twins = {(f"w{i}", f"x{i}") for i in whole}
    assert twins <= set(found)
    for pair, row in found.items():
        if pair in twins:
            assert row.offset == -5 and row.score_ba == 1.0 and 0.7 < row.score_ab < 1.0
        else:
            assert min(row.score_ab, row.score_ba) < 0.7


def test_votes_for_offsets(spark):
    def best(a, b):
        df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
        return df.select(S.best_offset("a", "b")).first()[0]

    twice = lambda xs: [v for x in xs for v in (x, x + 100)]
    assert best(twice([1, 2, 3, 4]), twice([9, 9, 1, 2, 3, 4])) == 2
    assert best(twice([9, 9, 1, 2, 3, 4]), twice([1, 2, 3, 4])) == -2
    assert best(twice([1, 1, 1]), twice([1, 1, 1])) == 0 and best([], twice([1])) == 0


@pytest.mark.usefixtures("few_buckets")
def test_a_chain_cut_by_five_lands_in_its_cluster(spark):
    rows = []
    for i in range(4):
        points = walk(50 + i, 40)
        letters = "".join("ACDEFGHIKLMNPQRSTVWY"[(7 * i + k * (i + 3)) % 20] for k in range(40))
        for chain, p, s in (("A", points, letters), ("B", turned(points[5:], i), letters[5:])):
            rows.append((f"{i}abc", chain, s, [[[float(v) for v in xyz]] * 14 for xyz in p], [[True] * 14] * len(p)))
    schema = "pdb string, chain string, sequence string, coords array<array<array<float>>>, atom_mask array<array<boolean>>"
    chains = spark.createDataFrame(rows, schema)
    cfg = curate.ClusterConfig(seq_thresholds=(), structure_thresholds=(0.7,), cluster_mode=C.COMPONENTS)
    found = {r.member: r.foldseek_70 for r in curate.cluster_chains(chains, cfg).collect()}
    assert len(set(found.values())) == 4 and all(found[f"{i}abc_A"] == found[f"{i}abc_B"] for i in range(4))


# --- an index that grows -----------------------------------------------------


@pytest.fixture
def few_buckets(monkeypatch):
    monkeypatch.setattr(G, "BUCKETS", 5)
    monkeypatch.setattr(ingest, "BUCKETS", 5)


@pytest.mark.usefixtures("few_buckets")
@pytest.mark.parametrize("over", [S.UNION, S.SMALLER, S.LARGER])
def test_batches_give_the_pairs_of_one_run(spark, tmp_path, over):
    sets = token_sets(40 + over, 150)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, t array<long>")
    index = G.TokenIndex(str(tmp_path / "index"), 0.5, over)
    for k in range(3):
        index.add(df.filter(F.col("id") % 3 == k), "id", "t")
    index.add(df.limit(0), "id", "t")
    found = sorted((r.a, r.b, r.score) for r in index.found(spark).collect())
    assert found == sorted((r.a, r.b, r.score) for r in S.similar_pairs(df, [], "id", "t", 0.5, over).collect())
    assert index.batches(spark) == 4 and index.known(spark).count() == 150


def test_a_batch_reads_its_own_buckets_and_no_old_items(spark, tmp_path):
    df = spark.createDataFrame([(i, [i, i + 1, i + 2]) for i in range(200)], "id long, t array<long>")
    index = G.TokenIndex(str(tmp_path / "index"), 0.5)
    index.add(df, "id", "t")
    few = spark.createDataFrame([(1000, [5, 6, 7])], "id long, t array<long>")
    new = index._write(
        index._placed(few.select(F.col("id").alias("_id"), F.col("t").alias("_tokens"), F.size("t").alias("_n")),
                      spark.read.parquet(f"{index.path}/order")), "trial", 0,
    )
    buckets = sorted(r.bucket for r in new.select("bucket").distinct().collect())
    plan = index._old(new, "prefix", 1, buckets)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket").replace("[(", "[") or "bucket#" in plan.split("PartitionFilters")[1]
    assert sorted((r.a, r.b) for r in index.add(few, "id", "t").collect()) == [(4, 1000), (5, 1000), (6, 1000)]
    again = index.add(few.withColumn("t", F.raise_error(F.lit("must not be read")).cast("array<bigint>")), "id", "t", batch=1)
    assert again.count() == 3


@pytest.mark.usefixtures("few_buckets")
@pytest.mark.parametrize("over", [S.UNION, S.SMALLER, S.LARGER])
def test_large_batches_give_the_pairs_of_one_run(spark, tmp_path, monkeypatch, over):
    monkeypatch.setattr(sift, "SETS", 20)
    monkeypatch.setattr(sift, "PACKED", 40)
    sets = token_sets(40 + over, 150)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, t array<long>")
    df = df.select("id", S.token_hashes("t").alias("t"))
    index = G.TokenIndex(str(tmp_path / "index"), 0.5, over, large=True)
    for k in range(3):
        index.add(df.filter(F.col("id") % 3 == k), "id", "t")
    index.add(df.limit(0), "id", "t")
    found = sorted((r.a, r.b, r.score) for r in index.found(spark).collect())
    assert found == sorted((r.a, r.b, r.score) for r in S.similar_pairs(df, [], "id", "t", 0.5, over).collect())
    assert index.batches(spark) == 4 and index.known(spark).count() == 150


@pytest.mark.parametrize("kind", ["long", "string"])
def test_items_without_enough_in_common_leave_before_their_tokens_are_moved(spark, monkeypatch, kind):
    monkeypatch.setattr(sift, "SETS", 25)
    monkeypatch.setattr(sift, "PACKED", 100)
    own = lambda i: [1000 * i + j for j in range(3, 23)]
    sets = {i: own(i) for i in range(100)}  # alone
    sets |= {100 + i: own(i)[: 9 + i % 2] + own(1000 + i)[:10] for i in range(100)}  # 9 or 10 of a set above
    sets |= {200: [], 201: [1], 202: [1], 203: [2]}
    rows = [(i, t, i >= 100) for i, t in sets.items()]
    df = spark.createDataFrame(rows, "id long, t array<long>, _new boolean").repartition(4)
    df = df.select(F.col("id").cast(kind).alias("id"), S.token_hashes("t").alias("t"), "_new")
    able = lambda d: sorted(int(r.id) for r in S.able_items(d, "id", "t", 0.5).collect())
    assert able(df.drop("_new")) == able(df) == [*range(1, 200, 2), 201, 202]
    # Nothing is new: nothing has a new partner.  New sets count old ones.
    assert able(df.withColumn("_new", F.lit(False))) == []
    assert able(df.withColumn("_new", F.col("id") == "201")) == [201, 202]
    assert able(df.limit(0)) == []


def test_components_merge(spark):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(70)]
    labels = None
    for k in range(3):
        labels = G.merged_components(labels, spark.createDataFrame(edges[k::3], "a long, b long"))
        labels = spark.createDataFrame(labels.collect(), "member long, rep long")
    whole = C.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, whole.select("member", "rep").collect()))


def test_length_classes_take_few_rounds(spark, monkeypatch):
    n = 3_000
    path = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    lengths = spark.range(n).select(F.col("id").alias("v"), (F.lit(n) - F.col("id")).alias("len"))
    rounds, real = [], C.stage
    monkeypatch.setattr(C, "stage", lambda df, label: (rounds.append(label), real(df, label))[1])
    found = {r.member: r.rep for r in C.greedy_by_class(path, lengths).collect()}
    assert rounds.count("gl-reps") <= 30
    assert all(abs(m - rep) <= 1 for m, rep in found.items()) and len(found) == n
    reps = {rep for m, rep in found.items() if m == rep}
    assert not any(v + 1 in reps for v in reps)


# --- streams and order --------------------------------------------------------


def test_previous_value_with_one_hot_value(spark):
    df = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40).alias("g"), F.floor(F.col("id") / 1500).alias("t"), F.col("id").alias("v")
    )
    found = O.previous_value(df, ["g"], "t", ["v"], "v", "p", 100)
    df.createOrReplaceTempView("hot_rows")
    want = spark.sql("select *, lag(v) over (partition by g order by t, v) as p from hot_rows")
    assert found.exceptAll(want.select(found.columns)).isEmpty() and found.count() == 3_000
    sizes = O.in_pieces(df, ["g", "t", "v"], 100).groupBy("_piece").count()
    assert sizes.agg(F.max("count")).first()[0] < 400


def arrived(spark, tmp_path, frames, name):
    folder = str(tmp_path / name)
    for k, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{folder}/f{k}")
    return lambda: ingest.file_stream(spark, f"{folder}/*", frames[0].schema, files_per_batch=1)


@pytest.mark.usefixtures("few_buckets")
def test_ingest_in_batches_reads_pruned_folders(spark, tmp_path):
    frames = [spark.createDataFrame([(i, k, f"b{k}") for i in range(k * 10, k * 10 + 20)], "key long, n long, body string") for k in range(4)]
    stream, path = arrived(spark, tmp_path, frames, "in"), str(tmp_path / "out")
    ingest.run_available(ingest.start_ingest(stream(), path, "key", ["key", "n"]))
    ingest.run_available(ingest.start_ingest(stream(), path, "key", ["key", "n"]))
    rows = ingest.ingested(spark, path, "data").collect()
    assert sorted(r.key for r in rows) == list(range(50)) and all(r.n == max(0, r.key // 10 - 1) for r in rows)
    plan = ingest.logged(spark, path, 3, [1, 4])._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "bucket" in filters and "batch" in filters


@pytest.mark.usefixtures("few_buckets")
def test_current_table_grows_with_keys_only(spark, tmp_path):
    frames = [spark.createDataFrame([(f"k{i}", "sum", float(k), 1, k) for i in range(30)], "key string, reduction string, value double, n long, batch_id long") for k in range(6)]
    stream, path = arrived(spark, tmp_path, frames, "in"), str(tmp_path / "out")
    run = lambda: ingest.run_available(ingest.start_updates(ingest.running_metrics(stream()), path, ["key", "reduction"]))
    run()
    first = sorted(map(tuple, ingest.latest(spark, path).collect()))
    assert len(first) == 30 and {r[2] for r in first} == {15 / 6}
    stored = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data").count()
    assert stored <= 2 * 30
    run()
    assert sorted(map(tuple, ingest.latest(spark, path).collect())) == first


def test_activity_costs_two_rows_an_interval(spark, tmp_path):
    spans = [("a", 10, 500_000), ("a", 20, 30), ("b", 15, 15), ("b", 40, 39), ("a", 31, 40), ("b", 600_000, 600_010)]
    df = spark.createDataFrame(spans, "kind string, t0 long, t1 long")
    timed = df.select("kind", F.timestamp_seconds("t0").alias("start"), F.timestamp_seconds("t1").alias("until"))
    stream, path = arrived(spark, tmp_path, [timed], "in"), str(tmp_path / "out")
    query = ingest.run_available(ingest.start_append(ingest.stage_activity(stream(), "kind", "start", "until", "100 seconds"), path))
    until = ingest.watermark(query)
    assert until == 600_010 - 100
    edges = spark.read.parquet(f"{path}/data")
    assert edges.count() <= 10
    twin = profile.concurrency_timeline(df, "kind", "t0", "t1").filter(F.col("second") < until)
    found = ingest.activity_levels(edges, "kind", until).select(twin.columns)
    assert found.count() == twin.count() and found.exceptAll(twin.select(found.columns)).isEmpty()


# --- the job ------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts():
    from conftest import cif_text

    good = [(f"g{i}", cif_text(f"2a{i:02d}", chains=[("A", "ACDEFGHIKL"[i % 4 :] + "MNPQ")]), False) for i in range(9)]
    return [*good, ("broken", "\x00 not a structure ' \" ;", False)]


@pytest.mark.usefixtures("few_buckets")
def test_a_broken_file_is_a_reject_with_its_reason(spark, texts, tmp_path):
    more = [("none", None, False), ("coarse", texts[0][1].replace("ls_d_res_high 2.0", "ls_d_res_high 9.5"), False)]
    files = spark.createDataFrame(texts + more, "path string, content string, is_refined boolean")
    out = str(tmp_path / "out")
    index = curate.run(spark, files, out)
    assert index.select("pdb").distinct().count() == 9
    reasons = {r.path: r.reject_reason for r in curate.rejects(spark, out).collect()}
    assert reasons == {"broken": "no entry id", "none": "no entry id", "coarse": "resolution"}
    loose = curate.CurateConfig(max_resolution=10.0)
    curate.run(spark, files, out, loose)
    assert "coarse" not in {r.path for r in curate.rejects(spark, out, loose).collect()}


@pytest.mark.usefixtures("few_buckets")
def test_clusters_of_two_batches_equal_one_run(spark, tmp_path):
    from conftest import cif_text

    letters = "ACDEFGHIKLMNPQRSTVWY"
    texts = [(f"f{i}", cif_text(f"3a{i:02d}", chains=[("A", letters[i % 5 :] + letters[: i % 7])]), False) for i in range(10)]
    files = spark.createDataFrame(texts, "path string, content string, is_refined boolean")
    clusters = curate.ClusterConfig(seq_thresholds=(0.3, 0.6), structure_thresholds=(), cluster_mode=C.COMPONENTS)
    whole = curate.run(spark, files, str(tmp_path / "one"), clusters=clusters)
    out = str(tmp_path / "two")
    curate.run(spark, files.filter(below(0.5, 1, "path")), out, clusters=clusters)
    gone = F.when(below(0.5, 1, "path"), F.lit(None).cast("string")).otherwise(F.col("content"))
    both = curate.run(spark, files.withColumn("content", gone), out, clusters=clusters)
    assert curate.rejects(spark, out).count() == 0
    names = ["pdb", "chain", "mmseqs_30", "mmseqs_60"]
    assert sorted(map(tuple, both.select(names).collect())) == sorted(map(tuple, whole.select(names).collect()))


@pytest.mark.usefixtures("few_buckets")
def test_methods_and_sources_by_name(spark, texts, tmp_path):
    def alone(edges, lengths):
        nodes = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct()
        return nodes.select(F.col("v").alias("member"), F.col("v").alias("rep"))

    with pytest.raises(ValueError):
        curate.ClusterConfig(cluster_mode="alone")
    registry.register("cluster", "alone", alone)
    registry.register("source", "listed", lambda spark, location: spark.read.parquet(location).withColumn("is_refined", F.lit(False)))
    try:
        cfg = curate.ClusterConfig(cluster_mode="alone", structure_thresholds=(), reassign=False)
        files = spark.createDataFrame(texts, "path string, content string, is_refined boolean")
        files.drop("is_refined").write.parquet(str(tmp_path / "files"))
        index = curate.run_from(spark, {"listed": str(tmp_path / "files")}, str(tmp_path / "out"), clusters=cfg)
        rows = index.select("pdb", "mmseqs_30").collect()
        assert len({r.mmseqs_30 for r in rows}) == 4 and len(rows) == 9
        with pytest.raises(ValueError):
            curate.run_from(spark, {"nowhere": "x"}, str(tmp_path / "out"))
    finally:
        registry.unregister("cluster", "alone")
        registry.unregister("source", "listed")
