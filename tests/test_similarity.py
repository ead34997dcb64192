from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from curata.operators import clustering as C
from curata.operators import meeting as M
from curata.operators import pairs as S
from curata.session import stage


@pytest.mark.parametrize("at_least", [0.2, 0.5, 0.8])
def test_similar_pairs_against_all_pairs(spark, at_least):
    rng = random.Random(3)
    rows = []
    for g in "ab":
        base = [rng.randrange(200) for _ in range(40)]
        for i in range(60):
            own = set(rng.sample(base, rng.randrange(5, 30))) | {rng.randrange(1000) for _ in range(rng.randrange(6))}
            rows.append((g, i, sorted(own | {7777})))  # one token is in every set
    want = set()
    for g, i, x in rows:
        for h, j, y in rows:
            if g == h and i < j and len(set(x) & set(y)) / len(set(x) | set(y)) >= at_least:
                want.add((g, i, j))
    df = spark.createDataFrame(rows, "g string, id int, tokens array<int>")
    got = {(r.g, r.a, r.b) for r in S.similar_pairs(df, ["g"], "id", "tokens", at_least).collect()}
    assert got == want and (want or at_least > 0.5)


def test_pair_scores(spark):
    row = spark.range(1).select(
        S.edit_similarity(F.lit("kitten"), F.lit("sitting")).alias("e"),
        S.edit_similarity(F.lit("abc"), F.lit("abc"), 0.9).alias("same"),
        S.edit_similarity(F.lit("abc"), F.lit("xyz"), 0.9).alias("far"),
        S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"),
        S.kmers(F.lit("ABAB"), 2).alias("k"),
        S.word_shingles(F.lit("A b"), 3).alias("w"),
    ).first()
    assert abs(row.e - (1 - 3 / 7)) < 1e-12 and row.same == 1.0 and row.far == -1.0
    assert abs(row.c - 0.5**0.5) < 1e-12 and row.k == ["AB", "BA"] and row.w == ["a b"]


def line(n, step=3.8, bend=0.0):
    return [x for i in range(n) for x in (i * step, float(bend * (i % 2)), 0.0)]


def test_structure_scores_skip_easy_pairs(spark):
    chains = spark.createDataFrame(
        [("p", c, line(8 if c != "B" else 10, bend=0 if c in "AC" else 5.0)) for c in "ABCD"],
        "pdb string, chain string, trace array<double>",
    )
    rows = [("p", a, b, 0.99 if (a, b) in {("A", "C"), ("B", "D")} else 0.5) for i, a in enumerate("ABCD") for b in "ABCD"[i + 1 :]]
    found = spark.createDataFrame(rows, "pdb string, a string, b string, score double")
    got = {(r.a, r.b): (r.score_ab, r.score_ba) for r in S.structure_scores(found, chains, ["pdb"], "chain", "trace").collect()}
    assert got[("A", "C")] == got[("B", "D")] == (1.0, 1.0) and len(got) == 6
    assert 0 <= got[("A", "B")][0] < 1 and got[("A", "B")][0] != got[("A", "B")][1]
    swapped = found.select("pdb", F.col("b").alias("a"), F.col("a").alias("b"), "score")
    back = {(r.b, r.a): (r.score_ba, r.score_ab) for r in S.structure_scores(swapped, chains, ["pdb"], "chain", "trace").collect()}
    assert back == got


def test_identical_traces_score_one(spark):
    lddt = S.lddt_kernel()
    df = spark.createDataFrame([(line(700), line(700)), (line(1), line(5))], "a array<double>, b array<double>")
    assert [r.s for r in df.select(lddt("a", "b").alias("s")).collect()] == [1.0, 1.0]


def test_record_matrix(spark):
    members = spark.createDataFrame(
        [("p", 0, "A"), ("p", 1, "A"), ("p", 2, "C"), ("q", 0, "A")], "pdb string, chain_no int, rep string"
    )
    directed = spark.createDataFrame([("p", "A", "C", 0.5), ("p", "C", "A", 0.25)], "pdb string, a string, b string, score double")
    got = {r.pdb: r.matrix for r in S.record_matrix(directed, members, ["pdb"]).collect()}
    assert got == {"p": [[1, 1, 0.5], [1, 1, 0.5], [0.25, 0.25, 1]], "q": [[1]]}
    none = {r.pdb: r.matrix for r in S.record_matrix(directed.filter("b = 'C'"), members, ["pdb"]).collect()}
    assert none["p"][2] == [None, None, 1]  # not compared


# --- clustering against sequential rules ------------------------------------


def graph(seed):
    rng = random.Random(seed)
    n = rng.randrange(5, 40)
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 3 * n))}
    edges |= {(0, i) for i in range(1, n, 3)} if seed % 2 else set()
    return n, {(a, b) for a, b in edges if a != b}


def neighbours(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def tie(v):
    return hashlib.md5(f"0:{v}".encode()).hexdigest()


def cover_rule(edges):
    near, reps = neighbours(edges), {}
    while left := [v for v in near if v not in reps]:
        best = max(left, key=lambda v: (sum(u not in reps for u in near[v]), tie(v), -v))
        for u in [best, *near[best]]:
            reps.setdefault(u, best)
    return reps


def length_rule(edges, length):
    near, reps = neighbours(edges), {}
    for v in sorted(near, key=lambda v: (length[v], tie(v)), reverse=True):
        if v not in reps:
            for u in [v, *near[v]]:
                reps.setdefault(u, v)
    return reps


def component_rule(edges):
    near, reps = neighbours(edges), {}
    for v in sorted(near):
        todo = [v]
        while todo:
            u = todo.pop()
            if u not in reps:
                reps[u] = v
                todo += near[u]
    return reps


def edge_table(spark, edges, kind="bigint"):
    name = (lambda v: v) if kind == "bigint" else (lambda v: "n" * (1 + v % 3) + f"{v:02d}")
    rows = [(name(a), name(b), 1.0) for a, b in edges]
    return spark.createDataFrame(rows, f"a {kind}, b {kind}, score double")


@pytest.mark.parametrize("seed", range(5))
def test_set_cover(spark, seed):
    _, edges = graph(seed)
    got = {r.member: r.rep for r in C.set_cover(edge_table(spark, edges)).collect()}
    assert got == cover_rule(edges)


@pytest.mark.parametrize("seed", range(5, 9))
def test_greedy_by_length(spark, seed):
    n, edges = graph(seed)
    rng = random.Random(seed)
    length = {v: rng.randrange(4) for v in range(n)}
    lengths = spark.createDataFrame(list(length.items()), "v bigint, len int")
    got = {r.member: r.rep for r in C.greedy_by_length(edge_table(spark, edges), lengths).collect()}
    assert got == length_rule(edges, length)


@pytest.mark.parametrize("seed", range(9, 12))
def test_components(spark, seed):
    _, edges = graph(seed)
    got = {r.member: r.rep for r in C.connected_components(edge_table(spark, edges)).collect()}
    assert got == component_rule(edges)


def test_components_of_a_long_path_and_a_star(spark):
    edges = {(i, i + 1) for i in range(300)} | {(1000, i) for i in range(1001, 1300)}
    got = {r.member: r.rep for r in C.connected_components(edge_table(spark, edges)).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 301 + 300


def test_text_ids_break_ties_by_hash(spark):
    edges = {(3, 4), (4, 5), (6, 7)}
    named = edge_table(spark, edges, "string")
    got = {r.member: r.rep for r in C.set_cover(named).collect()}
    assert got["n06"] == got["nn07"] == max(("n06", "nn07"), key=tie) and got["nn04"] == "nn04" == got["n03"]


@pytest.mark.parametrize("mode", [C.SET_COVER, C.BY_LENGTH])
def test_rounds_on_a_long_path(spark, monkeypatch, mode):
    rounds = []

    def counted(df, label):
        rounds.append(label)
        return stage(df, label)

    monkeypatch.setattr(C, "stage", counted)
    edges = spark.range(10_000).selectExpr("id AS a", "id + 1 AS b", "1.0D AS score")
    nodes = spark.range(10_001).selectExpr("id AS v", "7 AS len")
    found = C.cluster(edges, nodes.selectExpr("v AS member"), mode, nodes)
    assert found.filter("abs(member - rep) > 1").isEmpty()
    assert max(rounds.count("sc-taken"), rounds.count("gl-reps")) <= 20


def test_no_edges(spark):
    none = spark.createDataFrame([], "a bigint, b bigint, score double")
    items = spark.createDataFrame([(1,), (2,)], "member bigint")
    lengths = spark.createDataFrame([(1, 5), (2, 6)], "v bigint, len int")
    for mode in (C.SET_COVER, C.COMPONENTS, C.BY_LENGTH):
        got = C.cluster(none, items, mode, lengths)
        assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (2, 2)]


def test_star_candidates_stay_linear_in_a_hot_token(spark):
    rows = [(i, ["hot", f"t{i // 2}"], 100 - i) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, selected array<string>, size int")
    got = C.star_candidates(df, "id", "selected", "size").collect()
    assert len(got) <= 2 * 200 and all((i, 0) in {(r.a, r.b) for r in got} for i in range(1, 200))


def test_sequence_clusters(spark):
    from curata.plans.curate import ClusterConfig, cluster_chains

    rows = [("pdb1", "A", "MKFLILFNILVSSSAYA"), ("pdb1", "B", "MKFLILFNILVSSSAYA"), ("pdb2", "A", "G" * 17), ("pdb3", "A", "MKFLILFNILVSSSAYG")]
    chains = spark.createDataFrame(rows, "pdb string, chain string, sequence string")
    point = F.array(*[F.lit(1.0).cast("float")] * 3)
    chains = chains.withColumn("coords", F.array(F.array_repeat(point, 14))).withColumn("atom_mask", F.array(F.array_repeat(F.lit(True), 14)))
    got = {r.member: r.mmseqs_30 for r in cluster_chains(chains, ClusterConfig(structure_thresholds=())).collect()}
    assert set(got) == {"pdb1_A", "pdb1_B", "pdb2_A", "pdb3_A"} and set(got.values()) <= set(got)
    assert got["pdb1_A"] == got["pdb1_B"] == got["pdb3_A"] != got["pdb2_A"]


@pytest.mark.parametrize("over", [0, 1, 2])
def test_overlap_over_other_sets(spark, over):
    rng = random.Random(over)
    sets = {i: {rng.randrange(25) for _ in range(rng.choice((3, 8, 20)))} for i in range(80)}
    size = lambda x, y: [len(x | y), min(len(x), len(y)), max(len(x), len(y))][over]
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / size(sets[i], sets[j]) >= 0.6}
    df = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id int, tokens array<int>")
    assert {(r.a, r.b) for r in S.similar_pairs(df, [], "id", "tokens", 0.6, over).collect()} == want != set()


def test_coverage_is_apart_from_identity(spark):
    rng = random.Random(1)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    own = lambda n: "".join(rng.choice(letters) for _ in range(n))
    head, tail, body = own(20), own(20), own(80)
    rows = [("wide", head + own(20) + tail), ("wide2", head + own(20) + tail), ("part", body), ("part2", body + own(60))]
    items = spark.createDataFrame(rows, "id string, sequence string").withColumn("tokens", S.kmer_stream("sequence", 3))
    edges = C.spanning_edges(items, "id", "tokens", 0.3, 3)
    got = {(r.a, r.b): r.score for r in edges.collect()}
    assert set(got) == {("wide", "wide2")} and 0.3 <= got["wide", "wide2"] < 0.66
    by_query = C.spanning_edges(items, "id", "tokens", 0.3, 3, cov_mode=2)
    assert {(r.a, r.b) for r in by_query.collect()} == {("wide", "wide2"), ("part", "part2")}


def helix(n, turn=1.745, rise=1.5, wide=2.3):
    import math

    return [(wide * math.cos(turn * i), wide * math.sin(turn * i), rise * i) for i in range(n)]


def test_like_folds_of_unlike_sequences_are_one_structure_cluster(spark):
    from curata.plans.curate import ClusterConfig, cluster_chains

    folds = {"a": ("ACDEFGHIKL" * 3, helix(30)), "b": ("MNPQRSTVWY" * 3, [(x + 0.05, y, z) for x, y, z in helix(30)]), "c": ("ACDEFGHIKM" * 3, [(3.8 * i, 0.0, 0.0) for i in range(30)])}
    rows = [("1abc", c, s, [[list(map(float, p))] * 14 for p in t], [[True] * 14] * 30) for c, (s, t) in folds.items()]
    chains = spark.createDataFrame(rows, "pdb string, chain string, sequence string, coords array<array<array<float>>>, atom_mask array<array<boolean>>")
    got = {r.member[-1]: r for r in cluster_chains(chains, ClusterConfig(seq_thresholds=(0.3, 0.9))).collect()}
    assert got["a"].foldseek_70 == got["b"].foldseek_70 != got["c"].foldseek_70
    assert got["a"].mmseqs_30 == got["c"].mmseqs_30 != got["b"].mmseqs_30
    assert got["a"].mmseqs_90 != got["c"].mmseqs_90


def test_resumable_sweep_reuses_finished_steps(spark, tmp_path):
    edges = edge_table(spark, {(1, 2), (3, 4)})
    items = spark.createDataFrame([(i,) for i in range(1, 6)], "member bigint")
    calls = []

    def scored():
        calls.append(1)
        return edges

    path = str(tmp_path / "sweep")
    first = C.resumable_sweep(spark, path, scored, items, (0.5, 0.9), "mmseqs", C.COMPONENTS)
    again = C.resumable_sweep(spark, path, scored, items, (0.5, 0.9), "mmseqs", C.COMPONENTS)
    assert calls == [1] and first.columns == ["member", "mmseqs_50", "mmseqs_90"]
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))



def test_pairs_of_copies_do_not_carry_their_tokens(spark):
    """Near copies: each item goes to few blocks, however many partners it has."""
    n, size = 150, 40
    own = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.when(k == 1, -1 - F.col("id")).otherwise(k))
    df = spark.range(n).select("id", own.alias("t"))
    rows = S.overlapping_pairs(df, [], "id", "t", 0.5).collect()
    assert {(r.a, r.b) for r in rows} == {(i, j) for j in range(n) for i in range(j)}
    assert {(r.shared, r.size_a, r.size_b, r.score) for r in rows} == {(size - 1, size, size, (size - 1) / (size + 1))}
    given = spark.createDataFrame([(r.a, r.b, "x") for r in rows], "a long, b long, more string")
    items = df.select(F.col("id").alias("_id"), "t")
    found = S.in_blocks(given, items, [], ["t"], lambda x, y: F.size(F.array_union(x["t"], y["t"])))
    assert {(r.more, r.value) for r in found.collect()} == {("x", size + 1)} and found.count() == len(rows)
    # The texts of a pair travel by block: one row for each two blocks, not for each pair.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" in plan and "explode" in plan


def test_tokens_are_shuffled_once_and_made_once(spark, tmp_path):
    """Neither the counting of tokens nor their explosion asks for a second pass over the texts."""
    spark.range(20).select(F.col("id"), F.concat_ws(" ", F.lit("a b c"), F.col("id").cast("string")).alias("text")).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    sets = docs.select(F.col("id").alias("_id"), S.token_hashes(S.word_shingles("text", 2)).alias("_tokens")).withColumn("_n", F.size("_tokens"))
    shared = S.shared_sets(sets, [])
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert {(r["_n"], len(r["_tokens"])) for r in shared.collect()} == {(3, 2)}
    assert plan.count("FileScan") == plan.count("hashpartitioning(_token") == 1
    assert "Filter (size" not in plan


def test_streams_of_a_pair_travel_by_block(spark):
    items = spark.createDataFrame([(i, [i, 1, 2, 3, 4]) for i in range(20)], "id long, t array<int>")
    found = spark.createDataFrame([(i, j, 4 / 6) for j in range(10, 20) for i in range(10)], "a long, b long, score double")
    edges = C.covering(found, items, "id", "t", 1, 0.8)
    assert "map_from_entries" in edges._jdf.queryExecution().optimizedPlan().toString()
    # The items 1 to 4 repeat a word: their stretch with others is the whole.
    assert {(r.a, r.b) for r in edges.collect()} == {(i, j) for j in range(10, 20) for i in range(10)}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_dense_pairs_against_all_pairs(spark, monkeypatch, by):
    """Several blocks and strips; no table of candidates is staged."""
    monkeypatch.setattr(S, "DENSE", 40)
    monkeypatch.setattr(S, "STRIP", 1_000)
    rng = random.Random(8)
    rows = []
    for g in "ab":
        for i in range(150):
            kind = 100 * rng.randrange(4)
            rows.append((g, i if by else 1000 * "ab".index(g) + i, sorted({7, *(kind + rng.randrange(30) for _ in range(rng.randrange(1, 25)))})))
    rows += [("a", 5000, []), ("b", 5001, [])]
    want = set()
    for g, i, x in rows:
        for h, j, y in rows:
            both = len(set(x) & set(y))
            if i < j and (not by or g == h) and both and both / len(set(x) | set(y)) >= 0.4:
                want.add((*((g,) if by else ()), i, j, both, len(x), len(y), both / len(set(x) | set(y))))
    df = spark.createDataFrame(rows, "g string, id int, tokens array<int>")
    got = [tuple(r) for r in S.dense_pairs(df, by, "id", "tokens", 0.4).collect()]
    assert len(got) == len(set(got)) and set(got) == want != set()


def test_edit_similarities_are_those_of_the_column(spark):
    """Many pairs at once: empty, equal, short and long texts, letters of several bytes, a bound between them."""
    rng = random.Random(4)
    words = ["", "a", "é", "kitten", "sitting", *("".join(rng.choices("abcdé😀", k=rng.randrange(60))) for _ in range(40))]
    rows = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(rows, "a string, b string")
    for at_least in (0.0, 0.5):
        both = S.edit_similarities(df, "a", "b", "got", at_least).withColumn("want", S.edit_similarity("a", "b", at_least)).collect()
        assert len(both) == len(rows) and all(r.got == r.want for r in both)
    assert -1.0 in {r.got for r in both} and len({r.got for r in both}) > 2


def test_sets_without_enough_shared_tokens_are_not_staged(spark):
    """An item of which too few tokens are anywhere else cannot qualify with any other."""
    rows = [(1, [1, 2, 3, 4]), (2, [1, 2, 3, 5]), (3, [1, 10, 11, 12]), (4, [20, 21])]
    df = spark.createDataFrame(rows, "id int, tokens array<int>")
    assert sorted(r._id for r in S.able_sets(df, [], "id", "tokens", 0.5).collect()) == [1, 2]
    assert sorted(r._id for r in S.able_sets(df, [], "id", "tokens", 0.5, S.SMALLER).collect()) == [1, 2, 3]


def token_rows(rng, n=300):
    """Sets of families with a common line, and sets of their own, by group; some ids come twice."""
    rows = []
    for i in range(n):
        family = rng.randrange(12)
        own = {1000 * family + rng.randrange(25) for _ in range(rng.randrange(1, 20))} | {50_000 + 10 * i + k for k in range(rng.randrange(12))}
        rows.append(("ab"[i % 2], i, sorted(own | ({1, 2, 3} if rng.random() < 0.6 else set()))))
    return rows + rows[:20] + [("a", None, [1, 2, 3]), (None, 900, [1, 2, 3]), ("a", 901, []), ("b", 902, None)]


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("at_least", [0.1, 0.5])
def test_sets_meet_in_blocks(spark, monkeypatch, by, at_least):
    """Many packs, buckets, blocks and homes with several blocks; each pair comes once, with all its columns."""
    for name, value in (("SETS", 40), ("FIRST", 300), ("PACKED", 400), ("BLOCK", 64), ("FEWEST", 8)):
        monkeypatch.setattr(M, name, value)
    rows = token_rows(random.Random(at_least))
    sets = {i: (g, set(t)) for g, i, t in rows if i is not None and g is not None and t}
    want = set()
    for i, (g, x) in sets.items():
        for j, (h, y) in sets.items():
            if i < j and (not by or g == h) and len(x & y) / len(x | y) >= at_least:
                want.add((*((g,) if by else ()), i, j, len(x & y), len(x), len(y), len(x & y) / len(x | y)))
    if not by:
        rows = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame(rows, "g string, id int, tokens array<long>").repartition(5)
    got = [tuple(r) for r in S.overlapping_pairs(df, by, "id", "tokens", at_least).collect()]
    assert len(got) == len(set(got)) and set(got) == want != set()


def test_pairs_are_not_moved(spark):
    """Sets with a common line: what is shuffled grows with the sets, no table of candidates or of both ends is staged."""
    staged = []
    n = 600
    own = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.when(k > 7, F.col("id") * 10 + k).otherwise(-k).cast("long"))
    df = spark.range(n).select("id", own.alias("t"))
    for module in (S, M):
        use = module.stage
        module.stage = lambda frame, label, use=use: (staged.append(label), use(frame, label))[1]
    try:
        found = S.overlapping_pairs(df, [], "id", "t", 0.1)
    finally:
        S.stage = M.stage = stage
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == n * (n - 1) // 2 and staged == ["numbered", "homes"] and "Join Inner" not in plan


def test_runs_of_words_are_equal_where_their_words_are(spark):
    texts = ["a b c d", "A  b\nc d", "b c d e", "a b", "a b", "a", "", "b a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", S.shingle_stream("t", 3).alias("h")).collect()
    h = {r.id: r.h for r in rows}
    assert h[0] == h[1] and h[0][1] == h[2][0] and [len(h[i]) for i in range(8)] == [2, 2, 2, 1, 1, 1, 1, 1]
    assert h[3] == h[4] and len({h[i][0] for i in (0, 2, 3, 5, 6, 7)}) == 6


def test_components_from_few_edges_of_each_task(spark, monkeypatch):
    monkeypatch.setattr(C, "TOGETHER", 100)
    rng = random.Random(6)
    edges = {(rng.randrange(150) * 2, rng.randrange(150) * 2) for _ in range(120)} | {(2 * i + 1, 2 * j + 1) for i in range(1000, 1040) for j in range(1000, i)}
    for kind in ("bigint", "string"):
        given = edge_table(spark, edges, kind).withColumns({"a": F.coalesce("a", F.lit(0).cast(kind)), "b": F.coalesce("b", F.lit(0).cast(kind))})
        batches = "spark.sql.execution.arrow.maxRecordsPerBatch"
        try:
            spark.conf.set(batches, "60")  # columns that cannot be null, and several reductions in a task
            few = C.spanning(given.repartition(3)).collect()
        finally:
            spark.conf.unset(batches)
        assert len(few) <= 3 * (len({v for e in edges for v in e}) - 1) < len(edges)
        names = {v for e in edges for v in e}
        name = (lambda v: v) if kind == "bigint" else (lambda v: "n" * (1 + v % 3) + f"{v:02d}")
        want = component_rule({(a, b) for a, b in edges if a != b})
        back = {name(v): v for v in names}
        assert component_rule({(back[r.a], back[r.b]) for r in few}) == want


def test_reassigned_from_one_reading_of_the_edges(spark):
    """Members move to the representative they match best, items without an edge stay; representatives are written first."""
    edges = spark.createDataFrame([(1, 2, 0.2), (2, 3, 0.9), (4, 5, 0.3)], "a bigint, b bigint, score double")
    items = spark.createDataFrame([(i,) for i in range(1, 8)], "member bigint")
    got = {r.member: r.rep for r in C.cluster(edges, items, C.COMPONENTS, reassign_members=True).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    assert C.symmetric(edges)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_similar_pairs_move_their_texts_once(spark, tmp_path):
    """The language comes with the text: no table of tokens is joined to it."""
    from curata.queries import similarity as Q

    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[i : i + 30]), "en" if i % 3 else "fr") for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    given = []
    use = S.similar_pairs
    try:
        S.similar_pairs = lambda df, *more: (given.append(df), use(df, *more))[1]
        got = {(r.lang, r.a, r.b) for r in Q.similar_pairs(spark, str(tmp_path)).collect()}
    finally:
        S.similar_pairs = use
    langs = {i: lang for i, _, lang in rows}
    assert got == {(langs[i], i, j) for i in range(8) for j in range(i + 1, 8) if langs[i] == langs[j]}
    assert "tokens" in given[0].columns and "Join Inner" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
