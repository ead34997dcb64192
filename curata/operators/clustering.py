"""Cluster similar items: candidates, set cover, components, greedy by length.

Edges are ``a, b, score`` with ``a != b``, each pair once in any direction.
Results are ``member, rep``; items without edges are their own representative.
The loops below run on edge tables; the driver only reads counts, and every
round is written to the shared staging folder.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.hashing import col, digest, sort_hash
from curata.operators import pairs
from curata.operators.ordered import top_per_group
from curata.schema import cluster_column
from curata.session import stage, stage_once

SET_COVER, COMPONENTS, BY_LENGTH, BY_CLASS = "set_cover", "components", "by_length", "by_length_class"


# --- candidates -----------------------------------------------------------


def selected_tokens(tokens, m: int, mode: str = "xxhash64") -> Column:
    """The ``m`` lowest hashes of a set of tokens."""
    hashed = F.transform(col(tokens), lambda t: F.md5(t) if mode == "md5" else F.xxhash64(t))
    return F.slice(F.sort_array(hashed), 1, m)


def star_candidates(df: DataFrame, item: str, selected: str, size: str) -> DataFrame:
    """Pairs ``(a, b)``: each item with the largest item of every token it selects.

    ``selected`` holds the few tokens from ``selected_tokens``.  The items of a
    token meet only its centre (largest size, then smallest id), so an item has
    at most as many pairs as selected tokens, however many items share one.
    """
    rows = df.select(F.col(item).alias("a"), F.col(size).alias("_size"), F.explode(selected).alias("_token"))
    largest = F.min(F.struct((-F.col("_size")).alias("s"), F.col("a").alias("b")))
    centres = rows.groupBy("_token").agg(largest.alias("_c")).select("_token", F.col("_c.b").alias("b"))
    return rows.join(centres, "_token").filter("a != b").select("a", "b").distinct()


def cap_candidates(candidates: DataFrame, max_seqs: int, score: str = "score") -> DataFrame:
    """The ``max_seqs`` best candidates of each query, the smaller id first of equals."""
    return top_per_group(candidates, ["a"], [F.col(score).desc(), "b"], max_seqs)


def shared_tokens(candidates: DataFrame, df: DataFrame, item: str, tokens: str) -> DataFrame:
    """Add the set sizes ``size_a``, ``size_b`` and the number ``shared``."""
    side = lambda name: df.select(F.col(item).alias(name), F.col(tokens).alias(f"_t{name}"))
    return (
        candidates.join(side("a"), "a")
        .join(side("b"), "b")
        .select(
            "a",
            "b",
            F.size("_ta").alias("size_a"),
            F.size("_tb").alias("size_b"),
            F.size(F.array_intersect("_ta", "_tb")).alias("shared"),
        )
    )


def identity_score(shared="shared", a="size_a", b="size_b", mode: int = 0) -> Column:
    """Share of common tokens over (0) their union, (1) the smaller, (2) the larger set."""
    s, x, y = F.col(shared), F.col(a), F.col(b)
    return [s / (x + y - s), s / F.least(x, y), s / F.greatest(x, y)][mode]


def covered(
    coverage: float, mode: int = 0, min_aln_len: int = 0, shared="shared", a="size_a", b="size_b"
) -> Column:
    """Whether the common part covers (0) both items, (1) the target ``b``, (2) the query ``a``."""
    s = F.col(shared)
    target, query = s / F.col(b) >= coverage, s / F.col(a) >= coverage
    return [target & query, target, query][mode] & (s >= min_aln_len)


def spanned(x, y, width: int) -> Column:
    """Share of ``x`` between its first and its last token that ``y`` has too.

    Both are all tokens of an item in order, each of them ``width`` units long.
    """
    def reach(t):
        # array_intersect keeps the order of its first argument.
        back = F.reverse(t)
        first = F.array_position(t, F.get(F.array_intersect(t, y), F.lit(0)))
        last = F.size(t) + 1 - F.array_position(back, F.get(F.array_intersect(back, y), F.lit(0)))
        return (last - first + width) / (F.size(t) + width - 1)

    return pairs.bind(x, reach)


def spanning_edges(
    items: DataFrame, item: str, tokens: str, at_least: float, width: int, coverage: float = 0.8, cov_mode: int = 0,
    identity_mode: int = 0, min_aln_len: int = 0,
) -> DataFrame:
    """Edges ``a, b, score`` of all pairs with an identity of at least ``at_least`` and enough coverage.

    ``tokens`` are all tokens of an item in order, each ``width`` units long.
    Identity is the share of distinct common tokens, coverage the stretch they
    span (of both items, of ``b`` or of ``a``, by ``cov_mode``, in units), so
    the one does not decide the other.  Every pair that qualifies is found.
    Give one item of each group of equal ones.
    """
    sets = items.select(item, F.array_distinct(tokens).alias("_set"))
    found = pairs.similar_pairs(sets, [], item, "_set", at_least, identity_mode)
    return covering(found, items, item, tokens, width, coverage, cov_mode, min_aln_len)


def covering(
    found: DataFrame, items: DataFrame, item: str, tokens: str, width: int, coverage: float = 0.8, cov_mode: int = 0, min_aln_len: int = 0
) -> DataFrame:
    """The pairs ``a, b, score`` whose common stretch covers enough; see ``spanning_edges``."""
    def use(x, y):
        x, y = x["_t"], y["_t"]
        return F.struct(
            spanned(x, y, width).alias("_sa"), spanned(y, x, width).alias("_sb"), F.size(x).alias("_na"), F.size(y).alias("_nb")
        )

    streams = items.select(F.col(item).alias("_id"), F.col(tokens).alias("_t"))
    spans = pairs.in_blocks(found.select("a", "b", "score"), streams, [], ["_t"], use).select("a", "b", "score", "value.*")
    target, query = F.col("_sb") >= coverage, F.col("_sa") >= coverage
    long = F.least(F.col("_sa") * (F.col("_na") + width - 1), F.col("_sb") * (F.col("_nb") + width - 1)) >= min_aln_len
    return spans.filter([target & query, target, query][cov_mode] & long).select("a", "b", "score")


# --- graph rounds ---------------------------------------------------------


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without loops and repeats."""
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    # One pass over the edges, which may cost much to find.
    return edges.filter("a != b").select(F.explode(both).alias("_e")).select("_e.*").distinct()


#: Edges that a task reduces at once.
TOGETHER = 1 << 21


def _star_kernel(together: int):
    """An Arrow function: edges ``a, b`` that connect the same items, one an item and task at most."""
    def stars(table):
        ends = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks().dictionary_encode()
        a, b = np.split(ends.indices.to_numpy(), 2)
        root = np.arange(len(ends.dictionary), dtype=a.dtype)
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.Table.from_arrays([ends.dictionary.take(pa.array(at)) for at in (moved, root[moved])], schema=table.schema)

    def shrunk(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += len(batch)
            if rows > together:
                held, rows = [stars(pa.concat_tables(held))], 0
        if held:
            yield from stars(pa.concat_tables(held)).to_batches()

    return shrunk


def spanning(edges: DataFrame) -> DataFrame:
    """Few edges ``a, b`` with the components of ``edges``: each task keeps what connects its own."""
    both = edges.filter("a != b").select("a", "b")
    return both.mapInArrow(_star_kernel(TOGETHER), both.schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """``member, rep`` for every item with an edge; ``rep`` is the smallest id reached.

    Each round every node points at the neighbour (or itself) with the lowest
    hash for that round, nodes with one target merge, and edges shrink to those
    between targets.  The number of nodes falls by a constant factor per round
    in expectation, for stars and long paths alike.
    """
    edges = stage(symmetric(spanning(edges)), "cc-edges")
    steps = []
    while not edges.isEmpty():
        seed = len(steps)
        key = lambda c: F.struct(sort_hash(seed, c).alias("h"), F.col(c).alias("v"))
        nearest = edges.groupBy("a").agg(F.min(key("b")).alias("_best"))
        own = key("a")
        points = stage(nearest.select("a", F.least(own, F.col("_best"))["v"].alias("to")), "cc-points")
        steps.append(points)
        to_b = points.select(F.col("a").alias("b"), F.col("to").alias("_to_b"))
        moved = (
            edges.join(points, "a").join(to_b, "b").select(F.col("to").alias("a"), F.col("_to_b").alias("b"))
        )
        edges = stage(moved.filter("a != b").distinct(), "cc-edges")
    if not steps:
        return edges.select(F.col("a").alias("member"), F.col("b").alias("rep"))
    # Nodes that later rounds moved on are resolved from the last round back.
    labels = steps[-1]
    for points in reversed(steps[:-1]):
        later = labels.select(F.col("a").alias("to"), F.col("to").alias("_final"))
        labels = points.join(later, "to", "left").select("a", F.coalesce("_final", "to").alias("to"))
    labels = stage(labels, "cc-labels")
    smallest = labels.groupBy("to").agg(F.min("a").alias("rep"))
    return labels.join(smallest, "to").select(F.col("a").alias("member"), "rep")


def _highest_near(edges: DataFrame, nodes: DataFrame, value: str, out: str) -> DataFrame:
    """The highest ``value`` of each node and its neighbours."""
    near = (
        edges.join(nodes.select(F.col("v").alias("b"), F.col(value).alias("_x")), "b")
        .groupBy(F.col("a").alias("v"))
        .agg(F.max("_x").alias("_x"))
    )
    return nodes.join(near, "v", "left").withColumn(out, F.greatest(F.col(value), F.col("_x"))).drop("_x")


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    a, b = gone.select(F.col("member").alias("a")), gone.select(F.col("member").alias("b"))
    return edges.join(a, "a", "left_anti").join(b, "b", "left_anti")


def set_cover(edges: DataFrame) -> DataFrame:
    """Greedy set cover: the node with most uncovered neighbours takes them, repeatedly.

    Ties go to the higher seeded hash of the id, then to the smaller id.  A node
    that is the best within two hops would be taken by the sequential rule
    before anything near it changes, so all such nodes are taken in one round;
    the result equals the sequential one.  Among ties the hash makes a fixed
    share of nodes the best near them, so rounds grow with the logarithm.
    """
    edges = stage(symmetric(edges), "sc-edges")
    order = stage(_descending_ids(edges), "sc-ids")
    parts = []
    everyone = order.select("v")
    while not edges.isEmpty():
        degree = edges.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("_degree"))
        nodes = stage(
            degree.join(order, "v").select("v", F.struct("_degree", "_tie", "_down").alias("_p")), "sc-nodes"
        )
        one_hop = stage(_highest_near(edges, nodes, "_p", "_p1"), "sc-hop")
        two_hop = _highest_near(edges, one_hop, "_p1", "_p2")
        reps = two_hop.filter("_p = _p2").select(F.col("v").alias("rep"))
        claimed = edges.join(reps, F.col("a") == F.col("rep")).select(F.col("b").alias("member"), "rep")
        taken = stage(claimed.unionByName(reps.select(F.col("rep").alias("member"), "rep")), "sc-taken")
        parts.append(taken)
        edges = stage(_without(edges, taken), "sc-edges")
    return _with_rest(everyone, parts)


def _descending_ids(edges: DataFrame) -> DataFrame:
    """Nodes with ``_tie``, a hash, and ``_down``, a value that is larger for smaller ids.

    Numeric ids are negated.  Other ids get the bitwise complement of their
    bytes (as hex, closed by a digit above the rest), which reverses the byte
    order of any two strings.
    """
    nodes = edges.select(F.col("a").alias("v")).distinct().withColumn("_tie", digest(0, "v"))
    if dict(nodes.dtypes)["v"] in ("bigint", "int", "smallint", "tinyint"):
        return nodes.withColumn("_down", -F.col("v").cast("bigint"))
    flipped = F.translate(F.hex(F.col("v").cast("string")), "0123456789ABCDEF", "FEDCBA9876543210")
    return nodes.withColumn("_down", F.concat(flipped, F.lit("G")))


def _with_rest(everyone: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """All assignments; nodes whose neighbours were all taken stand alone."""
    if not parts:
        return everyone.select(F.col("v").alias("member"), F.col("v").alias("rep"))
    taken = reduce(DataFrame.unionByName, parts)
    return everyone.select(F.col("v").alias("member")).join(taken, "member", "left").withColumn(
        "rep", F.coalesce("rep", "member")
    )


def greedy_by_length(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """Longest item first: it takes its uncovered neighbours; ties go as in ``set_cover``.

    ``lengths`` has ``v, len``.  A node that no neighbour outranks is taken in
    the round it becomes so; every other node joins its highest-ranked
    representative once all rounds are done, as the sequential rule does.
    Rounds grow with the logarithm among equal lengths, but with the longest
    path along which lengths fall.
    """
    return _greedy(edges, lengths.select("v", "len"))


def greedy_by_class(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """``greedy_by_length`` by classes of length, the powers of two.

    The class decides, then the hash: among items whose lengths differ by less
    than two times, any may be first.  So a path along which lengths fall
    slowly is broken at random places, and rounds grow with the logarithm of
    its length and the number of classes.
    """
    size = F.when(F.col("len") >= 1, F.floor(F.log2(F.col("len").cast("double")))).otherwise(F.lit(-1))
    return _greedy(edges, lengths.select("v", size.cast("long").alias("len")))


def _greedy(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """The sequential rule for nodes by ``len``, the hash and the id, as many as possible in a round."""
    all_edges = stage(symmetric(edges), "gl-edges")
    order = _descending_ids(all_edges)
    nodes = stage(order.join(ranks, "v").select("v", F.struct("len", "_tie", "_down").alias("_p")), "gl-nodes")
    edges, alive, parts = all_edges, nodes, []
    while not alive.isEmpty():
        top = _highest_near(edges, alive, "_p", "_p1")
        reps = stage(top.filter("_p = _p1").select("v", "_p"), "gl-reps")
        parts.append(reps)
        hit = edges.join(reps.select(F.col("v").alias("a")), "a", "left_semi").select(F.col("b").alias("member"))
        gone = stage(hit.union(reps.select("v")).distinct(), "gl-gone")
        edges = stage(_without(edges, gone), "gl-edges")
        alive = stage(alive.join(gone.withColumnRenamed("member", "v"), "v", "left_anti"), "gl-nodes")
    if not parts:
        return nodes.select(F.col("v").alias("member"), F.col("v").alias("rep"))
    reps = reduce(DataFrame.unionByName, parts)
    near = all_edges.join(reps.select(F.col("v").alias("b"), "_p"), "b").join(
        reps.select(F.col("v").alias("a")), "a", "left_anti"
    )
    joined = near.groupBy(F.col("a").alias("member")).agg(F.max(F.struct("_p", F.col("b").alias("rep"))).alias("_t"))
    return joined.select("member", F.col("_t.rep").alias("rep")).unionByName(
        reps.select(F.col("v").alias("member"), F.col("v").alias("rep"))
    )


def reassign(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Move each member to the representative it scores highest with.

    Representatives stay; members without an edge to one keep theirs.  Equal
    scores go to the smaller representative.
    """
    # Written first: where they are few, the edges need not be moved to meet them.
    reps = stage(clusters.select("rep").distinct(), "reps")
    directed = pairs.both_directions(edges, [])
    options = directed.join(reps.withColumnRenamed("rep", "b"), "b", "left_semi")
    best = top_per_group(options, ["a"], [F.col("score").desc(), "b"], 1).select(
        F.col("a").alias("member"), F.col("b").alias("_best")
    )
    return clusters.join(best, "member", "left").select(
        "member",
        F.when(F.col("member") == F.col("rep"), F.col("rep"))
        .otherwise(F.coalesce("_best", "rep"))
        .alias("rep"),
    )


#: Clusterings by name: functions of edges and lengths that give ``member, rep`` of all nodes with edges.
MODES = {
    SET_COVER: lambda edges, lengths: set_cover(edges),
    COMPONENTS: lambda edges, lengths: connected_components(edges),
    BY_LENGTH: greedy_by_length,
    BY_CLASS: greedy_by_class,
}


def cluster(
    edges: DataFrame, items: DataFrame, mode: str = SET_COVER, lengths: DataFrame | None = None, reassign_members: bool = False
) -> DataFrame:
    """``member, rep`` for all ``items`` (column ``member``)."""
    if mode not in MODES:
        raise ValueError(f"unknown cluster mode {mode!r}; known: {sorted(MODES)}")
    found = MODES[mode](edges, lengths)
    if reassign_members:
        found = reassign(found, edges)
    return items.join(found, "member", "left").withColumn("rep", F.coalesce("rep", "member"))


def threshold_sweep(
    scored: DataFrame, items: DataFrame, thresholds, method: str, mode: str = SET_COVER, lengths=None,
    reassign_members: bool = False,
) -> DataFrame:
    """One cluster column per threshold; pairs are scored once, at the lowest."""
    out = items
    for t in thresholds:
        found = cluster(scored.filter(F.col("score") >= t), items, mode, lengths, reassign_members)
        out = out.join(found.withColumnRenamed("rep", cluster_column(method, t)), "member")
    return out


def resumable_sweep(
    spark: SparkSession, path: str, scored, items: DataFrame, thresholds, method: str, mode: str = SET_COVER, lengths=None
) -> DataFrame:
    """``threshold_sweep`` that keeps each finished step under ``path`` and reuses it.

    ``scored`` is a function that builds the scored pairs; it is only called
    when they are not there yet.  ``path`` must name the input and the mode: give
    others another one.
    """
    pairs = stage_once(spark, f"{path}/pairs", scored)
    out = items
    for t in thresholds:
        name = cluster_column(method, t)
        found = stage_once(
            spark, f"{path}/{name}", lambda t=t: cluster(pairs.filter(F.col("score") >= t), items, mode, lengths)
        )
        out = out.join(found.withColumnRenamed("rep", name), "member")
    return out


def content_key(text) -> Column:
    """A key of equal content, for collapsing copies before clustering."""
    return digest(0, text)
