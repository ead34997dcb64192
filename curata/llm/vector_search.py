"""Nearest neighbours by inner product: inverted lists scanned by adaptive dimensions.

* **Lists.**  K-means centres are fitted on at most ``FIT_ROWS`` vectors (those
  with the lowest hash of vec_id); every vector goes to its nearest centre.
* **Rotation.**  Vectors are turned by a random orthogonal matrix, so that the
  distance over the first dimensions estimates the whole distance.
* **Adaptive scan.**  A list is held as column blocks of ``COLUMNS`` dimensions.
  For each query, the first vectors of the list are scored in full and set the
  bar; for the rest, distances grow block by block, and after each block a
  hypothesis test abandons those whose estimate is above the bar by a factor of
  ``1 + SURE / sqrt(dimensions seen)``.  The inner product bar of a vector
  is a distance bar: |q|^2 + |v|^2 - 2 * bar.
* **Scores** of the survivors are inner products of the original vectors, in
  double precision, summed in one order, so equal vectors tie exactly.

A list may hold any share of the vectors: it is cut into blocks of about
``BLOCK`` vectors and its queries into blocks of ``QUERIES``; a task scans one
pair of blocks and returns the nearest few per query.

Vectors that are null, all zero, hold null or non-finite components, or have
another length than most vectors take no part; nor do rows with a null vec_id.
Repeated rows are candidates of their own; of repeated queries one is used,
and a query never finds its own vec_id.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.llm.kernels import record
from curata.llm.tables import settle

NEAREST = 20
LISTS = 64
PROBES = 48
FIT_ROWS = 20_000
COLUMNS = 16
SURE = 2.1
BLOCK = 8192
QUERIES = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: the vectors that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select("vec_id", v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (sizes["n"] if sizes else 0))


def rotation(dimensions: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """K-means on the sample; empty clusters keep their centre."""
    found = np.unique(sample, axis=0)
    found = found[np.random.default_rng(3).permutation(len(found))[:lists]]
    for _ in range(rounds):
        own = nearest_list(sample, found)
        count = np.bincount(own, minlength=len(found))
        total = np.stack([np.bincount(own, sample[:, j], len(found)) for j in range(sample.shape[1])], axis=1)
        found = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], found)
    return found


def nearest_list(v: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return np.argmin((middle**2).sum(1) - 2 * v @ middle.T, axis=1)


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def scan(query: np.ndarray, rotated_query: np.ndarray, v: np.ndarray, rotated: np.ndarray, norms: np.ndarray, ids, own: int, k: int):
    """The best ``k`` of a block for one query: ids and scores, by (score, smaller id)."""
    dims = rotated.shape[0]
    bar = -np.inf
    head = min(len(ids), 4 * k)
    score = lambda rows: (v[rows] * query).sum(axis=1)
    first = score(np.arange(head))
    other = first[ids[:head] != own]
    if len(other) >= k:
        bar = np.partition(other, -k)[-k]
    alive = np.arange(head, len(ids))
    if len(alive) and np.isfinite(bar):
        limit = norms[alive] + query @ query - 2 * bar
        keep = limit >= -1e-9
        alive, limit = alive[keep], limit[keep] * (1 + 1e-9) + 1e-9
        part = np.zeros(len(alive))
        for at in range(0, dims, COLUMNS):
            to = min(at + COLUMNS, dims)
            for j in range(at, to):
                part += (rotated[j, alive] - rotated_query[j]) ** 2
            sure = (1 + SURE / np.sqrt(to)) ** 2 if to < dims else 1 + 1e-9
            keep = part * (dims / to) <= limit * sure
            alive, limit, part = alive[keep], limit[keep], part[keep]
            if not len(alive):
                break
    rows = np.concatenate([np.arange(head), alive])
    value = np.concatenate([first, score(alive)])
    mine = ids[rows] != own
    rows, value = rows[mine], value[mine]
    order = np.lexsort((ids[rows], -value))[:k]
    return ids[rows][order], value[order]


_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, lists: int = LISTS, probes: int = PROBES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found among ``vectors`` for each row of ``queries``."""
    rows = settle(usable(vectors), "vectors")
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).collect()]
    if not sample:
        return rows.select(
            F.col("vec_id").cast("long").alias("query_id"), F.lit(0).alias("rank"), F.col("vec_id").cast("long"), F.lit(0.0).alias("score")
        ).limit(0)
    middle = centres(np.array(sample), lists)
    turn = rotation(middle.shape[1])

    def place(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("list", pa.int32()), ("v", pa.list_(pa.float64()))])
        for batch in batches:
            if batch.num_rows:
                own = nearest_list(matrix(batch.column("v")), middle)
                yield record(schema, batch.column("vec_id").cast(pa.int64()), own.astype(np.int32), batch.column("v").cast(schema[2].type))

    def probe(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("list", pa.int32()), ("v", pa.list_(pa.float64()))])
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(matrix(batch.column("v")) @ middle.T), axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                yield record(schema, batch.column("vec_id").cast(pa.int64()).take(at), near.ravel().astype(np.int32), batch.column("v").cast(schema[2].type).take(at))

    kinds = "vec_id long, list int, v array<double>"
    placed = settle(rows.mapInArrow(place, kinds), "vector-lists")
    probed = settle(asked.mapInArrow(probe, kinds), "vector-probes")
    # One row per list at most, whatever the number of vectors.
    parts = (
        placed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("vs"))
        .join(probed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("qs")), "list")
    )
    parts = F.broadcast(parts)
    mine = F.xxhash64("vec_id")
    left = placed.join(parts, "list").select(
        "list", "vec_id", "v", F.pmod(mine, "vs").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("y")
    )
    right = probed.join(parts, "list").select(
        "list", "vec_id", "v", F.pmod(mine, "qs").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("x")
    )

    def pair(held, wanted):
        out = [[], [], []]
        if held.num_rows and wanted.num_rows:
            ids, v = np.asarray(held.column("vec_id").combine_chunks()), matrix(held.column("v"))
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            rotated, norms = np.ascontiguousarray((v @ turn).T), (v**2).sum(1)
            q = matrix(wanted.column("v"))
            for own, query, turned in zip(wanted.column("vec_id").to_pylist(), q, q @ turn):
                found, value = scan(query, turned, v, rotated, norms, ids, own, k)
                out[0].append(np.full(len(found), own, np.int64))
                out[1].append(found)
                out[2].append(value)
        return pa.table([np.concatenate(c) if c else np.zeros(0) for c in out], names=_HIT.names).cast(_HIT)

    found = left.groupBy("list", "x", "y").cogroup(right.groupBy("list", "x", "y")).applyInArrow(
        pair, "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
