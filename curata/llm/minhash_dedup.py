"""Near-duplicate documents by a multi-index Hamming join over MinHash signatures.

A document's set holds its distinct runs of four words (fewer words: the whole
sequence as one).  Two documents are linked when their sets have a Jaccard
similarity of ``PERCENT`` or more; a class is a set, so exact copies are one
class and never become pairs.

**Signatures.**  ``SYMBOLS`` MinHash values, each cut to ``BITS`` bits.  Two
sets differ in a symbol with probability 1 - J.

**Multi-index join.**  A signature is split into ``CHUNKS`` chunks of eight
symbols.  Two signatures with at most ``2 * CHUNKS - 1`` = 31 differing symbols
have a chunk with at most one (pigeonhole), so every class enters the index
under all eight ways to leave one symbol of a chunk out.  All pairs within that
distance are found for certain.  Sets at J = 0.8 differ in 26 symbols on
average, and a pair beyond 31 still needs every one of 16 chunks to differ
twice: at J = 0.8 that has probability 1.4e-5, at 0.85 it is 1e-8.

**Exact links.**  Classes that share an index entry are joined through the
smallest class of the entry (a star, never all pairs); the components of
these stars hold every candidate pair.  Within a component, the pairs are
counted exactly on full sets, in blocks: a component is cut into blocks of
``SIDE`` classes by hash, and a task counts one pair of blocks as a product of
membership matrices.  Only real links leave a task, of those only a spanning
forest.  A component of one block costs one task; work grows with the square
of the classes that are candidates of each other, not of copies.

Nulls: a document without words or text has no set, is linked with nothing and
kept.  Equal rows are one class and each gets the class's answer.  A null
doc_id is ignored where the smallest is sought.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import (
    NOT_BLANK, U64, Block, Rolling, blocks, longs, lowered, mix, per_text, record, word_bounds,
)
from curata.llm.tables import NULL_IDS, identified, keys, packed, settle, unpacked, whole_text
from curata.operators.clustering import connected_components

WORDS = 4
PERCENT = 80
CHUNKS = 16
IN_CHUNK = 8
SYMBOLS = CHUNKS * IN_CHUNK
BITS = 32
SIDE = 512
COLUMNS = 4096


def shingles(block: Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of all runs of words and their text numbers; a short text is one run."""
    low = lowered(block.data)
    start, end, text = word_bounds(low, block.ends, NOT_BLANK)
    texts = len(block.ends) - 1
    count = per_text(text, texts)
    word = mix(Rolling(low, 1).of(start, end) + (end - start).astype(U64))
    last = np.cumsum(count)
    # Run i covers words i .. i + words - 1, or to the end of a short text.
    position = np.arange(len(word)) - (last - count)[text]
    heads = position <= np.maximum(count[text] - words, 0)
    at, text = np.flatnonzero(heads), text[heads]
    code = np.zeros(len(at), U64)
    for j in range(words):
        inside = at + j < last[text]
        code = mix(code * U64(0x9E3779B97F4A7C15) + U64(j + 1))
        code[inside] += word[at[inside] + j]
    return mix(code), text


def sets(block: Block) -> list[np.ndarray]:
    """The sorted distinct codes of each text."""
    code, text = shingles(block)
    parts = np.split(code, np.cumsum(per_text(text, len(block.ends) - 1))[:-1])
    return [np.unique(p) for p in parts]


def multipliers(symbols: int = SYMBOLS) -> np.ndarray:
    return mix(np.arange(1, symbols + 1, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)


def signatures(code: np.ndarray, count: np.ndarray, bits: int = BITS) -> np.ndarray:
    """One row of symbols per text that has codes."""
    heads = np.cumsum(count) - count
    return np.stack(
        [(np.minimum.reduceat(code * m, heads) >> U64(64 - bits)).astype(np.uint32) for m in multipliers()], axis=1
    )


def index_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit entry for every chunk and every symbol left out of it."""
    out = []
    for chunk in range(CHUNKS):
        part = signature[:, chunk * IN_CHUNK : (chunk + 1) * IN_CHUNK].astype(U64)
        for hole in range(IN_CHUNK):
            key = np.full(len(part), chunk * IN_CHUNK + hole + 1, U64)
            for j in range(IN_CHUNK):
                if j != hole:
                    key = mix(key * U64(0x9E3779B97F4A7C15) + part[:, j])
            out.append(key)
    return np.stack(out, axis=1)


_DIGEST = pa.schema(
    [("_doc", pa.int64()), ("_tag", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("signature", pa.binary())]
)


def _digests(batches):
    for block in blocks(batches):
        found = sets(block)
        count = np.array([len(s) for s in found], np.int64)
        has = np.flatnonzero(count)
        node, signature = np.zeros(len(found), np.int64), [None] * len(found)
        if len(has):
            code = np.concatenate([found[i] for i in has])
            heads = np.cumsum(count[has]) - count[has]
            # The name of a class: a sum over its set, independent of order.
            total = np.add.reduceat(mix(code ^ U64(0x5851F42D4C957F2D)), heads) + count[has].astype(U64)
            node[has] = mix(total).view(np.int64)
            for i, row in zip(has, signatures(code, count[has])):
                signature[i] = row.tobytes()
        yield record(
            _DIGEST, block.rows.column("_doc"), block.rows.column("_tag"), count, node,
            pa.array(signature, pa.binary()),
        )


def digests(docs: DataFrame) -> DataFrame:
    """``_doc, _tag, n, node, signature``: set size, class and signature of every row."""
    return identified(docs).mapInArrow(_digests, "_doc long, _tag long, n long, node long, signature binary")


def candidate_stars(classes: DataFrame) -> DataFrame:
    """``a, b``: a class and the smallest class that shares an index entry with it."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def entries(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                if part.num_rows:
                    raw = b"".join(part.column("signature").to_pylist())
                    keys = index_keys(np.frombuffer(raw, np.uint32).reshape(-1, SYMBOLS))
                    yield record(schema, longs(keys.ravel()), np.repeat(np.asarray(part.column("node")), keys.shape[1]))

    rows = classes.select("node", "signature").mapInArrow(entries, "key long, node long")
    shared = settle(
        rows.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").drop("z"),
        "minhash-entries",
    )
    return rows.join(shared, "key").filter("a <> node").select("a", F.col("node").alias("b")).distinct()


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The mask of links that join something new; links come as row numbers."""
    parent: dict[int, int] = {}

    def top(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[x] = y
            keep[i] = True
    return keep


def exact_links(found: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of sets with that similarity, by products of membership matrices."""
    size = np.array([len(s) for s in found], np.int64)
    owner, code = np.repeat(np.arange(len(found)), size), np.concatenate(found)
    _, column, times = np.unique(code, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(found), len(found)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + COLUMNS))
        member = np.zeros((len(found), min(COLUMNS, int(column[-1]) + 1 - first)), np.float32)
        member[owner[lo:hi], column[lo:hi] - first] = 1
        both += member @ member.T
    both = np.rint(np.triu(both, 1)).astype(np.int64)
    a, b = np.nonzero(both)
    common = both[a, b]
    linked = 100 * common >= percent * (size[a] + size[b] - common)
    return a[linked], b[linked]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _block_links(key, table):
    nodes, first = np.unique(np.asarray(table.column("node")), return_index=True)
    column = table.column("codes")
    found = [np.frombuffer(column[int(i)].as_py(), U64) for i in first]
    a, b = exact_links(found)
    keep = _forest(a, b)
    return pa.table({"a": nodes[a[keep]], "b": nodes[b[keep]]}, schema=_LINK)


def links(docs: DataFrame, digest: DataFrame) -> DataFrame:
    """``a, b``: enough links between classes to join all that are connected."""
    classes = (
        digest.filter("n > 0")
        .groupBy("node")
        .agg(F.min(F.struct("_doc", "_tag", "n", "signature")).alias("r"))
        .select("node", "r.*")
    )
    classes = settle(classes, "minhash-classes")
    group = settle(connected_components(candidate_stars(classes)), "minhash-groups")
    parts = group.groupBy("rep").agg(F.ceil(F.count("*") / F.lit(SIDE)).cast("int").alias("parts"))
    placed = group.join(parts, "rep").select(
        F.col("member").alias("node"), "rep", "parts", F.pmod(F.xxhash64("member"), "parts").cast("int").alias("own")
    )
    chosen = classes.join(placed, "node").select("node", "_doc", "_tag", "rep", "parts", "own")

    def codes(batches):
        schema = pa.schema([("node", pa.int64()), ("rep", pa.int64()), ("parts", pa.int32()), ("own", pa.int32()), ("codes", pa.binary())])
        for block in blocks(unpacked(batches)):
            yield record(
                schema, *(block.rows.column(c) for c in ("node", "rep", "parts", "own")), [s.tobytes() for s in sets(block)]
            )

    full = (
        packed(docs)
        .join(chosen, ["_doc", "_tag"])
        .select("node", "rep", "parts", "own", "packed")
        .mapInArrow(codes, "node long, rep long, parts int, own int, codes binary")
    )
    # A class meets every block of its component, its own included.
    pairs = full.select(
        "node", "rep", "own", "codes", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select("node", "rep", "codes", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    return settle(pairs.groupBy("rep", "x", "y").applyInArrow(_block_links, "a long, b long"), "minhash-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``_doc, _tag, n_shingles, component_id``: the smallest doc_id reachable from each row."""
    digest = settle(digests(docs), "minhash-digests")
    joined = connected_components(links(docs, digest))
    named = digest.select("_doc", "_tag", "n", "node")
    lowest = (
        named.filter(f"n > 0 AND _doc >= {NULL_IDS}").groupBy("node").agg(F.min("_doc").alias("lo"))
        .join(joined.select(F.col("member").alias("node"), "rep"), "node", "left")
        .withColumn("rep", F.coalesce("rep", "node"))
    )
    lowest = settle(lowest, "minhash-lowest")
    # Most components are one class; only the linked ones need their minimum.
    linked = lowest.filter("rep <> node").select("rep").distinct()
    least = lowest.join(linked, "rep").groupBy("rep").agg(F.min("lo").alias("least"))
    answer = lowest.join(least, "rep", "left").select("node", F.coalesce("least", "lo").alias("component_id"))
    return named.join(answer, "node", "left").select(
        F.when(F.col("_doc") >= NULL_IDS, F.col("_doc")).alias("doc_id"),
        "_tag",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id"))
        .otherwise(F.when(F.col("_doc") >= NULL_IDS, F.col("_doc")))
        .alias("component_id"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The registered form: a null doc_id is kept."""
    return found.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def one_row_of_each(docs: DataFrame) -> DataFrame:
    """Exactly one row of each component: the smallest by doc_id (null last), tag of the text, and all values.

    Rows without words are linked with nothing and all stay.  A column of maps
    does not count among the values; of rows equal but for it, any one stays.
    """
    digest = settle(digests(docs), "minhash-digests")
    joined = connected_components(links(docs, digest)).select(F.col("member").alias("node"), "rep")
    first = F.struct((F.col("_doc") < NULL_IDS).alias("without_id"), "_doc", "_tag")
    lowest = digest.filter("n > 0").groupBy("node").agg(F.min(first).alias("r")).join(joined, "node", "left")
    keep = lowest.groupBy(F.coalesce("rep", "node").alias("rep")).agg(F.min("r").alias("r"))
    keep = keep.select(F.col("r._doc").alias("_kept_doc"), F.col("r._tag").alias("_kept_tag"))
    # The bytes of NOT_BLANK; a character beyond ASCII has none of the others.
    worded = whole_text().rlike(r"[^\x20\x09-\x0D]")
    (doc, tag), row = keys(), F.struct(*[docs[c] for c in docs.columns])
    ordered = F.struct(*[docs[c] for c, kind in docs.dtypes if "map<" not in kind])
    # Repeats of a row meet inside tasks first, so a hot one is one row per task.
    rows = docs.filter(worded).groupBy(doc.alias("_doc"), tag.alias("_tag")).agg(F.min_by(row, ordered).alias("row"))
    same = (F.col("_doc") == F.col("_kept_doc")) & (F.col("_tag") == F.col("_kept_tag"))
    return docs.filter(~worded).unionByName(rows.join(keep, same, "left_semi").select("row.*"))
