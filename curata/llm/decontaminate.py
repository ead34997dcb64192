"""Find benchmark passages in documents by their word windows, on SQL expressions alone.

Words are lower-cased (A-Z only) runs of digits, letters and all bytes above
0x7F.  A window is ``WINDOW`` consecutive words of a benchmark item; an item of
fewer words, but not none, is one window.  A word of a document inside any
occurrence of a window is hit.

The main path puts 64-bit hashes of the windows into a set that every task
gets, tests each position of a document against it without moving the text,
and verifies hits on the words themselves.  The set is sent only if the
benchmark has at most ``MAX_SET`` different windows (8 bytes each), which is
counted first.  A larger benchmark is joined by window hash instead; both ways
give the same rows.

Nulls: a null text has no words; a null item text gives no window; null ids
stay null (and a null item_id is left out of the list of items).  Every input
row gives one row, equal rows too.  An empty benchmark hits nothing, an empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.tables import fresh, settle, whole_text

WINDOW = 10
MAX_SET = 200_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    low = F.translate(text, UPPER, LOWER)
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``probe, size, window, items``: every different window with the sorted ids of its items."""
    split = items.select("item_id", words(whole_text()).alias("w")).filter("size(w) > 0")
    size = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    return (
        split.select("item_id", size.alias("size"), F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
        .groupBy("size", "window")
        .agg(F.array_distinct(F.array_sort(F.collect_list(F.col("item_id").cast("string")))).alias("items"))
        .withColumn("probe", _probe(F.col("window"), F.lit(0), F.col("size")))
    )


def _probe(w: Column, at, size) -> Column:
    """A hash of three words of the window at ``at`` (0-based) and its length; cheap to test at every position."""
    word = lambda i: F.get(w, i)
    half = F.floor(size / 2).cast("int")
    return F.xxhash64(size, word(at), word(at + half), word(at + size - 1))


def _positions(size: int, test) -> Column:
    """The 0-based positions of windows of ``size`` words in ``w`` that pass a test."""
    starts = F.when(F.size("w") >= size, F.sequence(F.lit(0), F.size("w") - size)).otherwise(
        F.array().cast("array<int>")
    )
    return F.filter(starts, test)


def _found(size: int, hashes: list[int] | None) -> Column:
    """The windows of one size in ``w`` that may be known, as an array of structs."""
    length = F.lit(size)
    test = lambda i: _probe(F.col("w"), i, length).isin(hashes)
    if hashes is None:
        test = lambda i: F.lit(True)
    return F.transform(
        _positions(size, test),
        lambda i: F.struct(i.alias("at"), length.alias("size"), F.slice(F.col("w"), i + 1, length).alias("window")),
    )


def _candidates(rows: DataFrame, sizes: list[int], hashes: list[int] | None) -> DataFrame:
    """A row per position to verify, and one with null for every document, so none is lost."""
    found = [_found(size, hashes) for size in sizes]
    none = F.array(F.lit(None).cast("struct<at: int, size: int, window: array<string>>"))
    hits = reduce(F.concat, found, none)
    return rows.select("_row", "doc_id", F.size("w").cast("long").alias("n_words"), F.explode(hits).alias("hit")).select(
        "_row", "doc_id", "n_words", "hit.*"
    )


def hits(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, max_set: int = MAX_SET, row: str | None = None
) -> DataFrame:
    """``_row, doc_id, n_words, at, size, items``: the verified windows of each document.

    Every document also has one row with null ``at``.  ``row`` names a column
    that numbers the rows; without it they are numbered here.
    """
    known = settle(benchmark_windows(items, window), "benchmark-windows")
    sizes = [r["size"] for r in known.select("size").distinct().orderBy("size").limit(window).collect()]
    small = known.limit(max_set + 1).count() <= max_set
    hashes = [r["probe"] for r in known.select("probe").distinct().limit(max_set).collect()] if small else None
    rows = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("_row"), F.col("doc_id"), words(whole_text()).alias("w")
    )
    found = _candidates(rows, sizes, hashes)
    side = known.select("size", "window", "items")
    return found.join(F.broadcast(side) if small else side, ["size", "window"], "left").select(
        "_row", "doc_id", "n_words", "at", "size", "items"
    )


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``_row, doc_id, n_words, n_hit, items, spans``: hit words, items, and the windows that occur."""
    found = hits(docs, items, **options)
    real = F.col("items").isNotNull()
    spans = F.collect_list(F.when(real, F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"))))
    grouped = found.groupBy("_row", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(spans).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(real, F.col("items")))))).alias("items"),
    )
    # Sorted windows: each adds the words right of what is covered so far.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("hit"),
            F.greatest(acc["end"], s["end"]).alias("end"),
        ),
    )
    return grouped.withColumn("n_hit", covered["hit"].cast("long"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a hit word, with all their columns.

    The test runs inside each row where the set of windows is small, so texts
    do not move; the numbers of hit rows, not the texts, are what is joined.
    Rows are numbered once, in a staged table, as two readings of an input may
    number them differently.
    """
    name = fresh(docs, "_row")
    numbered = settle(docs.withColumn(name, F.monotonically_increasing_id()), "decontaminate-rows")
    hit = contamination(numbered, items, row=name, **options).filter("n_hit > 0").select(F.col("_row").alias(name))
    return numbered.join(hit, name, "left_anti").select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, s)),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""
