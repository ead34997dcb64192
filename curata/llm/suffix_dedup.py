"""Remove long byte strings that already stood earlier, with a family of suffix arrays.

A *window* is ``length`` bytes of one text.  It is a repeat when the same bytes
start earlier: in a document with a smaller doc_id, or in the same document
further left.  Every byte of a repeat is removed; windows are judged on the
input, not on what is left of it.

**Sparse suffixes.**  Of the suffixes in a window, the one whose first
``SEED`` bytes have the smallest fingerprint is its anchor.  Equal windows have
their anchor at the same place, so only suffixes at anchors (one in about 35)
enter an array.  A suffix is filed under the fingerprint of its first bytes,
then under that of its *reach*: the stretch that all windows with this anchor
cover.  The order is by fingerprint, not by byte, which is enough to bring
equal strings together.

**Index family.**  Suffixes are dealt by their first bytes over the shuffle
partitions; each partition is one shard of the index.  Documents come in
batches of rising doc_id.  A batch is sorted into a suffix array, scanned in
one merge with every level, and pushed as a new level; two levels of one rank
merge into the next, so a suffix is rewritten a logarithmic number of times.

**Exactness.**  An anchor whose reach already occurred is a repeat in all its
windows.  An anchor that shares only its first bytes may be one in some
windows; those windows are fingerprinted one by one and compared in a second
shuffle.  Fingerprints have 64 bits (anchors: two of them).

**Hot strings.**  Each task first compares what it has read itself, and sends
one row per reach, at most two per fingerprint of first bytes, and one per
window.  So a string in a third of all rows reaches a shard once per task.

Nulls: a null text is empty, a null doc_id is smaller than any other.  Equal
rows share one result; rows that repeat a doc_id with another text are told
apart by checksum and ordered by it.  An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import U64, Rolling, blocks, longs, record, sliding_min
from curata.llm.tables import NULL_IDS, fresh, identified, keys, packed, settle, unpacked

LENGTH = 100
SEED = 32
BATCHES = 8
BUFFER = 1 << 19
PIECE = 1 << 14

REPEAT, PARTLY, ASK, TELL = 0, 1, 2, 3

_FOUND = pa.schema([(n, pa.int64()) for n in ("seed", "reach", "doc", "at", "n")])
_FOUND_SQL = "seed long, reach long, doc long, at long, n long"
_POSITION = U64((1 << 28) - 1)


def anchors(data: np.ndarray, ends: np.ndarray, length: int, seed: int):
    """First window, number of windows, fingerprint of first bytes and of the reach, per anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.view(U64), none.view(U64)
    rolling = Rolling(data)
    first = rolling.every(seed)
    ranked = (first & ~_POSITION) | np.arange(len(first), dtype=U64)
    lowest = sliding_min(ranked, length - seed + 1)
    change = np.zeros(len(data) + 2, np.int32)
    np.add.at(change, ends[:-1], 1)
    np.add.at(change, np.maximum(ends[:-1], ends[1:] - length + 1), -1)
    p = np.flatnonzero(np.cumsum(change)[: len(lowest)] > 0)
    if not len(p):
        return none, none, none.view(U64), none.view(U64)
    chosen = (lowest[p] & _POSITION).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (p[1:] != p[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(p)) - 1
    return p[head], tail - head + 1, first[chosen[head]], rolling.of(p[head], p[tail] + length)


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def copies(new_key: np.ndarray, new_place: np.ndarray) -> np.ndarray:
    """Rows, sorted by key and place, that are at another place than the first of their key."""
    if not len(new_key):
        return new_key
    head = np.flatnonzero(new_key)
    group = np.cumsum(new_key) - 1
    later = np.cumsum(new_place)
    return later > later[head][group]


def joined_runs(doc, at, n):
    """Merge runs of windows that touch, within a document."""
    order = np.lexsort((at, doc))
    doc, at, n = doc[order], at[order], n[order]
    if not len(doc):
        return doc, at, n
    new = np.ones(len(doc), bool)
    # Runs of one document do not nest, except as equal rows.
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + n[:-1])
    head = np.flatnonzero(new)
    reach = np.maximum.reduceat(at + n, head)
    return doc[head], at[head], reach - at[head]


def _kinds(n, kind):
    return n * 4 + kind


def _batch(seed, reach, doc, at, n):
    return record(_FOUND, longs(seed), longs(reach), longs(doc), longs(at), longs(n))


def _pieces(run):
    """``run`` with its results in small batches: each is held whole by Python and, outside the heap, by the JVM."""

    def small(batches):
        for out in run(batches):
            for first in range(0, out.num_rows, PIECE):
                yield out.slice(first, PIECE)

    return small


def _repeats(doc, at, n):
    doc, at, n = joined_runs(doc, at, n)
    zero = np.zeros(len(doc), np.int64)
    return _batch(doc * 31 + at, zero, doc, at, _kinds(n, REPEAT))


def _scan(length: int, seed: int):
    """Text to suffix rows; what one task can settle alone is settled here."""

    def flush(parts):
        key, reach, doc, at, n = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((at, doc, reach, key))
        key, reach, doc, at, n = key[order], reach[order], doc[order], at[order], n[order]
        new_key, new_pair = changes(key), changes(key, reach)
        place = changes(key, reach, doc, at)
        again = copies(new_pair, place)
        yield _repeats(doc[again], at[again], n[again])
        head = new_pair
        key, reach, doc, at, n, new_key = (c[head] for c in (key, reach, doc, at, n, new_key))
        group = np.cumsum(new_key) - 1
        size = np.bincount(group, minlength=1)
        many = size[group] > 1 if len(group) else np.zeros(0, bool)
        rank = np.arange(len(key)) - np.flatnonzero(new_key)[group] if len(key) else np.zeros(0, np.int64)
        zero = np.zeros(int(many.sum()), np.int64)
        yield _batch(doc[many], zero, doc[many], at[many], _kinds(n[many], PARTLY))
        sent = ~many | (rank < 2)
        kind = np.where(many[sent], TELL, ASK)
        yield _batch(key[sent], reach[sent], doc[sent], at[sent], _kinds(n[sent], kind))

    def run(batches):
        parts, held = [], 0
        for block in blocks(batches):
            start, n, key, reach = anchors(block.data, block.ends, length, seed)
            text = np.searchsorted(block.ends, start, "right") - 1
            doc = np.asarray(block.rows.column("_doc"))[text]
            tag = np.asarray(block.rows.column("_tag"))[text]
            parts.append((key, reach, doc, (tag << 32) | (start - block.ends[text]), n))
            held += len(start)
            if held >= BUFFER:
                yield from flush(parts)
                parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


class IndexFamily:
    """Levels of suffix arrays; ``add`` scans a batch against all of them and stores it."""

    def __init__(self):
        self.levels: list[tuple[int, tuple]] = []

    def add(self, key, reach, doc, at, n):
        """The mask of rows that repeat an earlier reach; rows must be sorted by all columns."""
        again = copies(changes(key, reach), changes(key, reach, doc, at))
        fresh = changes(key, reach)
        for _, level in self.levels:
            known = self._known(level, key, reach)
            again |= known
            fresh &= ~known
        self._push(tuple(c[fresh] for c in (key, reach, doc, at, n)))
        return again

    @staticmethod
    def _known(level, key, reach):
        """One merge of two sorted arrays: which (key, reach) stand in the level."""
        old = len(level[0])
        both_key, both_reach = np.concatenate([level[0], key]), np.concatenate([level[1], reach])
        side = np.concatenate([np.zeros(old, np.int8), np.ones(len(key), np.int8)])
        order = np.lexsort((side, both_reach, both_key))
        new = changes(both_key[order], both_reach[order])
        from_level = side[order] == 0
        head = np.flatnonzero(new)
        known = np.zeros(len(order), bool)
        known[order] = from_level[head][np.cumsum(new) - 1] if len(head) else False
        return known[old:]

    def _push(self, level):
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, other = self.levels.pop()
            level = tuple(np.concatenate(c) for c in zip(other, level))
            order = np.lexsort((level[1], level[0]))
            level = tuple(c[order] for c in level)
            rank += 1
        self.levels.append((rank, level))

    def shared(self):
        """The suffixes whose first bytes occur with more than one reach."""
        if not self.levels:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        level = tuple(np.concatenate(c) for c in zip(*(x for _, x in self.levels)))
        order = np.argsort(level[0], kind="stable")
        level = tuple(c[order] for c in level)
        group = np.cumsum(changes(level[0])) - 1
        many = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        return tuple(c[many] for c in level)


def _index(batches):
    """One shard: batches of rising doc_id through the index family."""
    family, parts, current = IndexFamily(), [], None

    def close():
        key, reach, doc, at, n = (np.concatenate(c) for c in zip(*parts))
        again = family.add(key, reach, doc, at, n) & (n % 4 == ASK)
        return _repeats(doc[again], at[again], n[again] // 4)

    for rows in batches:
        number = np.asarray(rows.column("batch"))
        columns = [np.asarray(rows.column(c)) for c in ("seed", "reach", "doc", "at", "n")]
        kind = columns[4] % 4
        settled = (kind == REPEAT) | (kind == PARTLY)
        yield _batch(*(c[settled] for c in columns))
        for b in np.unique(number[~settled]):
            if current is not None and b != current and parts:
                yield close()
                parts = []
            current = b
            pick = ~settled & (number == b)
            parts.append(tuple(c[pick] for c in columns))
    if parts:
        yield close()
    _, _, doc, at, n = family.shared()
    ask = n % 4 == ASK
    zero = np.zeros(int(ask.sum()), np.int64)
    yield _batch(zero, zero, doc[ask], at[ask], _kinds(n[ask] // 4, PARTLY))


def _windows(length: int):
    """Fingerprints of the windows in question; repeats within a task are settled here."""

    def flush(parts):
        key, doc, at = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((at, doc, key))
        key, doc, at = key[order], doc[order], at[order]
        new = changes(key)
        again = copies(new, changes(key, doc, at))
        yield _repeats(doc[again], at[again], np.ones(int(again.sum()), np.int64))
        zero, one = np.zeros(int(new.sum()), np.int64), np.ones(int(new.sum()), np.int64)
        yield _batch(key[new], zero, doc[new], at[new], _kinds(one, ASK))

    def run(batches):
        parts, held = [], 0
        for block in blocks(unpacked(batches)):
            rolling = Rolling(block.data)
            runs = block.rows.column("runs")
            size = np.diff(np.asarray(runs.offsets))
            flat = runs.flatten()
            text = np.repeat(np.arange(len(size)), size)
            start, n = np.asarray(flat.field("start")), np.asarray(flat.field("n"))
            text, base, step = np.repeat(text, n), np.repeat(start, n), np.arange(n.sum())
            p = base + step - np.repeat(np.cumsum(n) - n, n)
            absolute = p + block.ends[text]
            tag = np.asarray(block.rows.column("_tag"))[text]
            doc = np.asarray(block.rows.column("_doc"))[text]
            parts.append((rolling.of(absolute, absolute + length), doc, (tag << 32) | p))
            held += len(p)
            if held >= 2 * BUFFER:
                yield from flush(parts)
                parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _compare(batches):
    """A shard of windows: all but the first place of each are repeats."""
    parts = []
    for rows in batches:
        columns = [np.asarray(rows.column(c)) for c in ("seed", "doc", "at", "n")]
        ask = columns[3] % 4 == ASK
        settled = [c[~ask] for c in columns]
        yield _batch(settled[0], np.zeros(len(settled[0]), np.int64), *settled[1:])
        parts.append([c[ask] for c in columns[:3]])
    if parts:
        key, doc, at = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((at, doc, key))
        key, doc, at = key[order], doc[order], at[order]
        again = copies(changes(key), changes(key, doc, at))
        yield _repeats(doc[again], at[again], np.ones(int(again.sum()), np.int64))


def _by_document(found: DataFrame) -> DataFrame:
    """``_doc, _tag, runs``: the runs of windows of each document."""
    return found.groupBy(
        F.col("doc").alias("_doc"), F.shiftright("at", 32).alias("_tag")
    ).agg(
        F.collect_list(
            F.struct(
                F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("start"),
                F.shiftright("n", 2).alias("n"),
            )
        ).alias("runs")
    )


def repeated_windows(docs: DataFrame, length: int = LENGTH, seed: int = SEED, batches: int = BATCHES) -> DataFrame:
    """``_doc, _tag, runs``: windows that start earlier elsewhere, as runs of start positions."""
    rows = identified(docs)
    found = rows.mapInArrow(_pieces(_scan(length, seed)), _FOUND_SQL)
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = max(1, ((hi or 0) - (lo or 0)) // batches + 1)
    number = F.when(F.col("doc") < F.lit(lo or 0), F.lit(0)).otherwise(
        F.floor((F.col("doc") - F.lit(lo or 0)) / F.lit(width)) + 1
    )
    dealt = found.repartition("seed").withColumn("batch", number.cast("long"))
    indexed = settle(
        dealt.sortWithinPartitions("batch", "seed", "reach", "doc", "at").mapInArrow(_pieces(_index), _FOUND_SQL),
        "suffix-runs",
    )
    partly = _by_document(indexed.filter(F.col("n") % 4 == PARTLY))
    asked = partly.join(packed(docs), ["_doc", "_tag"]).select("_doc", "_tag", "runs", "packed")
    windows = asked.mapInArrow(_pieces(_windows(length)), _FOUND_SQL).repartition("seed")
    windows = windows.mapInArrow(_pieces(_compare), _FOUND_SQL)
    settled = settle(windows, "suffix-windows")
    return _by_document(indexed.filter(F.col("n") % 4 == REPEAT).unionByName(settled))


def _removed(spans: list[tuple[int, int]], raw: bytes):
    kept, last = [], 0
    for a, b in spans:
        kept.append(raw[last:a])
        last = b
    kept.append(raw[last:])
    return b"".join(kept)


def merged_spans(runs, length: int) -> list[tuple[int, int]]:
    """Runs of window starts to maximal byte spans, left to right."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["start"] + r["n"] - 1 + length) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``_doc, _tag, n_bytes, spans, kept`` per row: removed byte spans and the bytes that stay."""
    runs = repeated_windows(docs, length, **options)
    schema = pa.schema(
        [
            ("_doc", pa.int64()), ("_tag", pa.int64()), ("n_bytes", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()),
        ]
    )

    def cut(batches):
        for batch in unpacked(batches):
            texts = batch.column("text").to_pylist()
            spans = [merged_spans(r, length) for r in batch.column("runs").to_pylist()]
            yield record(
                schema,
                batch.column("_doc"),
                batch.column("_tag"),
                [len(t) for t in texts],
                [[{"start": a, "end": b} for a, b in s] for s in spans],
                [_removed(s, t) for s, t in zip(spans, texts)],
            )

    joined = packed(docs).join(runs, ["_doc", "_tag"], "left").select("_doc", "_tag", "runs", "packed")
    return joined.mapInArrow(
        cut, "_doc long, _tag long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with repeats cut out of ``text`` and ``n_chars`` (if there) counted anew.

    A character that lost only some of its bytes goes.  A text without repeats
    stays as it is, null included.  All rows and columns stay.
    """
    runs = repeated_windows(docs, length, **options)
    names, (doc, tag) = docs.columns, keys()
    own = [fresh(docs, n) for n in ("_doc", "_tag", "_runs")]
    runs = runs.toDF(*own)
    joined = docs.withColumns({own[0]: doc, own[1]: tag}).join(runs, own[:2], "left").select(*names, own[2])

    def cut(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column("text").to_pylist()
            for i, found in enumerate(batch.column(own[2]).to_pylist()):
                if found:
                    kept = _removed(merged_spans(found, length), texts[i].encode())
                    texts[i] = kept.decode("utf-8", "ignore")
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield out.select(names)

    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    out = joined.mapInArrow(cut, kinds)
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return out


def digest(removed: DataFrame) -> DataFrame:
    """The registered form of ``remove_repeats``: counts and a checksum."""
    return removed.select(
        F.when(F.col("_doc") >= NULL_IDS, F.col("_doc")).alias("doc_id"),
        "n_bytes",
        F.coalesce(
            F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]), F.lit(0)
        ).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(docs: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, tuple]:
    """The rule in words, for tests: (n_bytes, n_removed, n_spans, kept checksum) by doc_id."""
    seen, out = set(), {}
    for doc, raw in sorted(docs):
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            window = raw[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = bytes(gone).count(b"\0\1") + (gone[:1] == b"\1")
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
