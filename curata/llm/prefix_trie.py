"""The trie of conversation prefixes, from sorted conversations and their common prefixes.

Every turn becomes a 128-bit hash of its role and text, and every conversation
the sequence of its hashes.  Sequences are sorted; neighbours share a longest
common prefix (LCP) of some turns.  A sparse table over the LCPs answers
range minima, and each candidate prefix (a row and a depth beyond the row's
LCP) finds its members by two independent binary searches, to the left and to
the right, while the minimum stays at its depth or over it.  Numbers of
members, leaves and shared code points are then differences of running sums.

How this is spread out:

* A sequence is cut into segments of ``SEGMENT`` turns.  Segments sort by
  (number, hash of all turns before, their own turns, conversation), so a row
  is of bounded size and one endless conversation is many rows.  What stands
  below the end of a segment counts in the segments above it, at the smallest
  conversation that has it.
* Sorted rows are dealt into ranges of about ``RANGE`` rows, cut at sampled
  rows, so a prefix that a third of all rows share lies in many tasks.  A
  range knows the first row of the next one (it is the cut) and with it the
  LCP across the border.  Prefixes that may go on beyond a border, at most
  ``SEGMENT + 1`` at each end, leave one partial row a range; these are added
  up by prefix.
* The ids that end at a prefix are joined inside each range and hashed piece by
  piece in their order; no task holds all ids of a prefix.  The last hash of
  a prefix is one task's work, for SHA-256 goes from start to end.

Rules.  Turns sort by turn (null first), then by a hash of role and text; equal rows are
turns of their own.  Rows without conv_id belong to no conversation and are
left out.  Null role or text is empty.  A very long text counts by its code
points and is hashed once.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curata.llm.kernels import record
from curata.llm.tables import settle
from curata.operators.ordered import attach_by_key, carry, running_total
from curata.session import spread

SEGMENT, RANGE, SAMPLES = 32, 50_000, 40
#: Turns at the head of every hundredth conversation that others may start with: fewer than this.
HEADS = 6
#: Rows of a table that may be broadcast.
SMALL = 100_000
#: Bytes of a key before its turns: number of the segment, hash of the turns before.
HEAD, TURN = 28, 17
ENDS, GOES_ON = 0, 2


def _be(c: Column) -> Column:
    """A long as 8 bytes that sort as the numbers do."""
    return F.unhex(F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def _byte(n: int) -> Column:
    return F.unhex(F.lit(f"{n:02x}"))


def cuts(keyed: DataFrame, rows: int) -> list[bytes]:
    """Keys between ranges of about ``RANGE`` rows.  Only the balance depends on the sample."""
    ranges = rows // RANGE + 1
    if ranges == 1:
        return []
    sample = keyed.select("key").sample(min(1.0, ranges * SAMPLES / rows), seed=1)
    found = sorted({bytes(r.key) for r in sample.collect()})
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def dealt(keyed: DataFrame, splits: list[bytes]) -> DataFrame:
    """Add ``part``: how many cuts are at or before the row's ``key``."""
    if not splits:
        return keyed.withColumn("part", F.lit(0))

    def run(batches):
        for batch in batches:
            parts = [bisect.bisect_right(splits, k) for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32())], [*batch.schema.names, "part"])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in keyed.dtypes)
    return keyed.mapInArrow(run, f"{fields}, part int")


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv, pos, hash, points``: each turn's place from 1, its hash and code points, staged."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.col("turn").cast("long")
    conv = F.col("conv_id").cast("long")
    spelled = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = (
        conversations.filter("conv_id IS NOT NULL")
        .select(conv.alias("conv"), turn.alias("turn"), F.md5(spelled.cast("binary")).alias("hash"), F.length(text).cast("long").alias("points"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    place = F.when(F.col("turn").isNull(), _byte(0)).otherwise(F.concat(_byte(1), _be(F.col("turn"))))
    rows = rows.withColumn("key", F.concat(_be(F.col("conv")), place, F.unhex("hash"), _be(F.col("row"))))
    rows = settle(rows.select("conv", "hash", "points", "key"), "trie-turns")
    rows = dealt(rows, cuts(rows, rows.count()))
    pieces = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("own"))
    before = carry(pieces, ["conv"], "part", F.sum("own"), "before").drop("own")
    local = F.row_number().over(W.partitionBy("conv", "part").orderBy("key"))
    placed = attach_by_key(rows.withColumn("local", local), before, ["conv", "part"])
    return settle(placed.select("conv", (F.coalesce("before", F.lit(0)) + F.col("local")).alias("pos"), "hash", "points"), "trie-places")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``conv, pos, hash, points`` and all conversations ``conv, length``.

    Conversation c starts with the first h turns of c - c % 100 and goes on
    with its own after h; h is crc32 of c's digits, modulo 6.
    """
    convs = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    convs = convs.select(
        "conv", "own",
        (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h"),
        (F.col("conv") - F.col("conv") % 100).alias("base"),
    )
    bases = convs.filter("conv % 100 = 0").select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = settle(convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-convs")
    heads = turns.filter(f"conv % 100 = 0 AND pos < {HEADS}").withColumnRenamed("conv", "base")
    taken = convs.filter("taken > 0").select("base", "conv", "taken").join(heads, "base").filter("pos <= taken")
    rest = turns.join(convs.select("conv", "h", "taken"), "conv").filter("pos > h")
    rest = rest.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv", "pos", "hash", "points"]
    return taken.select(columns).unionByName(rest.select(columns)), convs.select("conv", "length")


def segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a segment: ``conv, s, key, points, after`` (hash of all turns up to its end), staged."""
    number = F.floor((F.col("pos") - 1) / SEGMENT).cast("int")
    rows = turns.groupBy("conv", number.alias("s")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "points"))).alias("turns"))
    joined = convs.join(rows, "conv", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    joined = joined.select(
        "conv", "s", "length",
        F.coalesce(F.array_join(F.transform("turns", lambda t: F.concat(F.lit("01"), t["hash"])), ""), F.lit("")).alias("turns"),
        F.coalesce(F.col("turns.points"), F.array().cast("array<long>")).alias("points"),
    )
    # Three sums of 40 bits identify what stands before a segment; only conversations with a full one need them.
    digest = F.md5(F.concat(F.col("s").cast("string"), F.lit(":"), F.col("turns")).cast("binary"))
    for k in range(3):
        own = F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("long")
        joined = joined.withColumn(f"own{k}", F.when(F.col("length") >= SEGMENT, own).otherwise(F.lit(0)))
    joined = settle(joined, "trie-pieces")
    long = joined.filter(F.col("length") > SEGMENT)
    for k in range(3):
        long = running_total(long, ["conv"], "s", f"own{k}", f"sum{k}", 4096)
    short = joined.filter(F.col("length") <= SEGMENT).select("*", *[F.col(f"own{k}").alias(f"sum{k}") for k in range(3)])
    rows = short.unionByName(long.select(short.columns))
    before = F.concat(*[_be(F.col(f"sum{k}") - F.col(f"own{k}")) for k in range(3)])
    after = F.concat(*[_be(F.col(f"sum{k}")) for k in range(3)])
    last = F.col("length") <= (F.col("s") + 1) * SEGMENT
    key = F.concat(
        F.unhex(F.lpad(F.hex(F.col("s")), 8, "0")), before, F.unhex("turns"),
        F.when(last, _byte(ENDS)).otherwise(_byte(GOES_ON)), _be(F.col("conv")),
    )
    return settle(rows.select("conv", "s", key.alias("key"), "points", after.alias("after")), "trie-segments")


class Sparse:
    """Minima of any stretch of an array, from those of all stretches of 2**k."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            width = 1 << (len(self.levels) - 1)
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-width], below[width:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum over [low, high], element by element."""
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for level in np.unique(k):
            at = k == level
            table = self.levels[level]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(level)) + 1])
        return out

    def right(self, at: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """The furthest r such that every value in (at, r] is at least the bar: a binary search each."""
        end, out = len(self.levels[0]) - 1, at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            width, table = 1 << k, self.levels[k]
            fits = out + width <= end
            start = np.where(fits, out + 1, 0)
            out = np.where(fits & (table[start] >= bar), out + width, out)
        return out

    def left(self, at: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """The furthest l such that every value in (l, at] is at least the bar."""
        out = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            width, table = 1 << k, self.levels[k]
            fits = out - width >= 0
            start = np.where(fits, out - width + 1, 0)
            out = np.where(fits & (table[start] >= bar), out - width, out)
        return out


class Range:
    """The sorted segments of one range and, where there is one, the first key of the next."""

    def __init__(self, keys, points, convs, after, heavy, following: bytes | None, segment: int = SEGMENT):
        self.n, self.after, self.convs, self.keys = len(keys), after, np.array(convs, np.int64), keys
        self.segment = segment
        every = keys if following is None else [*keys, following]
        sizes = np.array([(len(k) - HEAD - 9) // TURN for k in every], np.int64)
        self.sizes, self.deepest = sizes[: self.n], int(sizes.max(initial=0))
        self.ends = np.array([k[-9] == ENDS for k in keys], bool)
        width = HEAD + TURN * self.deepest
        flat = b"".join(k[: HEAD + TURN * m].ljust(width, b"\0") for k, m in zip(every, sizes.tolist()))
        table = np.frombuffer(flat, np.uint8).reshape(len(every), width)
        self.lcp = np.full(len(every) + 1, -1, np.int64)
        if len(every) > 1:
            alike = (table[1:, :HEAD] == table[:-1, :HEAD]).all(1)
            turns = table[:, HEAD:].reshape(len(every), self.deepest, TURN)
            apart = np.ones((len(every) - 1, self.deepest + 1), bool)
            apart[:, : self.deepest] = (turns[1:] != turns[:-1]).any(2)
            shared = np.minimum(apart.argmax(1), np.minimum(sizes[1:], sizes[:-1]))
            self.lcp[1 : len(every)] = np.where(alike, shared, -1)
        #: LCP with the first row of the next range; -1 where there is none or it belongs elsewhere.
        self.border = int(self.lcp[self.n]) if following is not None else -1
        self.sums = np.zeros((self.n, self.deepest + 1), np.int64)
        for i, own in enumerate(points):
            self.sums[i, 1 : len(own) + 1] = own
        np.cumsum(self.sums, axis=1, out=self.sums)
        link = self.lcp[: self.n]
        shared = self.sums[np.arange(self.n), np.maximum(link, 0)]
        last = self.ends & (self.lcp[1 : self.n + 1] < self.sizes)
        leaves, saved = heavy
        self.links = np.concatenate([[0], np.cumsum(shared)])
        self.leaves = np.concatenate([[0], np.cumsum(last + leaves)])
        self.extra = np.concatenate([[0], np.cumsum(saved)])

    def numbers(self) -> np.ndarray:
        """The number of each row's segment."""
        return np.array([int.from_bytes(k[:4], "big") for k in self.keys], np.int64)

    def nodes(self) -> dict[str, np.ndarray]:
        """All prefixes of this range: row, depth, extent and what is known of them here."""
        first = self.lcp[: self.n] + 1
        count = self.sizes - first + 1
        row = np.repeat(np.arange(self.n), count)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        table = Sparse(self.lcp[: self.n])
        low, high = table.left(row, depth), table.right(row, depth)
        below = self.sums[row, np.maximum(depth - 1, 0)]
        saved = self.links[high + 1] - self.links[low + 1] - (high - low) * below + self.extra[high + 1] - self.extra[low]
        order = np.lexsort((row, depth))
        code = depth[order] * (self.n + 1) + row[order]

        def rows_at(level, until, side):
            return np.searchsorted(code, level * (self.n + 1) + until, side)

        children = rows_at(depth + 1, high, "right") - rows_at(depth + 1, low, "left")
        crossing = (high == self.n - 1) & (depth <= self.border)
        if self.border >= 0:
            saved = saved + np.where(crossing, self.sums[self.n - 1, self.border] - below, 0)
            # The next range counts the child that crosses the border once more.
            children = children - (crossing & (depth < self.border))
        parent = order[np.maximum(rows_at(depth - 1, row, "right") - 1, 0)]
        return {
            "row": row, "depth": depth, "low": low, "high": high, "saved": saved, "children": children,
            "leaves": self.leaves[high + 1] - self.leaves[low], "crossing": crossing, "parent": parent,
            "conv": Sparse(self.convs).least(low, high), "n": high - low + 1,
        }

    def id(self, row: int, depth: int) -> bytes:
        """A prefix by its content: the hash up to its segment's start and that of its turns in it."""
        if depth == self.segment:
            return self.after[row] + bytes(16)
        own = self.keys[row][HEAD : HEAD + TURN * depth]
        return self.keys[row][4:HEAD] + (hashlib.md5(own).digest() if depth else bytes(16))


PARTIAL = (
    "id binary, depth long, part int, open boolean, conv long, n long, children long, leaves long, saved long, "
    "ends binary, sha string, parent_conv long, parent_id binary"
)


def _arrow(fields: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def _ranges(batches, splits, segment):
    """The rows of a partition, which is one range, as a ``Range`` and its number."""
    found = {name: [] for name in ("key", "points", "conv", "after", "heavy_leaves", "heavy_saved")}
    part = None
    for batch in batches:
        for name, values in found.items():
            values.extend(batch.column(name).to_pylist())
        if part is None and batch.num_rows:
            part = batch.column("part")[0].as_py()
    if part is not None:
        heavy = np.array(found["heavy_leaves"], np.int64), np.array(found["heavy_saved"], np.int64)
        following = splits[part] if part < len(splits) else None
        yield part, Range(found["key"], found["points"], found["conv"], found["after"], heavy, following, segment)


def _sorted(rows: DataFrame, splits: list[bytes]) -> DataFrame:
    return dealt(rows, splits).repartitionById(len(splits) + 1, F.col("part")).sortWithinPartitions("key")


def _weighted(rows: DataFrame, splits: list[bytes]) -> DataFrame:
    """Add what lies below later segments: leaves and code points, at the smallest conversation of each prefix."""
    schema = "s int, before binary, conv long, leaves long, saved long"

    def run(batches):
        for _, found in _ranges(batches, splits, SEGMENT):
            made, numbers = found.nodes(), found.numbers()
            at = np.flatnonzero((made["depth"] == 0) & (numbers[made["row"]] > 0))
            yield record(
                _arrow(schema), numbers[made["row"][at]].astype(np.int32), [found.keys[r][4:HEAD] for r in made["row"][at]],
                made["conv"][at], made["leaves"][at], made["saved"][at],
            )

    plain = rows.select("*", F.lit(0).cast("long").alias("heavy_leaves"), F.lit(0).cast("long").alias("heavy_saved"))
    sums = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    below = _sorted(plain, splits).mapInArrow(run, schema).groupBy("s", "before").agg(F.min("conv").alias("conv"), *sums)
    below = below.groupBy("conv", "s").agg(*sums)
    long = rows.select("conv", "s").join(rows.filter("s > 0").select("conv").distinct(), "conv", "left_semi")
    long = long.join(below, ["conv", "s"], "left").na.fill(0, ["leaves", "saved"]).withColumn("back", -F.col("s"))
    for c in ("leaves", "saved"):
        long = running_total(long, ["conv"], "back", c, f"heavy_{c}", 4096).withColumn(f"heavy_{c}", F.col(f"heavy_{c}") - F.col(c))
    long = long.select("conv", "s", "heavy_leaves", "heavy_saved")
    return settle(rows.join(long, ["conv", "s"], "left").na.fill(0, ["heavy_leaves", "heavy_saved"]), "trie-weights")


def _partials(rows: DataFrame, splits: list[bytes]) -> DataFrame:
    """A row for each prefix of each range; those not ``open`` are whole."""

    def run(batches):
        for part, found in _ranges(batches, splits, SEGMENT):
            made, numbers = found.nodes(), found.numbers()
            row, depth = made["row"], made["depth"]
            number = numbers[row]
            copy = (depth == 0) & (number > 0)
            goes_on = (depth == SEGMENT) & ~found.ends[made["high"]]
            opened = made["crossing"] | ((made["low"] == 0) & (part > 0)) | copy | goes_on
            parent, top = made["parent"], depth == 0
            # Rows of one sequence stand together; those that end here are the first of a prefix.
            alike = np.concatenate([(found.lcp[1 : found.n] == found.sizes[1:]) & (found.sizes[1:] == found.sizes[:-1]) & found.ends[1:], [False]])
            stop = np.flatnonzero(~alike)
            ids = [str(c).encode() for c in found.convs.tolist()]
            at_end = (found.sizes[row] == depth) & found.ends[row] & ~copy
            until = stop[np.searchsorted(stop, row)]
            out = {name: [] for name in ("id", "ends", "sha", "parent_conv", "parent_id")}
            for k in range(len(row)):
                ends = b",".join(ids[row[k] : until[k] + 1]) if at_end[k] else b""
                out["id"].append(found.id(row[k], depth[k]) if opened[k] else None)
                out["ends"].append(ends if opened[k] else None)
                out["sha"].append(None if opened[k] else hashlib.sha256(ends).hexdigest())
                known = not top[k] and not opened[parent[k]]
                out["parent_conv"].append(int(made["conv"][parent[k]]) if known else None)
                out["parent_id"].append(None if known or top[k] else found.id(row[k], depth[k] - 1))
            whole = ~copy
            yield record(
                _arrow(PARTIAL), out["id"], number * SEGMENT + depth, np.full(len(row), part, np.int32), opened,
                pa.array(made["conv"], mask=copy), made["n"] * whole, made["children"], made["leaves"] * whole,
                made["saved"] * whole, out["ends"], out["sha"], out["parent_conv"], out["parent_id"],
            )

    return settle(_sorted(rows, splits).mapInArrow(run, PARTIAL), "trie-partials")


NODE = (
    "id binary, depth long, conv long, n long, children long, leaves long, saved long, sha string, "
    "parent_conv long, parent_id binary"
)


def _merged(partials: DataFrame) -> DataFrame:
    """One row for each prefix that lies in several ranges or segments; pieces stream by in order."""

    def run(batches):
        now, sums, ends = None, None, None

        def made():
            depth, conv, parent_conv, parent_id = now[1], now[2], now[3], now[4]
            return [now[0], depth, conv, *sums, ends.hexdigest(), parent_conv, parent_id]

        done = []
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now[0] != row["id"]:
                    if now is not None:
                        done.append(made())
                    now, sums, ends, begun = [row["id"], row["depth"], None, None, None], [0, 0, 0, 0], hashlib.sha256(), False
                for k, name in enumerate(("n", "children", "leaves", "saved")):
                    sums[k] += row[name]
                for k, name in ((2, "conv"), (3, "parent_conv")):
                    now[k] = min((x for x in (now[k], row[name]) if x is not None), default=None)
                now[4] = now[4] or row["parent_id"]
                if row["ends"]:
                    ends.update(b"," + row["ends"] if begun else row["ends"])
                    begun = True
            if len(done) > 1000:
                yield record(_arrow(NODE), *zip(*done))
                done = []
        if now is not None:
            done.append(made())
        if done:
            yield record(_arrow(NODE), *zip(*done))

    rows = partials.filter("open").drop("open", "sha")
    rows = rows.repartition("id").sortWithinPartitions("id", "part", F.col("conv").isNull())
    return settle(rows.mapInArrow(run, NODE), "trie-merged")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a prefix: ``conv, depth, parent_conv, n, children, leaves, saved, sha``."""
    turns, convs = rebuilt(numbered(spread(conversations)))
    rows = segments(turns, convs)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("s"), F.lit(0)).alias("s")).first()
    splits = cuts(rows, size.n)
    if size.s:
        rows = _weighted(rows, splits)
    else:
        rows = rows.select("*", F.lit(0).cast("long").alias("heavy_leaves"), F.lit(0).cast("long").alias("heavy_saved"))
    partials = _partials(rows, splits)
    merged = _merged(partials)
    columns = ["conv", "depth", "parent_conv", "n", "children", "leaves", "saved", "sha"]
    closed = partials.filter("NOT open")
    known = closed.filter("parent_id IS NULL").unionByName(merged.filter("parent_id IS NULL"), allowMissingColumns=True)
    asking = closed.filter("parent_id IS NOT NULL").unionByName(merged.filter("parent_id IS NOT NULL"), allowMissingColumns=True)
    parents = merged.select(F.col("id").alias("parent_id"), F.col("conv").alias("above"))
    parents = F.broadcast(parents) if merged.count() <= SMALL else parents
    asked = asking.join(parents, "parent_id", "left").withColumn("parent_conv", F.col("above"))
    return known.select(columns).unionByName(asked.select(columns))


def digest(conversations: DataFrame) -> DataFrame:
    """The nodes under the names of the query."""
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return trie(conversations).toDF(*names)


#: crc32 bit by bit over the digits (the fixed polynomial of zlib), turns as hashes, prefixes as lists.
SQL = """
WITH t AS (SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
    length(coalesce(text, '')) AS cp, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'h': h, 'cp': cp} ORDER BY turn NULLS FIRST, h) AS own FROM t GROUP BY c),
x AS (SELECT c, own, xor(list_reduce(flatten([[4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
    lambda d: [ascii(d), -1, -1, -1, -1, -1, -1, -1, -1]))]),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS k FROM o),
r AS (SELECT x.c, list_concat(coalesce(y.own[1 : x.k], []), x.own[x.k + 1 :]) AS w FROM x LEFT JOIN o y ON y.c = x.c - x.c % 100),
p AS (SELECT c, d, list_transform(w[1 : d], lambda z: z.h) AS key, coalesce(w[d].cp, 0) AS cp, len(w) = d AS ends
  FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM r)),
n AS (SELECT key, d, min(c) AS c, count(*) AS n, max(cp) AS cp, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)
    FILTER (WHERE ends), '') AS e FROM p GROUP BY key, d),
k AS (SELECT key[1 : d - 1] AS key, count(*) AS children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(k.children, 0) AS children FROM n LEFT JOIN k USING (key)),
s AS (SELECT key[1 : a] AS key, count(*) FILTER (WHERE children = 0) AS leaves, sum((n - 1) * cp) AS saved
  FROM (SELECT key, children, n, cp, unnest(range(0, d + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.c AS conv_id, CAST(m.d AS BIGINT) AS depth, CASE WHEN m.d > 0 THEN up.c END AS parent_conv_id,
  CAST(m.n AS BIGINT) AS n_convs, CAST(m.children AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(m.e) AS ends_sha256
FROM m JOIN s USING (key) LEFT JOIN n up ON up.key = m.key[1 : m.d - 1]
"""
