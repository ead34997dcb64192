"""Log probabilities of texts: a small causal attention model over subword ids, mixed with word counts.

**Base.**  Spark counts the words of all training texts (one 64-bit code per
word).  Words that make up at least one part in ``PARTS`` of all tokens are at
most ``PARTS`` by that rule, so their counts are sent to every task; the other
words of a text are joined with the counts by code.

**Model.**  Subword ids of a public tokenizer, one layer of causal
self-attention with ``WIDTH`` numbers per token, trained in numpy inside Spark
tasks on all training texts.  An id is predicted as three digits of base ``DIGIT`` (tiers of falling
frequency; sorted by spelling inside a tier), each given the digits before it,
with the frequencies of the training texts as a starting point.  So the
probabilities of all ids sum to one at a small cost.

The ids are those of the text's lower-cased words, each after one space.  Texts
are encoded once; ids spell out these words again where a text is scored.

**Training.**  Training texts are dealt by a hash of the row to lanes of about
``LANE_BYTES`` of text, so there are more lanes for more text and what a lane
holds does not depend on partitions.  Every window of every text is learned
from once, or several times in small tables, until ``STEPS`` batches are made.
In each of ``ROUNDS`` rounds all lanes start from the same weights and learn
from their next windows; Spark sums what they changed, by ranges of ids, and
the driver applies the mean: over windows, and for the numbers of an id over
the places where the lanes met it.  The driver sees counts of ids and weights,
never texts.  Equal rows share a lane.

**Mixture.**  The probability of a word, given the words before it, is the sum
of three parts: its share among all training tokens (weight ``COUNTED``), its
share among the words of this text so far (weight ``REPEATED``, reached as the
text grows past ``SETTLING`` words), and what the attention model gives for its
ids (the rest).  The parts are fixed weights, so a word that is in no count
still has the probability of its ids.

**Windows.**  A text, with a begin and an end mark, is cut into windows of
``WINDOW`` tokens that overlap by ``OVERLAP``.  A window scores only tokens
right of its overlap (the first one all), so each token is scored once; a mask
hides later tokens.

Nulls: a null text is an empty one (only its end is scored); a null doc_id
counts as an empty text in the split.  Every row gives one row; equal rows too,
and each counts as training text of its own.  Without training rows every
count is 0 and the model is the untrained one.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import U64, Block, Rolling, blocks, longs, lowered, mix, per_text, record, word_bounds
from curata.llm.tables import held_out, settle, whole_text

MODULUS, HELD = 7, 2
PARTS = 1 << 20
WIDTH = 16
WINDOW = 24
OVERLAP = 4
DIGIT = 37
DIGITS = 3
STEPS = 1000
BATCH = 96
ROUNDS = 4
LANE_BYTES = 1 << 22
RANGE = 1024
FLUSH = 1 << 22
COUNTED, REPEATED, SETTLING = 0.6, 0.2, 100


def spaced(raw: bytes) -> str:
    """The lower-cased words, each after one space."""
    return b"".join(b" " + word for word in raw.lower().split()).decode()


def word_codes(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A code for each word, its text number, and its length in bytes."""
    low = lowered(block.data)
    start, end, text = word_bounds(low, block.ends)
    return mix(Rolling(low, 4).of(start, end) + (end - start).astype(U64)), text, end - start


def word_counts(docs: DataFrame) -> DataFrame:
    """``code, c`` over all rows of ``docs``, summed inside tasks first."""
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def run(batches):
        parts, held = [], 0
        for block in blocks(batches):
            code = word_codes(block)[0]
            parts.append(code)
            held += len(code)
            if held >= FLUSH:
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                yield record(schema, longs(code), n)
                parts, held = [], 0
        if parts:
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            yield record(schema, longs(code), n)

    rows = docs.select(whole_text().alias("text"))
    return rows.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("c"))


class Tokens:
    """Subword ids by a rank file, with a begin and an end mark behind the last rank."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.spelled = sorted(ranks, key=ranks.get)
        self.size = len(ranks)
        self.begin, self.end = self.size, self.size + 1
        # The end mark fills one byte behind the last word, the begin mark none.
        self.lengths = np.array([*map(len, self.spelled), 0, 1])
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode = lambda text: encoding.encode_to_numpy(text, disallowed_special=())

    def sequences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Begin mark, ids and end mark of each text, end to end, and their ends."""
        parts, ends = [], [0]
        for text in texts:
            ids = self.encode(text)
            parts += [(self.begin,), ids, (self.end,)]
            ends.append(ends[-1] + len(ids) + 2)
        joined = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        return joined, np.array(ends, np.int64)


def earlier(code: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each word stands earlier in its text."""
    order = np.lexsort((code, text))  # stable: equal words stay in text order
    new = np.ones(len(code), bool)
    new[1:] = (np.diff(code[order]) != 0) | (np.diff(text[order]) != 0)
    head = np.maximum.accumulate(np.where(new, np.arange(len(code)), 0))
    out = np.empty(len(code), np.int64)
    out[order] = np.arange(len(code)) - head
    return out


def windows(ends: np.ndarray, window: int = WINDOW, overlap: int = OVERLAP):
    """First place of each window and its text number.

    The first window of a text scores all it holds, each other one what lies
    right of its overlap with the one before.
    """
    step = window - overlap
    inputs = np.diff(ends) - 1
    count = np.maximum(-(-(inputs - overlap) // step), 1)
    text = np.repeat(np.arange(len(inputs)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return number * step, text


#: Added to attention scores: a place does not see the places after it.
LATER = np.where(np.tri(WINDOW, dtype=bool), 0, -60).astype(np.float32)


@dataclass
class Attention:
    """Weights by name, and the digits of every id."""

    w: dict[str, np.ndarray]
    digits: np.ndarray  # id to its digits

    @classmethod
    def start(cls, counts: np.ndarray, spelled: list[bytes], width: int = WIDTH) -> Attention:
        """Digits and starting frequencies from counts of ids; small random weights."""
        size = len(counts)
        order = np.lexsort((np.arange(size), -counts))
        tier = np.empty(size, np.int64)
        tier[order] = np.arange(size) // DIGIT ** (DIGITS - 1)
        names = [*spelled, b"", b"\xff"]
        order = sorted(range(size), key=lambda i: (tier[i], names[i]))
        place = np.empty(size, np.int64)
        place[order] = np.arange(size)
        digits = np.stack([place // DIGIT**j % DIGIT for j in reversed(range(DIGITS))], axis=1)
        mass = np.zeros(DIGIT**DIGITS)
        mass[place] = counts + 0.1
        random = np.random.default_rng(11)
        small = lambda *shape: random.standard_normal(shape) * 0.1
        w = {"tokens": small(size, width), "places": small(WINDOW, width)}
        w |= {name: small(width, width) for name in ("query", "key", "value", "out")}
        for j in range(DIGITS):
            # Frequencies of a digit, given the digits before it.
            sums = mass.reshape(DIGIT**j, DIGIT, -1).sum(2)
            share = np.maximum(sums, 1e-9) / np.maximum(sums.sum(1, keepdims=True), 1e-9)
            w[f"base{j}"], w[f"digit{j}"] = np.log(share), small(width, DIGIT) * 0.1
            if j:
                w[f"given{j}"] = small(DIGIT, width)
        return cls({k: v.astype(np.float32) for k, v in w.items()}, digits)

    def forward(self, ids: np.ndarray):
        """States for windows of ids, one per row."""
        w = self.w
        x = w["tokens"][ids] + w["places"]
        q, k, v = x @ (w["query"] * np.float32(x.shape[2] ** -0.5)), x @ w["key"], x @ w["value"]
        a = q @ k.transpose(0, 2, 1)
        a += LATER
        a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(2, keepdims=True)
        o = a @ v
        return x, q, k, v, a, o, x + o @ w["out"]

    def logits(self, h: np.ndarray, digits: np.ndarray):
        """States and logits of each digit of the targets, the digits before it given."""
        w, known = self.w, np.zeros(len(h), np.int64)
        states, out = [], []
        for j in range(DIGITS):
            states.append(h)
            out.append(h @ w[f"digit{j}"] + w[f"base{j}"][known])
            known = known * DIGIT + digits[:, j]
            if j + 1 < DIGITS:
                h = h + w[f"given{j + 1}"][digits[:, j]]
        return states, out

    def prepared(self):
        """The same weights laid out for scoring: one product per window, one row of offsets per pair of digits."""
        w = self.w
        width = w["query"].shape[0]
        joint = np.concatenate([w["query"] * np.float32(width**-0.5), w["key"], w["value"]], axis=1)
        out = np.concatenate([w[f"digit{j}"] for j in range(DIGITS)], axis=1)
        places = np.arange(DIGIT ** (DIGITS - 1))
        given, offset = np.zeros((len(places), width), np.float32), []
        for j in range(DIGITS):
            before = places // DIGIT ** (DIGITS - 1 - j)
            if j:
                given = given + w[f"given{j}"][before % DIGIT]
            offset.append(given @ w[f"digit{j}"] + w[f"base{j}"][before])
        sums = np.repeat(np.eye(DIGITS, dtype=np.float32), DIGIT, axis=0)
        return joint, out, np.concatenate(offset, axis=1), sums

    def log_probabilities(self, ids: np.ndarray, inside: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """The same without the short cuts, for weights that overflow them."""
        _, zs = self.logits(self.forward(ids)[-1][inside].astype(np.float64), digits)
        rows, out = np.arange(len(digits)), np.zeros(len(digits))
        for j, z in enumerate(zs):
            top = z.max(1)
            out += z[rows, digits[:, j]] - top - np.log(np.exp(z - top[:, None]).sum(1))
        return out

    def states(self, ids: np.ndarray, joint: np.ndarray) -> np.ndarray:
        """``forward`` without what only training needs."""
        w = self.w
        x = w["tokens"][ids] + w["places"]
        width = x.shape[2]
        qkv = x @ joint
        a = qkv[:, :, :width] @ qkv[:, :, width : 2 * width].transpose(0, 2, 1)
        a += LATER
        np.exp(a, out=a)
        ones = np.ones((*ids.shape, 1), np.float32)
        o = a @ np.concatenate([qkv[:, :, 2 * width :], ones], axis=2)
        return x + (o[:, :, :width] / o[:, :, width:]) @ w["out"]

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The log10 probability of each text, its end included."""
        text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        return np.bincount(text, self.each(ids, ends), len(ends) - 1) / np.log(10)

    def each(self, ids: np.ndarray, ends: np.ndarray, batch: int = 128) -> np.ndarray:
        """The natural log probability of each id, 0 for begin marks."""
        joint, out, offset, sums = self.prepared()
        first, text = windows(ends)
        inputs, found = np.diff(ends) - 1, np.zeros(len(ids))
        step = np.arange(WINDOW)
        for at in range(0, len(first), batch):
            start, own = first[at : at + batch, None], text[at : at + batch, None]
            place = start + step
            inside = (place < inputs[own]) & ((step >= OVERLAP) | (start == 0))
            flat = np.minimum(place, inputs[own] - 1) + ends[own]
            h = self.states(ids[flat], joint)[inside]
            target = flat[inside] + 1
            digits = self.digits[ids[target]]
            z = h @ out
            z += offset[digits[:, :-1] @ DIGIT ** np.arange(DIGITS - 2, -1, -1)]
            rows = np.arange(len(z))[:, None]
            log = z[rows, digits + np.arange(DIGITS) * DIGIT].sum(1)
            np.exp(z, out=z)
            log -= np.log(z @ sums).sum(1)
            if not np.isfinite(log).all():
                log = self.log_probabilities(ids[flat], inside, digits)
            found[target] = log
        return found

    def gradients(self, tokens: np.ndarray, inside: np.ndarray, digits: np.ndarray):
        """Of the mean loss, by name and written out by hand; for tokens, the ids met and their rows."""
        w = self.w
        x, q, k, v, a, o, h = self.forward(tokens)
        states, zs = self.logits(h[inside], digits)
        g, back, each = {}, [], np.arange(len(digits))
        for j, z in enumerate(zs):
            p = np.exp(z)
            total = p @ np.ones((DIGIT, 1), np.float32)
            if not (np.isfinite(total).all() and total.all()):
                p = np.exp(z - z.max(1, keepdims=True))
                total = p.sum(1, keepdims=True)
            p /= total * np.float32(len(p))
            p[each, digits[:, j]] -= np.float32(1 / len(p))
            g[f"digit{j}"] = states[j].T @ p
            back.append(p @ w[f"digit{j}"].T)
        one = np.eye(DIGIT, dtype=np.float32)
        for j in range(1, DIGITS):
            g[f"given{j}"] = one[digits[:, j - 1]].T @ sum(back[j:])
        dh = np.zeros_like(h)
        dh[inside] = sum(back)
        width = x.shape[2]
        fold = lambda left, right: left.reshape(-1, width).T @ right.reshape(-1, width)
        g["out"] = fold(o, dh)
        do = dh @ w["out"].T
        da = do @ v.transpose(0, 2, 1)
        dv = a.transpose(0, 2, 1) @ do
        ds = a * (da - np.einsum("bti,bti->bt", da, a)[:, :, None])
        dq, dk = ds @ k * np.float32(width**-0.5), ds.transpose(0, 2, 1) @ q
        g["query"], g["key"], g["value"] = fold(x, dq), fold(x, dk), fold(x, dv)
        dx = dh + dq @ w["query"].T + dk @ w["key"].T + dv @ w["value"].T
        g["places"] = dx.sum(0)
        flat = tokens.ravel()
        order = np.argsort(flat, kind="stable")
        heads = np.flatnonzero(np.diff(flat[order], prepend=-1))
        g["tokens"] = np.add.reduceat(dx.reshape(-1, width)[order], heads)
        return g, flat[order[heads]]

    def train(
        self, ids: np.ndarray, ends: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02,
        order: np.ndarray | None = None, part: int = 0, parts: int = 1,
    ):
        """Adam on windows in that order, else on random ones; the moments of an id move when it is met.

        ``part`` of ``parts`` says how far the whole training is, for the rate.
        """
        first, text = windows(ends)
        if order is None:
            order = np.random.default_rng(5).integers(0, len(first), steps * batch)
        w, step, length = self.w, np.arange(WINDOW), np.diff(ends) - 1
        learn = [n for n in w if not n.startswith("base")]
        m1 = {n: np.zeros_like(w[n]) for n in learn}
        m2 = {n: np.zeros_like(w[n]) for n in learn}
        turns = -(-len(order) // batch)
        for turn in range(1, turns + 1):
            pick = order[(turn - 1) * batch : turn * batch]
            place, own = first[pick, None] + step, length[text[pick], None]
            inside = place < own
            flat = np.minimum(place, own - 1) + ends[:-1][text[pick], None]
            g, met = self.gradients(ids[flat], inside, self.digits[ids[flat[inside] + 1]])
            through = (part + turn / turns) / parts
            pace = rate * min(1.0, turn / 50) * (1 - 0.9 * through) * (1 - 0.999**turn) ** 0.5 / (1 - 0.9**turn)
            scale = np.float32(min(1.0, 1.0 / max(np.sqrt(sum(float(np.vdot(x, x)) for x in g.values())), 1e-9)))
            for n in learn:
                at = met if n == "tokens" else slice(None)
                move = g[n] * scale
                one, two = 0.9 * m1[n][at] + 0.1 * move, 0.999 * m2[n][at] + 0.001 * move**2
                m1[n][at], m2[n][at] = one, two
                w[n][at] -= pace * one / (np.sqrt(two) + 1e-8)
        return self


def encoded(docs: DataFrame, path: str, pattern: str, kind: type) -> DataFrame:
    """``doc_id, key, ids``, staged: every text as ids between its marks, encoded once for learning and scoring."""
    field = docs.select("doc_id").schema["doc_id"]

    def encode(batches):
        tokens = Tokens(path, pattern)
        for block in blocks(batches):
            ids, ends = tokens.sequences([spaced(block.raw(i)) for i in range(len(block.ends) - 1)])
            ids = ids.astype(kind)
            rows = block.rows
            schema = pa.schema([rows.schema.field("doc_id"), ("key", pa.int64()), ("ids", pa.binary())])
            yield record(schema, rows.column("doc_id"), rows.column("key"), [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])])

    text = whole_text()
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("key"), text.alias("text"))
    return settle(rows.mapInArrow(encode, f"doc_id {field.dataType.simpleString()}, key long, ids binary"), "lm-ids")


def spelled_out(batches, tokens: Tokens, kind: type, limit: int):
    """Blocks of the texts that ids stand for, about ``limit`` ids each, with the ids and their ends."""
    flat = np.frombuffer(b"".join(tokens.spelled), np.uint8)
    width = np.array([*map(len, tokens.spelled), 0, 0], np.int64)
    at = np.cumsum(width) - width
    for batch in batches:
        column = batch.column("ids").cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // kind().itemsize
        every, first = np.frombuffer(column.buffers()[2], kind) if len(column) else None, 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
            ids, own = every[ends[first] : ends[last]].astype(np.int32), ends[first : last + 1] - ends[first]
            wide = width[ids]
            bytes_to = np.concatenate([[0], np.cumsum(wide)])
            data = flat[np.repeat(at[ids] - bytes_to[:-1], wide) + np.arange(bytes_to[-1])]
            yield Block(batch.slice(first, last - first), data, bytes_to[own]), ids, own
            first = last


def packed_lanes(coded: DataFrame, lanes: int, kind: type) -> DataFrame:
    """``lane, windows, ids, ends``: the texts dealt to each lane, as ids in one row."""
    schema = pa.schema([("lane", pa.int64()), ("windows", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary())])

    def lay(key, table):
        order = np.argsort(np.asarray(table.column("key")), kind="stable")
        own = [table.column("ids")[int(i)].as_py() for i in order]
        ends = np.cumsum([0, *(len(x) // kind().itemsize for x in own)])
        row = [key[0].as_py()], [len(windows(ends)[0])], [b"".join(own)], [ends.tobytes()]
        return pa.Table.from_batches([record(schema, *row)])

    dealt = coded.select(F.pmod(F.xxhash64("key"), F.lit(lanes)).alias("lane"), "key", "ids")
    return dealt.groupBy("lane").applyInArrow(lay, "lane long, windows long, ids binary, ends binary")


def in_lanes(batches, kind: type):
    """The lane, ids and ends of each row of ``packed_lanes``."""
    for batch in batches:
        for lane, ids, ends in zip(*(batch.column(n) for n in ("lane", "ids", "ends"))):
            yield lane.as_py(), np.frombuffer(ids.as_buffer(), kind).astype(np.int32), np.frombuffer(ends.as_buffer(), np.int64)


def id_counts(lanes: DataFrame, size: int, kind: type) -> np.ndarray:
    """How often each id stands in the lanes."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(size, np.int64)
        for _, ids, _ in in_lanes(batches, kind):
            total += np.bincount(ids, minlength=size)
        met = np.flatnonzero(total)
        yield record(schema, met, total[met])

    found = lanes.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size)
    counts[np.asarray(found.column("id"))] = np.asarray(found.column("n"))
    return counts


#: What a lane changed: of the ids of one range, or (range -1) of all other weights.
_CHANGE = pa.schema([("range", pa.int64()), ("lane", pa.int64()), ("ids", pa.binary()), ("seen", pa.binary()), ("moved", pa.binary())])
_SUMMED = pa.schema([("range", pa.int64()), ("seen", pa.binary()), ("moved", pa.binary())])


def other_weights(w: dict[str, np.ndarray]) -> list[str]:
    return [n for n in sorted(w) if n != "tokens" and not n.startswith("base")]


def one_round(lanes: DataFrame, model: Attention, part: int, passes: int, kind: type) -> Attention:
    """All lanes learn from their next windows; the mean of what they changed is applied."""
    shared, others = lanes.sparkSession.sparkContext.broadcast(model), other_weights(model.w)
    width = model.w["tokens"].shape[1]

    def learn(batches):
        for lane, ids, ends in in_lanes(batches, kind):
            old = shared.value
            own = Attention({n: x.copy() for n, x in old.w.items()}, old.digits)
            random, count = np.random.default_rng([5, lane]), len(windows(ends)[0])
            order = np.concatenate([random.permutation(count) for _ in range(passes)])
            order = order[len(order) * part // ROUNDS : len(order) * (part + 1) // ROUNDS]
            if not len(order):
                continue
            own.train(ids, ends, order=order, part=part, parts=ROUNDS)
            moved = np.concatenate([(own.w[n] - old.w[n]).ravel() for n in others])
            yield record(_CHANGE, [-1], [lane], [b""], [np.array([len(order)], np.float64).tobytes()], [moved.tobytes()])
            first, text = windows(ends)
            place = first[order, None] + np.arange(WINDOW)
            inside = place < (np.diff(ends) - 1)[text[order], None]
            met, seen = np.unique(ids[(place + ends[:-1][text[order], None])[inside]], return_counts=True)
            moved = own.w["tokens"][met] - old.w["tokens"][met]
            cuts = np.flatnonzero(np.diff(met // RANGE, prepend=-1))
            spans = list(zip(cuts, [*cuts[1:], len(met)]))
            yield record(
                _CHANGE, [int(met[a]) // RANGE for a, _ in spans], [lane] * len(spans), [met[a:b].astype(np.int32).tobytes() for a, b in spans],
                [seen[a:b].astype(np.float64).tobytes() for a, b in spans], [moved[a:b].tobytes() for a, b in spans],
            )

    def add(batches):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at, ids, seen, moved in zip(*(batch.column(n) for n in ("range", "ids", "seen", "moved"))):
                at, ids = at.as_py(), np.frombuffer(ids.as_py(), np.int32)
                seen, moved = np.frombuffer(seen.as_py(), np.float64), np.frombuffer(moved.as_py(), np.float32)
                if at not in sums:
                    sums[at] = (np.zeros(RANGE), np.zeros((RANGE, width))) if at >= 0 else (np.zeros(1), np.zeros((1, len(moved))))
                rows = ids % RANGE if at >= 0 else np.zeros(1, np.int64)
                sums[at][0][rows] += seen
                sums[at][1][rows] += seen[:, None] * moved.reshape(len(seen), -1)
        for at, (seen, moved) in sums.items():
            yield record(_SUMMED, [at], [seen.tobytes()], [moved.tobytes()])

    changed = lanes.mapInArrow(learn, "range long, lane long, ids binary, seen binary, moved binary")
    summed = changed.repartition("range").sortWithinPartitions("range", "lane").mapInArrow(add, "range long, seen binary, moved binary")
    w = {n: x.copy() for n, x in model.w.items()}
    # One row for each range of ids: no more than the model holds.
    for row in settle(summed, "lm-round").collect():
        seen = np.frombuffer(row["seen"], np.float64)
        mean = np.frombuffer(row["moved"], np.float64).reshape(len(seen), -1) / np.maximum(seen, 1)[:, None]
        if row["range"] >= 0:
            own = w["tokens"][row["range"] * RANGE : (row["range"] + 1) * RANGE]
            own += mean[: len(own)].astype(np.float32)
        else:
            ends = np.cumsum([0, *(w[n].size for n in others)])
            for n, a, b in zip(others, ends, ends[1:]):
                w[n] += mean[0, a:b].reshape(w[n].shape).astype(np.float32)
    shared.destroy()
    return Attention(w, model.digits)


def id_kind(tokens: Tokens) -> type:
    return np.uint16 if tokens.end < 1 << 16 else np.int32


def fit(docs: DataFrame, path: str, pattern: str, steps: int = STEPS, coded: DataFrame | None = None) -> Attention:
    """Train on all training texts, in Spark; ``coded`` are all texts ``encoded``, if they are already."""
    training = docs.filter(~held_out("doc_id", MODULUS, HELD))
    # An empty text counts for one byte: it has an end to be learned.
    size = training.agg(F.sum(F.octet_length(whole_text()) + 1)).first()[0] or 0
    tokens = Tokens(path, pattern)
    if not size:
        return Attention.start(np.zeros(tokens.size + 2), tokens.spelled)
    kind = id_kind(tokens)
    coded = (encoded(training, path, pattern, kind) if coded is None else coded).filter(~held_out("doc_id", MODULUS, HELD))
    lanes = settle(packed_lanes(coded, -(-size // LANE_BYTES), kind), "lm-lanes")
    model = Attention.start(id_counts(lanes, tokens.size + 2, kind), tokens.spelled)
    passes = max(1, -(-steps * BATCH // lanes.agg(F.sum("windows")).first()[0]))
    for part in range(ROUNDS):
        model = one_round(lanes, model, part, passes, kind)
    return model


def scores(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row."""
    training = docs.filter(~held_out("doc_id", MODULUS, HELD))
    counts = settle(word_counts(training), "lm-counts")
    texts = training.count()
    words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = words["n"] + texts, words["v"] + (texts > 0)
    # At most PARTS words can each make up one part in PARTS of all tokens.
    common = counts.filter(F.col("c") * PARTS >= F.lit(total)).orderBy("code").toArrow()
    code = np.asarray(common.column("code").combine_chunks(), np.int64)
    count = np.asarray(common.column("c").combine_chunks(), np.float64)
    packing = id_kind(Tokens(path, pattern))
    coded = encoded(docs, path, pattern, packing)
    model = fit(docs, path, pattern, coded=coded)
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((code, count, model))
    share_log = np.log10(total + distinct + 1)
    # Nothing was counted without training rows; the attention model has that weight then.
    counted = COUNTED if total else 0.0

    def run(batches):
        code, count, model = shared.value
        tokens, part, number = Tokens(path, pattern), TaskContext.get().partitionId(), 0
        for block, ids, ends in spelled_out(batches, tokens, packing, 1 << 17):
            rows = len(block.ends) - 1
            word, text, length = word_codes(block)
            signed = word.view(np.int64)
            place = np.minimum(np.searchsorted(code, signed), max(len(code) - 1, 0))
            hit = code[place] == signed if len(code) else np.zeros(len(signed), bool)
            c = np.where(hit, count[place], 0.0) if len(code) else np.zeros(len(signed))
            per = per_text(text, rows)
            # The end of a text is a token behind its words.
            last = np.cumsum(per)
            n_tokens, known = per + 1, np.bincount(text[hit], minlength=rows) + (texts > 0)
            base = np.bincount(text, np.log10(c + 1), rows) + np.log10(texts + 1) - n_tokens * share_log
            owner = np.insert(text, last, np.arange(rows))
            c, size = np.insert(c, last, texts), np.insert(length + 1, last, 1)
            before = np.arange(len(owner)) - np.repeat(last - per + np.arange(rows), n_tokens)
            again = np.insert(earlier(signed, text), last, 0)
            # An id belongs to the word that holds its first byte.
            first = np.cumsum(size) - size
            width = tokens.lengths[ids]
            at = np.searchsorted(first, np.cumsum(width) - width, "right") - 1
            model_log = np.bincount(at, model.each(ids, ends), len(owner))
            repeated = REPEATED * before / (before + SETTLING)
            scale = (1 - repeated) / (1 - REPEATED)
            with np.errstate(divide="ignore"):
                without = np.logaddexp(
                    np.log(repeated * again / np.maximum(before, 1)),
                    np.log(scale * (1 - REPEATED - counted)) + model_log,
                )
                share = np.log(scale * counted / max(total, 1))
                score = np.bincount(owner, np.logaddexp(without, share + np.log(c)), rows) / np.log(10)
            uid = (part << 33) + number + np.arange(rows)
            number += rows
            schema = pa.schema([("uid", pa.int64()), block.rows.schema.field("doc_id"), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("code", pa.int64()), ("odds", pa.float64())])
            yield record(
                schema, uid, block.rows.column("doc_id"), n_tokens, known, base, score,
                pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.float64()),
            )
            # Other words: the log odds of one count against the other two parts.
            rare = np.flatnonzero(~hit)
            place = rare + text[rare]
            none = [pa.nulls(len(rare), schema.field(i).type) for i in range(1, 6)]
            yield record(schema, uid[text[rare]], *none, signed[rare], (share - without)[place])

    out = settle(
        coded.select("doc_id", "ids").mapInArrow(run, f"uid long, doc_id {kind}, n_tokens long, n_known long, base double, score double, code long, odds double"),
        "lm-rows",
    )
    rare = out.filter("code IS NOT NULL").select("uid", "code", "odds")
    rest = counts.filter(F.col("c") * PARTS < F.lit(total))
    # log(1 + c * odds), without overflow.
    odds = F.col("odds") + F.log("c")
    raised = F.greatest(odds, F.lit(0.0)) + F.log1p(F.exp(-F.abs(odds)))
    per_row = rare.join(rest, "code").groupBy("uid").agg(
        F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("gain"), F.sum(raised).alias("raised")
    )
    return (
        out.filter("code IS NULL")
        .join(per_row, "uid", "left")
        .select(
            "doc_id",
            held_out("doc_id", MODULUS, HELD).alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("raised", F.lit(0.0)) / float(np.log(10))).alias("score"),
        )
    )
