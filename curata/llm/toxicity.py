"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. **Lexicons.**  From at most ``FIT_ROWS`` labelled training rows (those with
   the lowest hash of doc_id; one of each group of near copies), Spark counts in how many toxic and clean texts
   each word and each word beginning of 4 to 6 bytes occurs.  Entries that
   clearly favour toxic texts (a likelihood ratio of ``EVIDENCE`` or more) form
   the lexicon.  An entry with a share of toxic texts under ``STRONG`` counts
   from its second time in a text on.
2. **Voters.**  The lexicon is dealt over ``GROUPS`` voters per kind of entry;
   each votes toxic where one of its entries occurs and abstains elsewhere.
   A fixed list of insults, shouting, and a voter for texts without any entry
   join them.
3. **Label model.**  Expectation maximisation estimates how often each voter
   votes given the hidden label, and the correlation of voters given the label;
   correlated voters share their weight.  The result is a posterior per text.
4. **Classifier.**  Logistic regression from counts of lexicon entries and of
   listed insults to the posteriors.  It scores every whole text.

Only the training rows' labels are read; labels, lang, source and doc_id are
never inputs of a score.

Nulls: a null text is empty and gets the score of a text without entries; rows
without a label, with a null label or a null doc_id are not learned from.
Repeated rows are scored one by one; labels that contradict each other count as
toxic.  With fewer than ``LEAST`` unlike labelled rows of a kind, nothing is
learned and only the fixed list speaks.  An
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import U64, Block, Rolling, blocks, byte_table, longs, lowered, mix, record, word_bounds
from curata.llm.minhash_dedup import sets, signatures
from curata.llm.tables import held_out, settle, whole_text

MODULUS, HELD = 5, 0
FIT_ROWS = 20_000
LEXICON = 8192
EVIDENCE = 20.0
GROUPS = 4
BANDS = 4
KINDS = (0, 4, 5, 6)
STRONG = 0.9
LEAST = 20

#: Common English insults.
INSULTS = """
bastard clown creep disgusting dumb fool freak garbage idiot imbecile jerk loser moron pathetic pig scum
stupid trash vermin worthless
""".split()

#: Words: digits, letters and all bytes above 0x7F.
LETTERS = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def entries(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of words and word beginnings, their kind and their text number."""
    low = lowered(block.data)
    start, end, text = word_bounds(low, block.ends, LETTERS)
    rolling = Rolling(low, 2)
    codes, kinds, texts = [], [], []
    for number, size in enumerate(KINDS):
        pick = end - start >= max(size, 1)
        stop = end[pick] if size == 0 else start[pick] + size
        codes.append(mix(rolling.of(start[pick], stop) * U64(2 * number + 3)))
        kinds.append(np.full(len(stop), number, np.int8))
        texts.append(text[pick])
    return np.concatenate(codes), np.concatenate(kinds), np.concatenate(texts)


def shouting(block: Block) -> np.ndarray:
    """The share of capitals among ASCII letters, per text."""
    data = block.data
    capital = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    letter = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
    of = lambda sums: sums[block.ends[1:]] - sums[block.ends[:-1]]
    return of(capital) / np.maximum(of(letter), 1)


def listed() -> np.ndarray:
    """Codes of the fixed list, as whole words."""
    batch = pa.record_batch({"text": [" ".join(INSULTS)]})
    code, kind, _ = entries(next(blocks([batch])))
    return np.sort(code[kind == 0])


@dataclass
class Lookup:
    """A sorted list of codes with a table of their leading bits in front."""

    codes: np.ndarray

    def __post_init__(self):
        self.front = np.zeros(1 << 20, bool)
        self.front[(self.codes >> U64(44)).astype(np.int64)] = True

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``code`` that are listed, and their place in the list."""
        rows = np.flatnonzero(self.front[(code >> U64(44)).astype(np.int64)])
        if not len(self.codes):
            return rows[:0], rows[:0]
        place = np.minimum(np.searchsorted(self.codes, code[rows]), len(self.codes) - 1)
        good = self.codes[place] == code[rows]
        return rows[good], place[good]


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``text, toxic``: a bounded, repeatable choice of labelled training rows."""
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("_id IS NOT NULL AND toxic IS NOT NULL")
        .filter(~held_out("_id", MODULUS, HELD))
        .groupBy("_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    chosen = settle(chosen, "toxicity-labels")  # at most fit_rows rows, so it may be broadcast
    rows = docs.select(F.col("doc_id").alias("_id"), whole_text().alias("text"))
    return one_per_copy(settle(rows.join(F.broadcast(chosen), "_id"), "toxicity-fit"))


def one_per_copy(rows: DataFrame) -> DataFrame:
    """One training row of each group of near copies with one label, so that copies are not evidence.

    Rows are grouped by bands of two MinHash values; the rows are a bounded
    sample, and so are the sketches that the driver groups.
    """
    names = [f"band{i}" for i in range(BANDS)]
    schema = pa.schema([("_id", pa.int64()), ("toxic", pa.int64()), *((n, pa.int64()) for n in names)])

    def sketch(batches):
        for block in blocks(batches):
            found = sets(block)
            count = np.array([len(f) for f in found], np.int64)
            has = np.flatnonzero(count)
            if len(has):
                symbols = signatures(np.concatenate([found[i] for i in has]), count[has])[:, : 2 * BANDS].astype(U64)
                bands = mix(symbols[:, ::2] * U64(0x9E3779B97F4A7C15) + symbols[:, 1::2] + np.arange(BANDS, dtype=U64))
                ids, toxic = np.asarray(block.rows.column("_id"))[has], np.asarray(block.rows.column("toxic"))[has]
                yield record(schema, ids, toxic.astype(np.int64), *(longs(np.ascontiguousarray(b)) for b in bands.T))

    found = rows.mapInArrow(sketch, ", ".join(f"{f.name} long" for f in schema)).toPandas()
    found = found.sort_values(["_id", *names]).reset_index(drop=True)
    top = list(range(len(found)))

    def lead(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for name in names:
        first: dict = {}
        for i, key in enumerate(zip(found["toxic"], found[name])):
            other = lead(first.setdefault(key, i))
            top[lead(i)] = min(other, lead(i))
            top[max(other, lead(i))] = min(other, lead(i))
    kept = sorted({int(found["_id"][lead(i)]) for i in range(len(found))})
    kept = rows.sparkSession.createDataFrame([(k,) for k in kept], "_id long")
    unlike = rows.join(F.broadcast(kept), "_id", "left_semi").select("text", "toxic")
    return settle(unlike, "toxicity-unlike")


def lexicon(rows: DataFrame, size: int = LEXICON, evidence: float = EVIDENCE):
    """Codes, kinds and strength of the ``size`` entries that speak most for toxic texts, and the share of clean rows.

    None with fewer than ``LEAST`` rows of a kind.
    """
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), sum(n for t, n in totals.items() if t != 1)
    if min(toxic, clean) < LEAST:
        return None
    schema = pa.schema([("code", pa.int64()), ("kind", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches):
        for block in blocks(batches):
            code, kind, text = entries(block)
            label = np.asarray(block.rows.column("toxic")) == 1
            order = np.lexsort((text, code))
            code, kind, text = code[order], kind[order], text[order]
            once = np.ones(len(code), bool)
            once[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
            code, kind, hit = code[once], kind[once], label[text[once]]
            head = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
            if len(head):
                bad = np.add.reduceat(hit.astype(np.int64), head)
                yield record(schema, longs(code[head]), kind[head].astype(np.int64), bad, np.diff(np.append(head, len(code))) - bad)

    base = (toxic + 1) / (toxic + clean + 20)
    counted = (
        rows.mapInArrow(count, "code long, kind long, toxic long, clean long")
        .groupBy("code", "kind")
        .agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        .filter("t >= 3")
        .withColumn("share", F.col("t") / (F.col("t") + F.col("c")))
        .filter(F.col("share") > base)
        .withColumn(
            "g",
            2 * F.col("t") * F.log(F.col("share") / base)
            + F.when(F.col("c") > 0, 2 * F.col("c") * F.log((1 - F.col("share")) / (1 - base))).otherwise(0.0),
        )
        .filter((F.col("g") >= evidence) & (F.col("share") >= 0.5))
        .orderBy(F.desc("g"), "code")
        .limit(size)
        .select("code", "kind", (F.col("share") >= STRONG).alias("strong"))
    )
    found = counted.collect()
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int8), np.zeros(0, bool), 1 - base
    code = np.array([r["code"] for r in found], np.int64).view(U64)
    kind = np.array([r["kind"] for r in found], np.int8)
    strong = np.array([r["strong"] for r in found], bool)
    order = np.argsort(code)
    return code[order], kind[order], strong[order], 1 - base


def votes(counts: tuple[np.ndarray, np.ndarray], texts: int, voter_of: np.ndarray, voters: int, insult, shout):
    """A matrix of votes: 1 toxic, -1 clean, 0 abstains.  ``counts``: text and lexicon place of each hit."""
    out = np.zeros((texts, voters + 3), np.int8)
    text, place = counts
    out[text, voter_of[place]] = 1
    out[insult > 0, voters] = 1
    out[shout > 0.6, voters + 1] = 1
    quiet = np.ones(texts, bool)
    quiet[text] = False
    out[quiet & (insult == 0), voters + 2] = -1
    return out


def label_model(vote: np.ndarray, clean_prior: float, rounds: int = 30) -> np.ndarray:
    """The probability that each text is toxic, from votes alone and the share of toxic texts."""
    prior = np.clip(1 - clean_prior, 0.01, 0.99)
    # To begin with, a text is as toxic as the balance of its votes says.
    post = np.clip(0.5 + 0.45 * np.sign(vote.sum(axis=1)), 0.05, 0.95)
    for _ in range(rounds):
        # Voters that speak together, given the label, share one voter's weight.
        rest = vote - np.outer(post, post @ vote / max(post.sum(), 1e-9))
        rest -= np.outer(1 - post, (1 - post) @ vote / max((1 - post).sum(), 1e-9))
        spread = np.sqrt((rest**2).sum(0)) + 1e-9
        correlation = np.clip(rest.T @ rest / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(correlation, 0)
        weight = 1 / (1 + correlation.sum(1))
        score = np.log(prior / (1 - prior)) * np.ones(len(vote))
        for j in range(vote.shape[1]):
            for sign in (1, 0, -1):
                at = vote[:, j] == sign
                if at.any():
                    given = lambda p: (p[at].sum() + 0.1) / (p.sum() + 0.3)  # noqa: E731, B023
                    score[at] += weight[j] * np.log(given(post) / given(1 - post))
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return post


def logistic(text, place, amount, target: np.ndarray, features: int, rounds: int = 400, ridge: float = 1e-3):
    """Weights (the last is the constant) fitted to probabilities; triplets hold the non-zero inputs."""
    weight = np.zeros(features + 1)
    rate = np.full(features + 1, 0.3)
    last = np.zeros(features + 1)
    for _ in range(rounds):
        z = weight[-1] + np.bincount(text, weight[place] * amount, len(target))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        slope = np.append(np.bincount(place, error[text] * amount, features), error.sum())
        slope[:-1] += ridge * len(target) / max(features, 1) * weight[:-1]
        # Steps grow while a slope keeps its sign and shrink when it turns.
        turn = slope * last
        rate = np.clip(np.where(turn > 0, rate * 1.2, np.where(turn < 0, rate * 0.5, rate)), 1e-6, 1.0)
        weight -= np.sign(slope) * rate
        last = slope
    return weight


@dataclass
class Model:
    codes: np.ndarray
    strong: np.ndarray
    weights: np.ndarray  # of the codes, of a listed insult, and the constant

    def __post_init__(self):
        self.lookup, self.insults = Lookup(self.codes), Lookup(listed())

    def score(self, block: Block) -> np.ndarray:
        texts = len(block.ends) - 1
        text, place, amount = hits(block, self.lookup, self.insults, self.strong)
        z = self.weights[-1] + np.bincount(text, self.weights[place] * amount, texts)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def hits(block: Block, lookup: Lookup, insults: Lookup, strong: np.ndarray):
    """Triplets: text, input number, log of one plus its count.  The last input is the fixed list.

    An entry that clean texts use now and then counts from its second time on.
    """
    code, kind, text = entries(block)
    rows, place = lookup.find(code)
    mine, _ = insults.find(code)
    mine = mine[kind[mine] == 0]
    width = len(lookup.codes) + 1
    key = np.concatenate([text[rows] * width + place, text[mine] * width + width - 1])
    key, times = np.unique(key, return_counts=True)
    good = np.append(strong, True)[key % width] | (times > 1)
    return key[good] // width, key[good] % width, np.log1p(times[good])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Lexicon, votes, label model and classifier; only counts and triplets of hits reach the driver."""
    rows = training_rows(docs, labels, fit_rows)
    found = lexicon(rows)
    if found is None:
        return Model(np.zeros(0, U64), np.zeros(0, bool), np.array([6.0, -3.0]))
    code, kind, strong, clean_prior = found
    schema = pa.schema([("part", pa.int64()), ("text", pa.int64()), ("place", pa.int64()), ("amount", pa.float64()), ("shout", pa.float64())])

    def triplets(batches):
        lookup, insults, number = Lookup(code), Lookup(listed()), 0
        part = TaskContext.get().partitionId()
        for block in blocks(batches):
            texts = len(block.ends) - 1
            text, place, amount = hits(block, lookup, insults, strong)
            shout = shouting(block)
            # One row with place -1 says that a text is there.
            there = np.arange(texts)
            text, place = np.concatenate([there, text]), np.concatenate([np.full(texts, -1), place])
            amount = np.concatenate([np.zeros(texts), amount])
            yield record(schema, np.full(len(text), part), text + number, place, amount, shout[text])
            number += texts

    found = rows.mapInArrow(triplets, "part long, text long, place long, amount double, shout double").toPandas()
    _, text = np.unique(found["part"].to_numpy() * fit_rows + found["text"].to_numpy(), return_inverse=True)
    place, amount = found["place"].to_numpy(), found["amount"].to_numpy()
    texts = int(text.max()) + 1
    shout = np.zeros(texts)
    shout[text] = found["shout"].to_numpy()
    real = place >= 0
    text, place, amount = text[real], place[real], amount[real]
    insult = np.bincount(text[place == len(code)], minlength=texts)
    lexical = place < len(code)
    voter_of = kind.astype(np.int64) * GROUPS + (code % U64(GROUPS)).astype(np.int64)
    vote = votes((text[lexical], place[lexical]), texts, voter_of, len(KINDS) * GROUPS, insult, shout)
    target = label_model(vote, clean_prior)
    return Model(code, strong, logistic(text, place, amount, target, len(code) + 1))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` per row; nothing is shuffled."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for block in blocks(batches):
            score = model.score(block)
            schema = pa.schema([block.rows.schema.field("doc_id"), ("score", pa.float64()), ("predicted", pa.int32())])
            yield record(schema, block.rows.column("doc_id"), score, (score >= 0.5).astype(np.int32))

    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns."""

    def run(batches):
        for block in blocks(batches):
            yield block.rows.filter(pa.array(model.score(block) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", held_out("doc_id", MODULUS, HELD).alias("held_out"), "score", "predicted")
