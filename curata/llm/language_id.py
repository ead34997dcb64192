"""Language of texts by a linear-chain conditional random field over their words.

Each word has a hidden language.  Its features are the word itself (lexicon),
its first and last one to three bytes (affixes) and all runs of three bytes in
it (n-grams), hashed into ``BUCKETS`` rows of one weight per language.  A
transition weight per pair of languages joins neighbours.  Forward-backward
gives each word's probabilities; a text's language is the one with the highest
mean, which is the score.

The field is trained here, by the gradient of the conditional likelihood on
stretches of ``STRETCH`` words, from at most ``FIT_ROWS`` training documents
(those with the lowest hash of doc_id); a training word has the language of its
document.  Only text and lang of training rows are read to learn.

Chains are scored whole.  They are cut into stretches whose transfer matrices
are multiplied side by side, then the messages between stretches are passed
on, so the result is that of one pass along the text.

Nulls: a null text, and one without a letter, is ``und`` with score 0; a null
doc_id counts as an empty text in the split.  Every row gives one row; equal
rows too.  Without training rows every text is ``und``.  An empty table gives
an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import U64, Block, Rolling, blocks, byte_table, lowered, mix, per_text, record, word_bounds
from curata.llm.tables import held_out, settle, whole_text

MODULUS, HELD = 4, 2
FIT_ROWS = 1200
BUCKETS = 1 << 16
STRETCH = 32
UNKNOWN = "und"
AFFIX = (1, 2, 3)
GRAM = 3

#: Words: letters and all bytes above 0x7F.
LETTERS = byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


@dataclass
class Words:
    """Features of the words of a block: fixed ones per word, and n-grams with the word each stands in."""

    text: np.ndarray
    fixed: np.ndarray
    gram: np.ndarray
    gram_word: np.ndarray

    def score(self, weights: np.ndarray) -> np.ndarray:
        out = weights[self.fixed[0]].astype(np.float64)
        for f in self.fixed[1:]:
            out += weights[f]
        if len(self.gram):
            heads = np.flatnonzero(np.append(True, self.gram_word[1:] != self.gram_word[:-1]))
            out[self.gram_word[heads]] += np.add.reduceat(weights[self.gram].astype(np.float64), heads, axis=0)
        return out


def words(block: Block) -> Words:
    low = lowered(block.data)
    start, end, text = word_bounds(low, block.ends, LETTERS)
    rolling = Rolling(low, 3)
    bucket = lambda h, kind: (mix(h * U64(2 * kind + 3)) >> U64(48)).astype(np.int64)
    fixed = [bucket(rolling.of(start, end), 0)]
    for kind, size in enumerate(AFFIX, 1):
        fixed.append(bucket(rolling.of(start, np.minimum(start + size, end)), kind))
        fixed.append(bucket(rolling.of(np.maximum(end - size, start), end), kind + len(AFFIX)))
    count = np.maximum(end - start - GRAM + 1, 0)
    owner = np.repeat(np.arange(len(start)), count)
    at = np.repeat(start, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return Words(text, np.stack(fixed) if len(start) else np.zeros((7, 0), np.int64), bucket(rolling.of(at, at + GRAM), 9), owner)


def stretches(text: np.ndarray, size: int = STRETCH):
    """Word numbers as rows of ``size`` (-1 where a row is shorter), the text of each row, and if it is the text's first."""
    texts = int(text[-1]) + 1 if len(text) else 0
    count = per_text(text, texts)
    rows = -(-count // size)
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(texts), rows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    at = (first[owner] + number * size)[:, None] + np.arange(size)
    at[at >= (first + count)[owner][:, None]] = -1
    return at, owner, number


def _unit(x: np.ndarray) -> np.ndarray:
    axes = tuple(range(1, x.ndim))
    return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)


def forward_backward(emit: np.ndarray, move: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Probabilities of each word's language; ``emit``: likelihoods per word, ``move``: transition factors.

    Words are in text order; a chain ends with its text.
    """
    k = emit.shape[1]
    at, owner, number = stretches(text)
    there = at >= 0
    value = np.where(there[:, :, None], emit[at], 1.0)
    rows = len(at)
    # The transfer matrix of each stretch; its first word also moves in from the stretch before.
    total = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for t in range(at.shape[1]):
        step = np.matmul(total, move) * value[:, t, None, :]
        total = np.where(there[:, t, None, None], _unit(step), total)
    # Messages between stretches, all texts side by side.
    into, out = np.ones((rows, k)), np.ones((rows, k))
    longest = int(number.max()) + 1 if rows else 0
    by_number = np.argsort(number, kind="stable")
    cut = np.searchsorted(number[by_number], np.arange(longest + 1))
    for n in range(1, longest):
        here = by_number[cut[n] : cut[n + 1]]
        into[here] = _unit(np.matmul(into[here - 1, None, :], total[here - 1])[:, 0])
    last = np.append(owner[1:] != owner[:-1], True) if rows else np.zeros(0, bool)
    for n in range(longest - 1, 0, -1):
        here = by_number[cut[n] : cut[n + 1]]
        out[here - 1] = _unit(np.matmul(total[here], out[here, :, None])[:, :, 0])
    out[last] = 1.0
    # Along every stretch, from the messages at its ends.
    ahead = np.empty((at.shape[1], rows, k))
    f = into
    for t in range(at.shape[1]):
        f = np.where(there[:, t, None], _unit(np.matmul(f, move) * value[:, t]), f)
        ahead[t] = f
    found = np.zeros((len(text), k))
    b = out
    for t in range(at.shape[1] - 1, -1, -1):
        row = there[:, t]
        both = ahead[t] * b
        found[at[row, t]] = (both / both.sum(1, keepdims=True))[row]
        b = np.where(row[:, None], _unit(np.matmul(b * value[:, t], move.T)), b)
    return found


def train(found: list[Words], language: list[np.ndarray], k: int, epochs: int = 6, rate: float = 0.5):
    """Feature and transition weights by gradient ascent with falling steps per weight."""
    weights, move = np.zeros((BUCKETS, k)), np.zeros((k, k))
    seen, seen_move = np.full((BUCKETS, 1), 1.0), 1.0
    for _ in range(epochs):
        for w, gold_text in zip(found, language):
            if not len(w.text):
                continue
            # Every stretch is a chain of its own here.
            at, owner, _ = stretches(w.text)
            there = at >= 0
            chain = np.repeat(np.arange(len(at)), there.sum(1))
            score = w.score(weights)
            emit = np.exp(score - score.max(1, keepdims=True))
            factor = np.exp(move - move.max())
            guess = forward_backward(emit, factor, chain)
            gold = np.zeros((len(w.text), k))
            gold[np.arange(len(w.text)), gold_text[w.text]] = 1
            error = (gold - guess) / len(w.text)
            slope = np.zeros((BUCKETS, k))
            every = [(f, error) for f in w.fixed] + [(w.gram, error[w.gram_word])]
            for j in range(k):
                for f, e in every:
                    slope[:, j] += np.bincount(f, e[:, j], BUCKETS)
            slope *= 1000
            seen += (slope**2).sum(1, keepdims=True)
            weights += rate * slope / np.sqrt(seen)
            # Moves: gold pairs of neighbours against the pairs that the field expects.
            inside = np.flatnonzero(chain[1:] == chain[:-1])
            pair = guess[inside][:, :, None] * factor * (emit[inside + 1] * 1.0)[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            step = (gold[inside][:, :, None] * gold[inside + 1][:, None, :]).sum(0) - pair.sum(0)
            step = 10 * step / max(len(inside), 1)
            seen_move += (step**2).sum()
            move = np.clip(move + rate * step / np.sqrt(seen_move), -6, 6)
    return weights.astype(np.float32), move


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    move: np.ndarray

    def words(self, block: Block) -> tuple[Words, np.ndarray]:
        """The words of a block and their probabilities by language."""
        w = words(block)
        score = w.score(self.weights)
        emit = np.exp(score - score.max(1, keepdims=True)) if len(score) else score
        return w, forward_backward(emit, np.exp(self.move - self.move.max()), w.text)

    def predict(self, block: Block) -> tuple[list[str], np.ndarray]:
        texts = len(block.ends) - 1
        if not self.languages:
            return [UNKNOWN] * texts, np.zeros(texts)
        w, found = self.words(block)
        total = np.stack([np.bincount(w.text, found[:, j], texts) for j in range(len(self.languages))], axis=1)
        share = total / np.maximum(total.sum(1, keepdims=True), 1e-300)
        best = share.argmax(1)
        ascii_letters = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum(((block.data | 32) >= 97) & ((block.data | 32) <= 122), out=ascii_letters[1:])
        plain = ascii_letters[block.ends[1:]] > ascii_letters[block.ends[:-1]]
        known = [bool(p) or any(c.isalpha() for c in block.raw(i).decode("utf-8", "ignore")) for i, p in enumerate(plain)]
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], np.where(known, share.max(1), 0.0)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Train on a bounded, repeatable choice of training documents, each one whole."""
    able = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id", MODULUS, HELD))
    languages = sorted(r["lang"] for r in able.select("lang").distinct().collect())
    chosen = settle(
        able.select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(fit_rows), "language-fit"
    )  # at most fit_rows ids, so they may be broadcast
    rows = able.join(F.broadcast(chosen), able["doc_id"] == chosen["_id"]).select("doc_id", whole_text().alias("text"), "lang")
    sample = rows.dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    found, gold = [], []
    for block in blocks(sample.to_batches(), limit=1 << 17):
        found.append(words(block))
        gold.append(np.array([languages.index(x) for x in block.rows.column("lang").to_pylist()]))
    weights, move = train(found, gold, len(languages))
    return Model(languages, weights, move)


def identified_languages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` per row; nothing is shuffled."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for block in blocks(batches, limit=1 << 19):
            found, score = model.predict(block)
            schema = pa.schema([block.rows.schema.field("doc_id"), ("lang_pred", pa.string()), ("score", pa.float64())])
            yield record(schema, block.rows.column("doc_id"), found, score)

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    found = identified_languages(docs, fit(docs))
    return found.select("doc_id", held_out("doc_id", MODULUS, HELD).alias("held_out"), "lang_pred", "score")
