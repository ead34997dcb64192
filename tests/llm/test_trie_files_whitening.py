"""The prefix trie, token files and whitening against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curata.llm import huffman, prefix_trie, queries, token_files, whitening

SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
TURNS = "conv_id long, turn long, role string, text string"


# --- prefix trie ------------------------------------------------------------


def trie_by_hand(rows):
    """Every prefix in a dictionary, subtrees by walking up."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            spelled = f"{len(role)}:{role}{text}".encode()
            own[conv].append(((turn is not None, turn or 0), hashlib.md5(spelled).hexdigest(), role, text))
    own = {c: [(r, x) for _, _, r, x in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        whole = own.get(conv - int(math.fmod(conv, 100)), [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(conv)
        ends[tuple(whole)].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, found in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(found) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += not children[node]
    return sorted(
        (
            (
                min(found), len(node), min(members[node[:-1]]) if node else None, len(found), children[node], leaves[node],
                saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
            )
            for node, found in members.items()
        ),
        key=str,
    )


def talks(seed):
    """Conversations with shared starts, ties, nulls, one that holds a third of all rows, and many equal ones."""
    r = random.Random(seed)
    rows = []
    for conv in [*range(-120, 130), 1000, 1001, 5000]:
        for turn in range(r.choice([1, 2, 3, 4, 6, 7, 9, 14])):
            text = r.choice(["x", "yy", None, "zzz"]) if r.random() < 0.4 else "same"
            rows.append((conv, r.choice([turn, turn, turn, None, 2]), r.choice(["user", None, "a"]) if turn < 2 else "u", text))
    rows += [(77, turn, "u", "same") for turn in range(len(rows) // 2)]
    rows += [(conv, turn, "user", "copied") for conv in range(10_000, 10_060) for turn in range(8)]
    return rows + [(None, 1, "a", "b"), rows[0], rows[0]]


@pytest.mark.parametrize(("segment", "size"), [(32, 50_000), (3, 50_000), (3, 40), (32, 15)])
def test_trie_equals_brute_force(spark, monkeypatch, segment, size):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "RANGE", size)
    rows = talks(segment + size)
    found = prefix_trie.digest(spark.createDataFrame(rows, TURNS).repartition(3))
    assert sorted(map(tuple, found.collect()), key=str) == trie_by_hand(rows)


def test_trie_turnless_and_clashing_names(spark):
    # Conversation 100 + c takes h turns from 100 and none of its own when it has no more than h.
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(short, 0, "user", "gone")]
    df = spark.createDataFrame(rows, TURNS).withColumns({"conv": F.lit(1), "hash": F.lit("x"), "key": F.lit(2), "s": F.lit(3)})
    assert [tuple(r) for r in prefix_trie.digest(df).collect()] == trie_by_hand(rows)
    assert prefix_trie.digest(df.limit(0)).collect() == []


def test_sparse_minimum():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 8, 9, 100):
        values = r.integers(0, 5, n)
        table = prefix_trie.Sparse(values)
        at = np.arange(n)
        for bar in range(6):
            bars = np.full(n, bar)
            right = [max([e for e in range(i, n) if (values[i + 1 : e + 1] >= bar).all()]) for i in range(n)]
            left = [min([b for b in range(i + 1) if (values[b + 1 : i + 1] >= bar).all()]) for i in range(n)]
            assert table.right(at, bars).tolist() == right
            assert table.left(at, bars).tolist() == left
        assert (table.least(at, np.full(n, n - 1)) == [values[i:].min() for i in range(n)]).all()


# --- token files ------------------------------------------------------------


def test_code_lengths_are_best_and_limited():
    r = np.random.default_rng(2)
    for _ in range(50):
        counts = r.integers(0, 60, r.integers(2, 40))
        if (counts > 0).sum() < 2:
            continue
        free, tight = huffman.lengths(counts, 24), huffman.lengths(counts, 6)
        weights, cost = sorted(counts[counts > 0].tolist()), 0
        while len(weights) > 1:
            cost += weights[0] + weights[1]
            weights = sorted([weights[0] + weights[1], *weights[2:]])
        assert int((free * counts).sum()) == cost
        assert tight.max() <= 6 and math.isclose(sum(2.0 ** -int(b) for b in tight if b), 1)
    assert huffman.lengths(np.array([0, 5, 0]), 4).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        huffman.lengths(np.ones(5, int), 2)


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_blocks_unpack_on_their_own(monkeypatch, piece):
    monkeypatch.setattr(huffman, "PIECE", piece)
    r = np.random.default_rng(3)
    ids = (r.zipf(1.4, 6000) - 1) % 400
    totals = np.array([1, 15, 16, 17, 0, 3000, 1, 2950])
    code = huffman.Code(huffman.lengths(np.bincount(ids, minlength=400), 11))
    at = 0
    for (bits, offsets), n in zip(code.pack(ids, totals, 16), totals.tolist()):
        counts = np.array([min(16, n - first) for first in range(0, n, 16)], np.int64)
        assert (code.unpack(bits, offsets, counts) == ids[at : at + n]).all()
        for k in range(0, len(offsets), 7):
            assert (code.unpack(bits, offsets[k : k + 1], counts[k : k + 1]) == ids[at + 16 * k : at + 16 * k + counts[k]]).all()
        at += n


TEXTS = [
    "The cat's sat, on\tthe mat-and so\non; it's 12.5% <|endoftext|> x", "", None, "ÉTÉ İstanbul naïve ≠ ≠ áb a, 'S don't,'s ''ll",
    "<|startoftext|>", "a" * 3000 + " " + "word " * 5000, "    x y\u0085z ", "中文 字 \U0001f600 ok", "A1,b2'c3\"d'RE",
]


def files_by_hand(rows):
    tokenizer, start, out = Tokenizer.from_file(WORDS), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_tokenizer(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME", 900)
    monkeypatch.setattr(token_files, "FRAMES", 2)
    monkeypatch.setattr(token_files, "TEXT_BYTES", 5000)
    monkeypatch.setattr(token_files, "RANGE_BYTES", 4000)
    rows = [(3 * i - 4, t) for i, t in enumerate(TEXTS * 4)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"doc": F.lit(1), "part": F.lit("x")})
    found = token_files.digest(df, WORDS, 2).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == files_by_hand(rows)


def test_pieces_equal_whole_texts():
    r, tokenizer = random.Random(9), Tokenizer.from_file(WORDS)
    letters = "aAbZzéÉüßÿÀÖñç" + "İŒŸſ" + "'’.,-<>=|:;!?\"#0129²½ª" + "\u0338\u0301\u00a0\u0085中Σσ\U0001f600"
    texts = ["".join(r.choice(letters + "  \n\t") for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += [chr(c) + "a" + chr(c) + "." + chr(c) for c in range(1, 0x250)]
    pieces = token_files.Pieces(WORDS)
    assert pieces.cut
    raw = [t.encode() for t in texts]
    ids, totals = pieces.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 2)
    found = np.split(ids, np.cumsum(totals)[:-1])
    for text, own in zip(texts, found):
        assert own.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_token_files_with_a_third_of_rows_on_one_id(spark, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 2000)
    rows = [(7, "same text here")] * 200 + [(7, "another")] * 30 + [(i, f"text {i}") for i in range(300)]
    found = token_files.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORDS, 2).collect()
    assert len(found) == len(rows)
    places = sorted((r.start, r.n_tokens, r.doc_id) for r in found)
    assert all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(places, places[1:])) and places[0][0] == 0
    assert sorted(r.ids_crc32 for r in found) == sorted(r[3] for r in files_by_hand(rows))


def test_token_files_of_an_empty_table(spark):
    assert token_files.digest(spark.createDataFrame([], "doc_id long, text string"), WORDS, 2).collect() == []


def test_frames_of_another_code_are_refused():
    code = huffman.Code(np.array([1, 1]))
    bits, offsets = code.pack(np.array([0, 1]), np.array([2]), token_files.BLOCK)[0]
    frame = token_files._frame(code, 5, [(9, 2, bits, offsets.astype("<i8").tobytes())])
    first, docs, totals, ids = next(token_files.frames(frame + b"\n", code))
    assert (first, docs.tolist(), totals.tolist(), ids.tolist()) == (5, [9], [2], [0, 1])
    with pytest.raises(ValueError):
        next(token_files.frames(frame, huffman.Code(np.array([2, 2, 2, 2]))))


# --- whitening --------------------------------------------------------------


def whitened_by_hand(rows):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([np.floor(256 * np.array(v, np.float64)).astype(np.int64) for _, v in kept])
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    centred = distinct - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    deviation = ((n * x - sums) ** 2).sum(1)
    return [i for i, _ in kept], n, deviation, (x - sums / n) @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check_whitened(found, rows):
    ids, n, deviation, whitened, explained = whitened_by_hand(rows)
    frame = found.toPandas()
    assert len(frame) == 4 * len(ids) and (frame.n == n).all() and frame.identity_error.max() < 1e-9
    for k in range(4):
        part = frame[frame.component == k + 1].sort_values(["vec_id", "whitened"])
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        assert part.vec_id.tolist() == [ids[i] for i in order]
        assert part.deviation.tolist() == deviation[order].tolist()
        assert np.allclose(part.explained, explained[k], rtol=1e-9)
        sign = np.sign((part.whitened.to_numpy() * whitened[order, k]).sum())
        assert np.abs(np.sort(part.whitened.to_numpy()) - np.sort(sign * whitened[order, k])).max() < 1e-8


def test_whitening_equals_eigenvectors(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    check_whitened(queries.QUERIES["op13_embedding_whitening"](spark, SMALL), [(r.vec_id, r.embedding) for r in df.collect()])


def test_whitening_counts_copies_once_and_drops_odd_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=6) * [9, 5, 3, 2, 1, 1]]) for i in range(200)]
    hot = [(1000 + i, rows[0][1]) for i in range(150)]
    odd = [(2000, None), (2001, [1.0] * 5 + [None]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, []), (2005, [1.0] * 3)]
    df = spark.createDataFrame(rows + hot + odd, "vec_id long, embedding array<double>").repartition(3)
    check_whitened(whitening.whiten(df.withColumns({"x": F.lit(1), "n": F.lit("a"), "block": F.lit(0)})), rows + hot)


def test_whitening_finds_equal_eigenvalues_and_low_rank(spark):
    corners = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack([np.eye(5), -np.eye(5)]))]
    found = whitening.whiten(spark.createDataFrame(corners, "vec_id long, embedding array<double>")).toPandas()
    assert sorted(found.component.unique()) == [1, 2, 3, 4] and np.allclose(found.explained, 0.2) and found.identity_error.max() < 1e-9
    line = [(i, [float(i), 0.0, 2.0 * i]) for i in range(5)]
    found = whitening.whiten(spark.createDataFrame(line, "vec_id long, embedding array<double>")).toPandas()
    assert found.component.unique().tolist() == [1] and np.allclose(found.explained, 1)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_whitening_without_variance(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() == []


def test_deviation_beyond_a_long():
    x = np.array([[1 << 40, -(1 << 40)], [0, 0]], np.int64)
    assert whitening.deviations(x, 1 << 20, [0, 0]) == [2 << 120, 0]
