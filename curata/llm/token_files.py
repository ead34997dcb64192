"""Token ids as binary files: Huffman-coded frames in the order of the documents.

Steps: encode every text once (a table staged in the shared folder), count
the ids of all of them, make one length-limited canonical code, pack each
document into bits, deal the documents into ranges of (doc_id, text hash), and
write each range as frames.  Ranges are cut at a sample of the keys, so that
one id with a third of all rows spreads over several; where rows are equal,
any of them may be first.

A folder of files holds ``code`` (Parquet: id, bits), ``parts`` (Parquet:
part, first, total) and ``frames``, binary files of frames one after another.
A frame (little endian; each ends with a byte 0x0A):

| bytes | content |
|---|---|
| 4, 4 | ``CTF1``; crc32 of the code's lengths |
| 8 x 6 | bytes of the frame without 0x0A; ids in all documents before it; documents; blocks; ids a block; bytes of the payload |
| 8 a document | doc_id (smallest long: null) |
| 8 a document | its ids |
| 8 a block | bit offset of the block in the payload |
| payload | the codes, first bit first; a document starts on a byte and with a block |

A frame holds whole documents, about ``FRAME`` ids; a longer document is a
frame of its own.  A file holds at most ``FRAMES`` frames.

Nulls: a null text is an empty one and has the end id alone; a null doc_id
sorts first.  Repeated rows are written once for each; rows of one id follow
the hash of their text.  A very long text is one row, one frame and a few
arrays of its length in the memory of one task.  An empty table gives a code
of the end id alone and no frames.  Other columns are ignored.  The name of a
special token in a text is that token, as the library has it.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm.huffman import Code, lengths
from curata.llm.kernels import NOT_BLANK, blocks, byte_table, lowered, record
from curata.llm.tables import NULL_ID, settle, whole_text
from curata.session import spread, staging_path

MAGIC = b"CTF1"
HEAD = struct.Struct("<4sI6Q")
FRAME, FRAMES, BLOCK, LIMIT = 1 << 20, 8, 256, 16
#: Bytes of text in a range, and sampled keys for each.
RANGE_BYTES, SAMPLES = 64 << 20, 40
#: Bytes of text encoded at a time, rows of an Arrow batch, and pieces remembered by a worker.
TEXT_BYTES, ROWS, PIECES = 2 << 20, 500, 300_000
#: ASCII letters, and ASCII signs that stand alone beside a letter (not the apostrophe, which may belong to it).
LETTER = byte_table((0x41, 0x5A), (0x61, 0x7A))
SIGN = byte_table((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of so many rows, for steps whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: How a tokenizer of the cut kind normalises, and what it takes as one unit before it merges.
NORMAL = ["NFC", "Replace", "Lowercase"]
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Letters whose lower case is one letter and which no normal form changes.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def byte_signs() -> list[str]:
    """The sign that byte-level models write for each byte: itself where it is visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class Pieces:
    """Encode texts piece by piece: each distinct piece meets the tokenizer once.

    Pieces end at ASCII white space, and where an ASCII letter meets an ASCII
    sign other than the apostrophe.  That holds for tokenizers which fold case, drop
    white space and split letters from signs before they merge (``NORMAL``,
    ``UNITS``); for any other a piece is a whole text.  A piece of Latin
    letters is one unit, so it goes to the merges at once.  Where a special
    token's name stands in the texts, pieces end at white space only.  At most
    ``PIECES`` are remembered; then the memory starts anew.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        normal = [part["type"] for part in (made["normalizer"] or {}).get("normalizers", [])]
        units = [part.get("pattern", {}).get("Regex") for part in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.cut = normal == NORMAL and units == [UNITS, None]
        self.signs = byte_signs()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def entries(self, pieces: list[bytes]) -> np.ndarray:
        """Where each piece stands in the memory; new ones are encoded."""
        if len(self.known) > PIECES:
            self.forget()
        merged, sign = self.tokenizer.model.tokenize, self.signs.__getitem__
        plain, other, texts, found = [], [], [], []
        for piece in pieces:
            if piece not in self.known:
                text = piece.decode()
                if self.cut and LETTERS.fullmatch(text):
                    text = text.lower()
                    spelled = text if text.isascii() else "".join(map(sign, text.encode()))
                    found.append([token.id for token in merged(spelled)])
                    plain.append(piece)
                else:
                    other.append(piece)
                    texts.append(text)
        for first in range(0, len(texts), 4096):
            part = texts[first : first + 4096]
            found.extend(one.ids for one in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))
        self.known.update(zip(plain + other, range(len(self.sizes), len(self.sizes) + len(found))))
        self.flat = np.concatenate([self.flat, np.array(list(chain.from_iterable(found)), np.uint32)])
        self.sizes = np.concatenate([self.sizes, np.array(list(map(len, found)), np.int64)])
        self.first = np.cumsum(self.sizes) - self.sizes
        return np.array(list(map(self.known.__getitem__, pieces)), np.int64)

    def encode(self, data: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a block, the end id after each, and the number of ids of each."""
        texts = len(ends) - 1
        inside = NOT_BLANK[data] if self.cut else np.ones(len(data), bool)
        start = inside.copy()
        border = ~inside[:-1]
        raw = data.tobytes()
        if self.cut and not any(name in raw for name in self.special):
            data = lowered(data)
            letter, sign = LETTER[data], SIGN[data]
            border |= letter[:-1] & sign[1:] | sign[:-1] & letter[1:]
        start[1:] &= border
        edges = ends[:-1][ends[:-1] < len(data)]
        start[edges] = inside[edges]
        begins = np.flatnonzero(start)
        owner = np.searchsorted(ends, begins, "right") - 1
        offsets = np.append((np.cumsum(inside) - 1)[begins], inside.sum()).astype(np.int64)
        bare = pa.py_buffer(np.ascontiguousarray(data[inside]))
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), bare])
        coded = array.dictionary_encode()
        own = self.entries(coded.dictionary.to_pylist())
        found = own[coded.indices.to_numpy(zero_copy_only=False)] if len(begins) else np.zeros(0, np.int64)
        width = self.sizes[found]
        after = np.cumsum(width)
        body = self.flat[np.arange(int(after[-1]) if len(after) else 0) + np.repeat(self.first[found] - (after - width), width)]
        pieces = np.bincount(owner, minlength=texts)
        until = np.concatenate([[0], after])[np.cumsum(pieces)]
        return np.insert(body, until, end_id), np.diff(until, prepend=0) + 1


_PIECES: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    """The worker's own, kept from task to task; what it remembers is bounded by ``PIECES``."""
    if path not in _PIECES:
        _PIECES.clear()
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _width(size: int) -> str:
    """Ids as bytes of two or four each."""
    return "<u2" if size <= 1 << 16 else "<u4"


def cuts(docs: DataFrame) -> list[tuple[int, int]]:
    """Keys (doc_id, text hash) between ranges: about one for every ``RANGE_BYTES`` of text.

    Only the balance of the ranges depends on the sample.
    """
    keys = docs.select(_doc(), _hash())
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(whole_text())), F.lit(0))).first()
    ranges = size // RANGE_BYTES + 1
    if ranges == 1:
        return []
    wanted = ranges * SAMPLES
    found = sorted(map(tuple, keys.sample(min(1.0, wanted / rows), seed=1).collect()))
    return [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []


def _doc():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc")


def _hash():
    return F.xxhash64(whole_text()).alias("hash")


def encode(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """``part, doc, hash, n, ids`` of every row, staged."""
    docs = spread(docs)
    splits = cuts(docs)
    schema = pa.schema([("part", pa.int32()), ("doc", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        pieces, row = _pieces(path), 0
        for block in blocks(batches, limit=TEXT_BYTES):
            ids, totals = pieces.encode(block.data, block.ends, end_id)
            after = np.cumsum(totals)
            parts = []
            for key in zip(block.rows.column("doc").to_pylist(), block.rows.column("hash").to_pylist()):
                low, high = bisect.bisect_left(splits, key), bisect.bisect_right(splits, key)
                parts.append(low + row % (high - low + 1))
                row += 1
            wire = ids.astype(kind)
            yield record(
                schema, parts, block.rows.column("doc"), block.rows.column("hash"), totals,
                [wire[b - n : b].tobytes() for b, n in zip(after.tolist(), totals.tolist())],
            )

    plain = docs.select(_doc(), _hash(), whole_text().alias("text"))
    with small_batches(docs.sparkSession, ROWS):
        return settle(plain.mapInArrow(run, "part int, doc long, hash long, n long, ids binary"), "token-ids")


def counts(ids: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id occurs: sums inside tasks, then one row an id.  At most ``size`` rows reach the driver."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            column = batch.column("ids").cast(pa.large_binary())
            for one in column:
                total += np.bincount(np.frombuffer(one.as_buffer(), kind), minlength=size)
        seen = np.flatnonzero(total)
        yield record(schema, seen, total[seen])

    out = np.zeros(size, np.int64)
    for row in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


def _frame(code: Code, first: int, held: list[tuple[int, int, bytes, bytes]]) -> bytes:
    """A frame of ``held`` documents: id, ids, bits, and offsets of their blocks."""
    sizes = np.array([len(bits) for _, _, bits, _ in held], np.int64)
    bases = 8 * (np.cumsum(sizes) - sizes)
    offsets = np.concatenate([np.frombuffer(o, "<i8") + base for (_, _, _, o), base in zip(held, bases)])
    size = HEAD.size + 16 * len(held) + 8 * len(offsets) + int(sizes.sum())
    return b"".join(
        (
            HEAD.pack(MAGIC, code.checksum(), size, first, len(held), len(offsets), BLOCK, int(sizes.sum())),
            np.array([doc for doc, _, _, _ in held], "<i8").tobytes(),
            np.array([n for _, n, _, _ in held], "<i8").tobytes(),
            offsets.astype("<i8").tobytes(),
            *[bits for _, _, bits, _ in held],
        )
    )


def frames(data, code: Code) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First id, doc_ids, numbers of ids, and ids of each frame of a file."""
    at, view = 0, memoryview(data)
    while at < len(view):
        magic, check, size, first, docs, marks, block, payload = HEAD.unpack_from(view, at)
        if magic != MAGIC or check != code.checksum():
            raise ValueError("not a frame of this code")
        numbers = np.frombuffer(view, "<i8", 2 * docs + marks, at + HEAD.size)
        totals = numbers[docs : 2 * docs]
        blocks = -(-totals // block)
        counts = np.full(marks, block, np.int64)
        counts[np.cumsum(blocks) - 1] = totals - (blocks - 1) * block
        bits = view[at + size - payload : at + size]
        yield first, numbers[:docs], totals, code.unpack(bits, numbers[2 * docs :], counts)
        at += size + 1


def write(docs: DataFrame, folder: str, path: str, end_id: int, limit: int = LIMIT) -> None:
    """Encode all texts and write them as files under ``folder``."""
    spark = docs.sparkSession
    size = max(_pieces(path).tokenizer.get_vocab_size(), end_id + 1)
    kind = _width(size)
    ids = encode(docs, path, end_id, kind)
    found = counts(ids, size, kind)
    found[end_id] = max(found[end_id], 1)
    code = Code(lengths(found, limit))
    # One row an id and one row a range: both are small whatever the texts are.
    table = spark.createDataFrame([(i, int(b)) for i, b in enumerate(code.bits) if b], "id long, bits int")
    table.coalesce(1).write.parquet(f"{folder}/code")
    first, bases = 0, []
    for row in ids.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        bases.append((row.part, first, row.n))
        first += row.n
    spark.createDataFrame(bases, "part int, first long, total long").coalesce(1).write.parquet(f"{folder}/parts")
    starts = {part: start for part, start, _ in bases}
    packed = "part int, doc long, hash long, n long, bits binary, offsets binary"
    schema = pa.schema([("part", pa.int32()), ("doc", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("offsets", pa.binary())])

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            totals = batch.column("n").to_numpy()
            flat = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in batch.column("ids")])
            done = code.pack(flat, totals, BLOCK)
            yield record(schema, *[batch.column(c) for c in ("part", "doc", "hash", "n")], [b for b, _ in done], [o.astype("<i8").tobytes() for _, o in done])

    def run(batches):
        held, part, at, size = [], None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                own, n = batch.column("part")[i].as_py(), batch.column("n")[i].as_py()
                if held and (own != part or size + n > FRAME):
                    yield record(pa.schema([("frame", pa.binary())]), [_frame(code, at, held)])
                    held, at, size = [], at + size, 0
                if own != part:
                    part, at = own, starts[own]
                held.append((batch.column("doc")[i].as_py(), n, batch.column("bits")[i].as_py(), batch.column("offsets")[i].as_py()))
                size += n
        if held:
            yield record(pa.schema([("frame", pa.binary())]), [_frame(code, at, held)])

    with small_batches(spark, ROWS):
        (
            ids.mapInArrow(pack, packed)
            .repartitionById(max(starts, default=0) + 1, F.col("part"))
            .sortWithinPartitions("part", "doc", "hash")
            .mapInArrow(run, "frame binary")
            .select(F.col("frame").cast("string"))
            .write.option("maxRecordsPerFile", FRAMES)
            .text(f"{folder}/frames")
        )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files; ``ids`` as 32-bit little endian.

    A row of the scan is a file; run it with ``small_batches`` of one row.
    """
    bits = {row.id: row.bits for row in spark.read.parquet(f"{folder}/code").collect()}
    table = np.zeros(max(bits) + 1, np.uint8)
    table[list(bits)] = list(bits.values())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        code = Code(table)
        for batch in batches:
            for file in batch.column("content"):
                for first, docs, totals, ids in frames(file.as_buffer(), code):
                    after = np.cumsum(totals)
                    wire = ids.astype("<u4")
                    yield record(
                        schema,
                        pa.array(docs, pa.int64(), mask=docs == NULL_ID),
                        first + after - totals,
                        totals,
                        [wire[b - n : b].tobytes() for b, n in zip(after.tolist(), totals.tolist())],
                    )

    files = spark.read.format("binaryFile").load(f"{folder}/frames").select("content")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write all documents, read the files back: place, number and crc32 of the ids of each, staged."""
    spark = docs.sparkSession
    folder = staging_path(spark, "token-files")
    write(docs, folder, path, end_id)
    with small_batches(spark, 1):
        rows = read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
        return settle(rows, "token-places")
