"""Byte-level BPE: a sentencepiece model written out from a rank file, and its inverse.

The rank file lists byte strings and ranks.  Each byte is mapped to a printable
character, each string becomes a piece whose score is its negative rank, and
the model is told to normalise nothing.  Sentencepiece then merges the
neighbours with the highest score first, which is the lowest rank.  Texts are
cut by the tokenizer's pattern and each match is encoded on its own; a match
that is a piece itself is that piece.  Decoding joins the byte strings of the
ids.

Every task keeps the ids of matches it has seen (at most ``CACHE`` of them,
then it starts anew); only new matches reach sentencepiece.

Nulls: a null text is an empty one and has no ids.  Every row gives one row,
equal rows too; null ids stay null; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import record
from curata.llm.tables import whole_text

CACHE = 400_000
PIECE, UNKNOWN, BPE = 1, 2, 2


def ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in order of rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    table = {int(rank): base64.b64decode(piece) for piece, rank in pairs}
    if sorted(table) != list(range(len(table))):
        raise ValueError("ranks must be 0 to n - 1")
    return [table[i] for i in range(len(table))]


def byte_letters() -> list[str]:
    """A visible character for each byte value; none is white space or sentencepiece's own mark."""
    return [chr(0x100 + b) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model(vocabulary: list[bytes]) -> bytes:
    """The serialised model: pieces (1), trainer settings (2), normaliser settings (3).

    Fixed field numbers of the public model format: piece 1, score 2, type 3;
    model type 3, unknown, begin, end and padding ids 40 to 43; normaliser name
    1, dummy prefix 3, extra white space 4, escaped white space 5.
    """
    letters = byte_letters()
    out = []
    for rank, piece in enumerate(vocabulary):
        text = "".join(letters[b] for b in piece).encode()
        out.append(_bytes(1, _bytes(1, text) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, PIECE)))
    out.append(_bytes(1, _bytes(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, UNKNOWN)))
    trainer = _number(3, BPE) + _number(4, len(vocabulary) + 1) + _number(40, len(vocabulary))
    trainer += b"".join(_number(f, -1) for f in (41, 42, 43))
    out.append(_bytes(2, trainer))
    out.append(_bytes(3, _bytes(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))))
    return b"".join(out)


class Codec:
    """Encode and decode whole texts with one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.vocabulary = ranks(path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model(self.vocabulary))
        self.matches = regex.compile(pattern).findall
        letters = byte_letters()
        self.mapped = {b: letters[b] for b in range(256)}
        self.whole = {piece: struct.pack("<I", i) for i, piece in enumerate(self.vocabulary)}
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        cut = [self.matches(t) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        new = [m for m in set().union(*cut) if m not in self.known]
        rest = []
        for match in new:
            whole = self.whole.get(match.encode())
            if whole is None:
                rest.append(match)
            else:
                self.known[match] = whole
        spelled = ["".join(map(self.mapped.__getitem__, m.encode())) for m in rest]
        for match, ids in zip(rest, self.pieces.encode(spelled, num_threads=1)):
            self.known[match] = np.array(ids, "<u4").tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, m)) for m in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _groups(texts: pa.Array, limit: int = 1 << 21):
    """Runs of texts of about ``limit`` bytes."""
    group, size = [], 0
    for text in texts:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded``: ids as little-endian integers, and the bytes they decode to."""
    fields = [("ids", pa.binary()), ("decoded", pa.binary())]

    def run(batches):
        codec = Codec(path, pattern)
        for batch in batches:
            done = 0
            for group in _groups(batch.column("text")):
                ids = codec.encode(group)
                schema = pa.schema([batch.schema.field("doc_id"), *fields])
                yield record(
                    schema, batch.column("doc_id")[done : done + len(group)], ids, [codec.decode(i) for i in ids]
                )
                done += len(group)

    rows = docs.select("doc_id", whole_text().alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The registered form, with the checksums made where the ids are."""
    def run(batches):
        codec = Codec(path, pattern)
        for batch in batches:
            done = 0
            for group in _groups(batch.column("text")):
                ids = codec.encode(group)
                schema = pa.schema(
                    [batch.schema.field("doc_id"), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
                )
                yield record(
                    schema,
                    batch.column("doc_id")[done : done + len(group)],
                    [len(i) // 4 for i in ids],
                    [hashlib.sha256(i).hexdigest() for i in ids],
                    [hashlib.sha256(codec.decode(i)).hexdigest() for i in ids],
                )
                done += len(group)

    rows = docs.select("doc_id", whole_text().alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
