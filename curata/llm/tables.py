"""Reading, staging and keying that the operators share."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm.kernels import record
from curata.session import stage

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows without a doc_id stand below this number, before every other one.
NULL_ID = -(1 << 63)
NULL_IDS = NULL_ID + (1 << 55)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Stage a table in the shared folder and let go of the shuffle files behind it."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return stage(df, label)
    finally:
        conf.set(CLEANUP, before)


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keys() -> tuple[Column, Column]:
    """The id and 28 bits of the text's crc32; for a null id, 55 bits of another hash from the smallest number on."""
    without = F.xxhash64(whole_text()).bitwiseAND(F.lit((1 << 55) - 1)) + F.lit(NULL_ID)
    return (
        F.coalesce(F.col("doc_id").cast("long"), without),
        F.crc32(whole_text().cast("binary")).bitwiseAND(F.lit((1 << 28) - 1)),
    )


def identified(docs: DataFrame) -> DataFrame:
    """``_doc, _tag, text``: see ``keys``.

    The pair tells rows apart that repeat a doc_id with another text (by 28
    bits) or have none (by 83); equal rows share it and get equal results.
    """
    doc, tag = keys()
    return docs.select(doc.alias("_doc"), tag.alias("_tag"), whole_text().alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """``identified`` with the text compressed, for the shuffles that must move texts."""
    schema = pa.schema([("_doc", pa.int64()), ("_tag", pa.int64()), ("packed", pa.binary())])

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1, write_checksum=False)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for first in range(0, batch.num_rows, 512):
                part = slice(first, first + 512)
                yield record(
                    schema,
                    batch.column("_doc")[part],
                    batch.column("_tag")[part],
                    [press.compress(x.as_py()) for x in texts[part]],
                )

    return identified(docs).mapInArrow(pack, "_doc long, _tag long, packed binary")


def unpacked(batches):
    """Arrow batches with ``packed`` as a binary ``text`` again, a few megabytes at a time."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        names = [n for n in batch.schema.names if n != "packed"]
        column, first, texts, size = batch.column("packed"), 0, [], 0
        for i in range(batch.num_rows):
            texts.append(press.decompress(column[i].as_py()))
            size += len(texts[-1])
            if size >= 1 << 22 or i + 1 == batch.num_rows:
                part = batch.slice(first, i + 1 - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names] + [pa.array(texts, pa.large_binary())], names + ["text"]
                )
                first, texts, size = i + 1, [], 0
