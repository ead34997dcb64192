"""A training corpus from ``documents``: five stages, each written and read again.

A stage takes the session, the documents its predecessor kept, and the folder
of the tables, and returns a table.  All but the last return the columns of
``documents``.

Every stage takes null ids and texts, empty and very long texts, repeated rows,
other columns of any name, and an empty table.  A null or empty text is
neither toxic, nor a copy, nor contaminated; it stays and has no ids.  Of
repeated rows with words, one stays after the near-dedup stage; rows without
an id are told apart by their texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curata.llm import byte_bpe, decontaminate, minhash_dedup, suffix_dedup, toxicity
from curata.llm.tables import read, settle

#: Documents are large rows: so many in an Arrow batch at most.
BATCH_ROWS = 500


def _modest(spark: SparkSession) -> None:
    """Smaller Arrow batches for the rest of the session; they change no result."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from the labels of this input."""
    _modest(spark)
    model = toxicity.fit(docs, read(spark, folder, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that with the smallest doc_id; a null one is last."""
    _modest(spark)
    return minhash_dedup.one_row_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Bytes of repeats leave the text; a character that lost some of its bytes goes with them."""
    _modest(spark)
    return suffix_dedup.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a benchmark window go."""
    _modest(spark)
    return decontaminate.clean_documents(docs, read(spark, folder, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Ids of every text, their count, and checksums of the ids and of what they decode to."""
    _modest(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_level_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one staged in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier is the first stage, which SQL cannot express.
ORACLE_SQL = None
