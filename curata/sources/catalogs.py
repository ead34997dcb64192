"""Id catalogues, cluster tables and logs from text, TSV and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.text import ENTRY_ID, full_match
from curata.schema import CLUSTERS, INDEX, PROFILE_LOG, STAGE_LOG


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``rep, member`` from a two-column TSV."""
    return spark.read.csv(path, sep="\t", schema=CLUSTERS, quote="")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Index rows from a JSON-lines checkpoint."""
    return spark.read.schema(INDEX).option("allowNonNumericNumbers", True).json(path)


def read_stage_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAGE_LOG).json(path)


def read_profile_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_LOG).json(path)


def search_ids(texts: DataFrame, column: str = "value") -> DataFrame:
    """Distinct lower-case ids from search results ``{"result_set": [{"identifier": …}]}``."""
    hits = F.from_json(column, "result_set array<struct<identifier: string>>")["result_set"]["identifier"]
    return texts.select(F.explode(hits).alias("pdb")).select(F.lower("pdb").alias("pdb")).distinct()


def holdings_ids(texts: DataFrame, column: str = "value") -> DataFrame:
    """Distinct lower-case ids from holdings, whose keys are the ids."""
    keys = F.json_object_keys(column)
    return texts.select(F.explode(keys).alias("pdb")).select(F.lower("pdb").alias("pdb")).distinct()


def listing_names(lines: DataFrame, pattern: str = ENTRY_ID, column: str = "value") -> DataFrame:
    """Directory names in a listing whose last field fully matches ``pattern``."""
    name = F.element_at(F.split(F.btrim(column), r"\s+"), -1)
    return (
        lines.filter(F.col(column).startswith("d"))
        .select(name.alias("pdb"))
        .filter(full_match("pdb", pattern))
        .distinct()
    )
