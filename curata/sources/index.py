"""Read index tables with checked columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from curata.schema import CLUSTER_METHODS, INDEX, check_cluster_column, check_columns


def read_index(
    spark: SparkSession, path: str, cluster_col: str, split_cols=(), methods=CLUSTER_METHODS
) -> DataFrame:
    """The index with its core columns and the wanted cluster columns.

    Names are checked against the file schema before any job runs; filters and
    the column list reach the Parquet scan.
    """
    cluster_cols = list(dict.fromkeys([cluster_col, *split_cols]))
    for c in cluster_cols:
        check_cluster_column(c, methods)
    if split_cols and cluster_col not in split_cols:
        raise ValueError(f"{cluster_col!r} must be one of the split columns {list(split_cols)}")
    df = spark.read.parquet(path)
    check_columns(df, [*INDEX.names, *cluster_cols])
    return df.select(*INDEX.names, *cluster_cols)
