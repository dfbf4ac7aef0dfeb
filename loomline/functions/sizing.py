"""Broadcast hints behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most `rows` rows; no more than one row beyond is counted."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else df itself, so that Spark shuffles."""
    return F.broadcast(df) if is_small(df, rows) else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where it has fewer partitions than those or is read in so few that some hold no rows (a small file of one row group); else as it is, so large tables are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df
