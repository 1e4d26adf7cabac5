"""Rows of a scan that has fewer partitions than the session has cores."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame


def scanned_partitions(df: DataFrame) -> int | None:
    """The partitions of a plain scan of files, by planning alone; None for any other plan, as one that joins, and over Spark Connect."""
    if df.isStreaming or not hasattr(df, "_jdf"):
        return None
    plan = df._jdf.queryExecution().sparkPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if not plan.nodeName().startswith("Scan "):
        return None
    try:
        return plan.inputRDDs().head().getNumPartitions()
    except Py4JError:  # a scan that doesn't say
        return None


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt out to all cores where one small file would keep most of them idle. A scan with a partition for each
    core stays as it is, so nothing moves where there is much to do. No result depends on it."""
    cores = df.sparkSession.sparkContext.defaultParallelism if hasattr(df, "_jdf") else 0
    n = scanned_partitions(df)
    return df.repartition(cores) if n is not None and n < cores else df
