"""Append-only logs of events with JSON details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(events: DataFrame, path: str) -> None:
    """Adds rows (at, kind, details) to a log."""
    events.select("at", "kind", "details").write.mode("append").parquet(path)


def newest(spark: SparkSession, path: str, kind: str | None = None, n: int = 20) -> DataFrame:
    """The newest ``n`` rows, of one kind or of all."""
    rows = spark.read.parquet(path)
    return (rows.filter(F.col("kind") == kind) if kind else rows).orderBy(F.desc("at"), "kind", "details").limit(n)
