"""Backup manifests: JSON of stanzas and their backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANIFEST = "array<struct<name:string,backup:array<struct<label:string,error:boolean,timestamp:struct<stop:bigint>,size:bigint>>>>"


def latest(manifests: DataFrame, column: str) -> DataFrame:
    """(stanza, backup, stop, size) of each stanza's newest backup without error. Times under 1e11 are seconds, else milliseconds."""
    rows = manifests.select(F.explode(F.from_json(column, MANIFEST)).alias("s")).select(F.col("s.name").alias("stanza"), F.explode("s.backup").alias("b"))
    stop = F.col("b.timestamp.stop")
    seconds = F.when(stop < 100_000_000_000, stop).otherwise((stop / 1000).cast("bigint"))
    good = rows.filter(~F.coalesce("b.error", F.lit(False))).select("stanza", F.col("b.label").alias("backup"), F.timestamp_seconds(seconds).alias("stop"), F.col("b.size").alias("size"))
    newest = F.struct("stop", F.col("backup").try_cast("bigint").alias("n"), "backup")
    return good.groupBy("stanza").agg(F.max_by(F.struct("backup", "stop", "size"), newest).alias("m")).select("stanza", "m.*")


def recovery_point(backups: DataFrame, now: Column, hours: int) -> DataFrame:
    """Adds the age of the backup in whole hours and whether it lies within the recovery point objective."""
    age = F.unix_timestamp(now) - F.unix_timestamp("stop")
    return backups.withColumn("age_hours", F.floor(age / 3600).cast("bigint")).withColumn("within_rpo", age <= hours * 3600)
