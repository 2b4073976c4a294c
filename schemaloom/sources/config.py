"""Rule settings from a JSON file: {"rules": {...}, "ignore": [...], "pgVersion": n}; unknown keys are left out."""

from __future__ import annotations

from pyspark.sql import SparkSession


def read_config(spark: SparkSession, path: str) -> dict:
    rows = spark.read.option("multiLine", True).schema("rules map<string,string>, ignore array<string>, pgVersion int").json(path).take(1)
    if not rows:
        return {"rules": {}, "ignore": (), "pg_version": 16}
    return {"rules": dict(rows[0].rules or {}), "ignore": tuple(rows[0].ignore or ()), "pg_version": rows[0].pgVersion or 16}
