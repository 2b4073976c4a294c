"""Index advice: redundant, invalid and unused indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def redundant_indexes(indexes: DataFrame) -> DataFrame:
    """Indexes whose key columns are a proper prefix of another index of the same table and predicate.

    Columns: schema_name, table_name, index_name, ord, key_columns, predicate, is_unique, is_primary. Primary and unique
    indexes are never redundant. Of several longer indexes the first by ``ord`` is named. Each longer index is
    filed under all its prefixes, so the join is on equal keys and never compares all pairs of a table.
    """
    keys = [F.col("schema_name"), F.col("table_name"), F.coalesce("predicate", F.lit("")).alias("pred")]
    longer = (
        indexes.filter(F.size("key_columns") > 1)
        .select(*keys, F.col("index_name").alias("by"), F.col("ord").alias("by_ord"), "key_columns", F.explode(F.sequence(F.lit(1), F.size("key_columns") - 1)).alias("n"))
        .groupBy("schema_name", "table_name", "pred", F.slice("key_columns", 1, F.col("n")).alias("prefix"))
        .agg(F.min_by("by", "by_ord").alias("subsumed_by"))
    )
    plain = indexes.filter(~F.col("is_unique") & ~F.col("is_primary")).select(*keys, "index_name", F.col("key_columns").alias("prefix"))
    return plain.join(longer, ["schema_name", "table_name", "pred", "prefix"]).select("schema_name", "table_name", "index_name", "subsumed_by")


def prune_report(indexes: DataFrame, max_scans: int = 0, min_bytes: int = 0) -> DataFrame:
    """One row per index to drop, by the first reason that holds: INVALID, REDUNDANT, UNUSED.

    An unused index that backs a foreign key isn't safe to drop; a redundant one is, with a warning.
    """
    redundant = redundant_indexes(indexes).select("schema_name", "table_name", "index_name", "subsumed_by")
    rows = indexes.join(redundant, ["schema_name", "table_name", "index_name"], "left")
    unused = ~F.col("is_unique") & ~F.col("is_primary") & (F.col("scans") <= max_scans) & (F.col("size_bytes") >= min_bytes)
    reason = F.when(~F.col("is_valid"), "INVALID").when(F.col("subsumed_by").isNotNull(), "REDUNDANT").when(unused, "UNUSED")
    return (
        rows.withColumn("reason", reason).filter("reason IS NOT NULL")
        .withColumn("rank", F.row_number().over(W.partitionBy("schema_name", "table_name", "index_name").orderBy("ord"))).filter("rank = 1")
        .select(
            "schema_name", "table_name", "index_name", "reason", F.when(F.col("reason") == "REDUNDANT", F.col("subsumed_by")).alias("subsumed_by"), "size_bytes", "scans",
            (~((F.col("reason") == "UNUSED") & F.col("is_fk_backing"))).alias("is_safe"),
            F.concat(F.lit('DROP INDEX CONCURRENTLY IF EXISTS "'), "schema_name", F.lit('"."'), "index_name", F.lit('";')).alias("drop_sql"),
        )
    )
