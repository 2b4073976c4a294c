"""Schema differences: live against target, and tenants against the consensus of the fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff_columns(live: DataFrame, target: DataFrame) -> DataFrame:
    """(table_name, column_name, change, risk) of columns that differ.

    Columns of both inputs: table_name, column_name, data_type, is_not_null, default_expr. One full outer join by key.
    """
    keys = ["table_name", "column_name"]
    both = live.withColumn("l", F.lit(True)).alias("live").join(target.withColumn("t", F.lit(True)).alias("target"), keys, "full_outer")
    missing, extra = F.col("l").isNull(), F.col("t").isNull()
    unsafe_new = missing & F.col("target.is_not_null") & F.col("target.default_expr").isNull()
    retyped = F.col("live.data_type") != F.col("target.data_type")
    renulled = F.col("live.is_not_null") != F.col("target.is_not_null")
    change = F.when(unsafe_new, "unsafe").when(missing, "missing").when(extra, "extra").when(retyped, "unsafe").when(renulled, "changed")
    risk = F.when(unsafe_new, "BLOCKER").when(missing, "WARNING").when(extra, "SAFE").when(retyped, "BLOCKER").when(renulled, "WARNING")
    return both.select(*keys, change.alias("change"), risk.alias("risk")).filter("change IS NOT NULL")


def diff_tables(live: DataFrame, target: DataFrame) -> DataFrame:
    both = live.select("table_name").distinct().withColumn("l", F.lit(1)).join(target.select("table_name").distinct().withColumn("t", F.lit(1)), "table_name", "full_outer")
    return both.filter("l IS NULL OR t IS NULL").select("table_name", F.when(F.col("l").isNull(), "missing").otherwise("extra").alias("change"), F.lit("WARNING").alias("risk"))


def diff_indexes(live: DataFrame, target: DataFrame) -> DataFrame:
    """Indexes: key index_name; is_valid of the live one, is_concurrent of the target's statement."""
    both = live.withColumn("l", F.lit(1)).join(target.withColumn("t", F.lit(1)), "index_name", "full_outer")
    missing, extra, blocking = F.col("l").isNull(), F.col("t").isNull(), ~F.coalesce("is_concurrent", F.lit(True))
    change = F.when(missing & blocking, "unsafe").when(missing, "missing").when(extra, "extra").when(~F.col("is_valid"), "unsafe")
    risk = F.when(missing & blocking, "BLOCKER").when(missing, "WARNING").when(extra, "SAFE").when(~F.col("is_valid"), "BLOCKER")
    return both.select("index_name", change.alias("change"), risk.alias("risk")).filter("change IS NOT NULL")


def diff_constraints(live: DataFrame, target: DataFrame) -> DataFrame:
    """Constraints: key constraint_name; is_validated on both sides. Extra ones are not reported."""
    both = target.select("constraint_name", F.col("is_validated").alias("wanted")).join(live.select("constraint_name", F.col("is_validated").alias("found"), F.lit(1).alias("l")), "constraint_name", "left")
    missing = F.col("l").isNull()
    change = F.when(missing & ~F.col("wanted"), "missing").when(missing, "unsafe").when(~F.col("found") & F.col("wanted"), "changed")
    risk = F.when(missing & ~F.col("wanted"), "SAFE").when(missing, "BLOCKER").when(~F.col("found") & F.col("wanted"), "WARNING")
    return both.select("constraint_name", change.alias("change"), risk.alias("risk")).filter("change IS NOT NULL")


def diff_enums(live: DataFrame, target: DataFrame) -> DataFrame:
    """Enums: key enum_name, labels as arrays; (enum_name, change, missing_labels)."""
    both = target.alias("target").join(live.withColumn("l", F.lit(1)).alias("live"), "enum_name", "left")
    lacks = F.array_except("target.labels", F.coalesce(F.col("live.labels"), F.array().cast("array<string>")))
    change = F.when(F.col("l").isNull(), "missing").when(F.size(lacks) > 0, "changed")
    return both.select("enum_name", change.alias("change"), lacks.alias("missing_labels")).filter("change IS NOT NULL")


def fingerprints(objects: DataFrame, attributes: list[str]) -> DataFrame:
    """(tenant, fingerprint, n_objects): a digest of a tenant's sorted objects, whatever their order in the input."""
    line = F.concat_ws("\x1f", *(F.coalesce(F.col(a).cast("string"), F.lit("\x1e")) for a in attributes))
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256)
    return objects.groupBy("tenant").agg(digest.alias("fingerprint"), F.count("*").alias("n_objects"))


def fleet(prints: DataFrame, order: Column) -> DataFrame:
    """Marks the golden fingerprint, the most frequent one, the first seen winning ties; and who drifts from it."""
    groups = prints.groupBy("fingerprint").agg(F.count("*").alias("n_tenants"), F.min(order).alias("first"))
    golden = groups.agg(F.max_by("fingerprint", F.struct("n_tenants", (-F.col("first")).alias("o"))).alias("golden"))
    return prints.join(groups.select("fingerprint", "n_tenants"), "fingerprint").join(F.broadcast(golden)).withColumn("is_drifted", F.col("fingerprint") != F.col("golden"))


def missing_objects(objects: DataFrame, golden: DataFrame, drifted: DataFrame, key: list[str]) -> DataFrame:
    """(tenant, *key) that the golden schema has and the tenant lacks. Only tenants of ``drifted``, whose fingerprint differs, are compared: the
    expected pairs of these without those present."""
    expected = drifted.select("tenant").distinct().crossJoin(golden.select(*key).distinct())  # one schema's objects for each tenant that differs
    return expected.join(objects.select("tenant", *key), ["tenant", *key], "left_anti")


def extra_objects(objects: DataFrame, golden: DataFrame, drifted: DataFrame, key: list[str]) -> DataFrame:
    """(tenant, *key) that a drifted tenant has and the golden schema lacks."""
    return objects.join(drifted.select("tenant").distinct(), "tenant", "left_semi").select("tenant", *key).join(golden.select(*key).distinct(), key, "left_anti").select("tenant", *key)


def reconciliation(missing: DataFrame) -> DataFrame:
    """(tenant, script): statements that give each tenant what it lacks, from rows (tenant, kind, table_name, name, definition):
    columns first, then indexes built concurrently, then constraints that are validated afterwards."""
    rank = F.when(F.col("kind") == "column", 1).when(F.col("kind") == "index", 2).otherwise(3)
    table = F.concat(F.lit('"'), "tenant", F.lit('"."'), "table_name", F.lit('"'))
    column = F.concat(F.lit("ALTER TABLE "), table, F.lit(" ADD COLUMN IF NOT EXISTS "), "name", F.lit(" "), "definition", F.lit(";"))
    index = F.concat(F.regexp_replace("definition", "(?i)INDEX (CONCURRENTLY )?", "INDEX CONCURRENTLY "), F.lit(";"))
    constraint = F.concat(F.lit("ALTER TABLE "), table, F.lit(" ADD CONSTRAINT "), "name", F.lit(" "), "definition", F.lit(" NOT VALID;\nALTER TABLE "), table, F.lit(" VALIDATE CONSTRAINT "), "name", F.lit(";"))
    text = F.when(F.col("kind") == "column", column).when(F.col("kind") == "index", index).otherwise(constraint)
    lines = missing.select(F.col("tenant").cast("string").alias("tenant"), "kind", "table_name", "name", "definition").select("tenant", F.struct(rank.alias("r"), "table_name", "name", text.alias("t")).alias("l"))
    return lines.groupBy("tenant").agg(F.array_join(F.sort_array(F.collect_list("l"))["t"], "\n").alias("script"))
