"""Catalog snapshots: the server's catalog tables, saved as frames, joined to columns, indexes, constraints and enums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Schemas of the server itself.
SYSTEM = ("pg_catalog", "information_schema", "pg_toast")


def _relations(namespaces: DataFrame, relations: DataFrame) -> DataFrame:
    """(oid, schema_name, table_name, kind) outside the system's schemas."""
    n = namespaces.filter(~F.col("nspname").isin(*SYSTEM)).select(F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema_name"))
    return relations.join(n, "relnamespace").select("oid", "schema_name", F.col("relname").alias("table_name"), F.col("relkind").alias("kind"))


def columns(namespaces: DataFrame, relations: DataFrame, attributes: DataFrame, defaults: DataFrame) -> DataFrame:
    """Live columns of tables and partitioned tables, with their defaults."""
    r = _relations(namespaces, relations).filter(F.col("kind").isin("r", "p"))
    a = attributes.filter((F.col("attnum") > 0) & ~F.col("attisdropped")).withColumnRenamed("attrelid", "oid")
    d = defaults.select(F.col("adrelid").alias("oid"), F.col("adnum").alias("attnum"), F.col("adbin").alias("default_expr"))
    return r.join(a, "oid").join(d, ["oid", "attnum"], "left").select(
        "schema_name", "table_name", F.col("attname").alias("column_name"), F.col("attnum").alias("column_num"), F.col("atttype").alias("data_type"), F.col("attnotnull").alias("is_not_null"), "default_expr"
    )


def index_columns(namespaces: DataFrame, relations: DataFrame, indexes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(schema_name, table_name, index_oid, key_columns): key numbers looked up one by one and put back in order."""
    r = _relations(namespaces, relations)
    keys = indexes.select(F.col("indrelid").alias("oid"), F.col("indexrelid").alias("index_oid"), F.posexplode("indkey").alias("pos", "attnum"))
    a = attributes.select(F.col("attrelid").alias("oid"), "attnum", "attname")
    named = keys.join(a, ["oid", "attnum"]).groupBy("oid", "index_oid").agg(F.sort_array(F.collect_list(F.struct("pos", "attname")))["attname"].alias("key_columns"))
    return r.join(named, "oid").select("schema_name", "table_name", "index_oid", "key_columns")


def constraints(namespaces: DataFrame, relations: DataFrame, found: DataFrame) -> DataFrame:
    """(schema_name, table_name, constraint_name, kind, is_validated, definition, foreign_schema, foreign_table) of the constraints of
    tables and partitioned tables; the last two for foreign keys."""
    r = _relations(namespaces, relations)
    c = found.filter(F.col("contype").isin("p", "u", "c", "f", "x"))
    other = r.select(F.col("oid").alias("confrelid"), F.col("schema_name").alias("foreign_schema"), F.col("table_name").alias("foreign_table"))
    return r.filter(F.col("kind").isin("r", "p")).drop("kind").join(c.withColumnRenamed("conrelid", "oid"), "oid").join(other, "confrelid", "left").select(
        "schema_name", "table_name", F.col("conname").alias("constraint_name"), F.col("contype").alias("kind"), F.col("convalidated").alias("is_validated"), F.col("definition"), "foreign_schema", "foreign_table"
    )


def enums(types: DataFrame, labels: DataFrame) -> DataFrame:
    """(enum_name, labels) in sort order."""
    ordered = labels.groupBy(F.col("enumtypid").alias("oid")).agg(F.sort_array(F.collect_list(F.struct("enumsortorder", "enumlabel")))["enumlabel"].alias("labels"))
    return types.join(ordered, "oid").select(F.col("typname").alias("enum_name"), "labels")


def tenants(namespaces: DataFrame, include: str = "*", ignore: tuple[str, ...] = ()) -> DataFrame:
    """Tenant schemas: not the system's, matching ``include``, none of ``ignore``; globs without regard to case."""
    pattern = lambda glob: "(?i)^" + glob.replace(".", r"\.").replace("*", ".*").replace("?", ".") + "$"
    rows = namespaces.filter(~F.col("nspname").isin(*SYSTEM) & F.col("nspname").rlike(pattern(include)))
    for glob in ignore:
        rows = rows.filter(~F.col("nspname").rlike(pattern(glob)))
    return rows.select(F.col("nspname").alias("tenant"))


def wait_graph(activity: DataFrame, locks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (sessions that wait or are waited for) and edges (waiter, blocker) of activity rows with blocking_pids."""
    edges = activity.select(F.col("pid").alias("waiter"), F.explode("blocking_pids").alias("blocker")).filter("waiter <> blocker").distinct()
    there = edges.select(F.col("waiter").alias("pid")).union(edges.select("blocker")).distinct()
    return activity.drop("blocking_pids").join(there, "pid", "left_semi").join(locks, "pid", "left"), edges
