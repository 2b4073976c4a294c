"""Foreign keys as a graph: which columns hold the same values, and in what order tables can be copied or masked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.session import Rounds
from schemaloom.operators.locks import _spread, cycle_members


def alike(keys: DataFrame, rounds: int = 1_000) -> DataFrame:
    """(table_name, column_name, mask_group) of all columns in foreign keys (child, child_columns, parent, parent_columns): columns of one group hold the same values
    and must be masked alike. The group is its smallest ``table.column``. Composite keys tie their columns one by one. A table in the shared folder."""
    pairs = keys.select("child", "parent", F.explode(F.arrays_zip("child_columns", "parent_columns")).alias("c"))
    dotted = lambda table, column: F.concat_ws(".", table, column)
    ties = pairs.select(dotted("child", "c.child_columns").alias("source"), dotted("parent", "c.parent_columns").alias("target"))
    names = pairs.select(F.col("child").alias("table_name"), F.col("c.child_columns").alias("column_name")).union(pairs.select("parent", "c.parent_columns")).distinct()
    with Rounds(keys.sparkSession) as tables:
        both = tables.table(ties.union(ties.select("target", "source")).distinct())
        labels = _spread(both, names.select(dotted("table_name", "column_name").alias("pid")).withColumn("label", F.col("pid")), tables, rounds)
        named = names.withColumn("pid", dotted("table_name", "column_name"))
        return tables.keep(named.join(labels, "pid").select("table_name", "column_name", F.col("label").alias("mask_group")))


def layers(keys: DataFrame, rounds: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(tables, deferred). Tables: (table_name, layer), parents in lower layers than their children, so a layer can be worked on at once. Deferred: the foreign keys (child, parent) that
    lie on a cycle of tables, or lead from a table to itself; those are left out of the order and must be checked when all is done. Both are tables in
    the shared folder. A round for each layer."""
    edges = keys.select("child", "parent").distinct()
    members = cycle_members(edges.select(F.col("child").alias("waiter"), F.col("parent").alias("blocker")))
    at = lambda name: members.select(F.col("pid").alias(name), F.col("cycle").alias(f"{name}_cycle"))
    with Rounds(keys.sparkSession) as tables:
        tinted = tables.table(edges.join(at("child"), "child", "left").join(at("parent"), "parent", "left"))
        circular = F.coalesce((F.col("child") == F.col("parent")) | (F.col("child_cycle") == F.col("parent_cycle")), F.lit(False))
        deferred = tables.keep(tinted.filter(circular).select("child", "parent"))
        straight = tables.table(tinted.filter(~circular).select("child", "parent"))
        left = tables.table(edges.select(F.col("child").alias("table_name")).union(edges.select("parent")).distinct())
        done = None
        for layer in range(rounds):
            # a table is free once none of its parents is left
            waits = straight.join(left.select(F.col("table_name").alias("parent")), "parent", "left_semi").select(F.col("child").alias("table_name")).distinct()
            free = left.join(waits, "table_name", "left_anti").withColumn("layer", F.lit(layer))
            done = tables.table(free if done is None else done.unionByName(free))
            rest = tables.table(left.join(waits, "table_name", "left_semi"))
            tables.drop(left)
            left = rest
            if left.isEmpty():
                return tables.keep(done), deferred
        raise RuntimeError(f"tables not ordered in {rounds} rounds")
