"""Ledgers of distributed runs, change logs, and copies in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from schemaloom.functions.session import Rounds


def latest(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; all other columns come with it. A partial aggregation, so hot keys do no harm."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("last")).select(*keys, "last.*")


def sweep(ledger: DataFrame, now: Column, minutes: int = 30, heal: bool = True) -> DataFrame:
    """(run_id, node_id, to_phase, committed, nodes) of PREPARED rows older than ``minutes``: HEALED if a strict majority of
    the run's nodes committed, else ABORTED."""
    fleet = ledger.groupBy("run_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("phase") == "COMMITTED").alias("committed"))
    stale = ledger.filter((F.col("phase") == "PREPARED") & (F.col("prepared_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")))
    to = F.when((F.col("committed") * 2 > F.col("nodes")) & F.lit(heal), "HEALED").otherwise("ABORTED")
    return stale.join(fleet, "run_id").select("run_id", "node_id", to.alias("to_phase"), "committed", "nodes")


def replay(base: DataFrame, log: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The table after its change log (id, op, key, values): the last change of a key wins, D deletes."""
    last = latest(log.select("id", "op", key, *values), [key], [F.col("id")])
    kept = base.join(last.select(key), key, "left_anti").select(key, *values)
    return kept.unionByName(last.filter("op <> 'D'").select(key, *values))


def populated(log: DataFrame, payload: str, schema: str) -> DataFrame:
    """A change log whose JSON payloads become columns of ``schema``; a key that is missing or of another type is null."""
    return log.select(*(c for c in log.columns if c != payload), F.from_json(payload, schema).alias("__p")).select("*", "__p.*").drop("__p")


def keyset_batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(batch, n, low, high): the batches that a copy in key order makes.

    Rows are numbered within key ranges, and each range gets the count of those before it, so no task sees all rows. A table in the shared folder.
    """
    with Rounds(rows.sparkSession) as tables:
        dealt = tables.table(rows.select(F.col(key).alias("k")).repartitionByRange("k").withColumn("part", F.spark_partition_id()))
        counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
        before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row for each key range
        numbered = dealt.join(F.broadcast(before), "part").withColumn("at", F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("k")) - 1)
        return tables.keep(numbered.groupBy(F.floor(F.col("at") / size).cast("bigint").alias("batch")).agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")))


def dual_write(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Two columns kept equal: the one that was written (it differs from ``<name>_before``) wins, the old one first."""
    old_written = ~F.col(old).eqNullSafe(F.col(f"{old}_before"))
    new_written = ~F.col(new).eqNullSafe(F.col(f"{new}_before"))
    value = F.when(old_written, F.col(old)).when(new_written, F.col(new))
    return rows.withColumns({old: F.when(old_written | new_written, value).otherwise(F.col(old)), new: F.when(old_written | new_written, value).otherwise(F.col(new))})


def pending(found: DataFrame, applied: DataFrame) -> DataFrame:
    """Migrations (name, base_name, content) not in the applied set (mark), by name, base name, digest or time prefix."""
    prefix = F.regexp_extract("name", "^([0-9]{8,14})", 1)
    marks = F.array("name", "base_name", F.sha2("content", 256), F.when(prefix != "", prefix))
    done = found.select("name", F.explode(F.array_compact(marks)).alias("mark")).join(applied.select("mark").distinct(), "mark", "left_semi").select("name").distinct()
    return found.join(done, "name", "left_anti")


def _digest(values: list[str]) -> Column:
    """A number for a row's values; null and the empty text differ, and so do values in other columns."""
    return F.xxhash64(*(F.coalesce(F.concat(F.lit(f"{i}:"), F.col(c).cast("string")), F.lit(f"{i}")) for i, c in enumerate(values))).cast("decimal(38,0)")


def hash_tree(rows: DataFrame, key: str, values: list[str], leaf_bits: int, fan_bits: int, levels: int) -> DataFrame:
    """(level, node, n, digest): the sums of the row digests of all key ranges, which no order of rows changes. Node k of level l holds the keys from
    k to k + 1 times 2 ** (leaf_bits + l * fan_bits), so level 0 has the leaves. Leaves are summed from rows, each further level from the one below."""
    zero = F.lit(0).cast("decimal(38,0)")
    level = rows.groupBy(F.shiftright(F.col(key).cast("long"), leaf_bits).alias("node")).agg(F.count("*").alias("n"), F.coalesce(F.sum(_digest([key, *values])), zero).alias("digest"))
    out = level.withColumn("level", F.lit(0))
    for l in range(1, levels):
        level = level.groupBy(F.shiftright("node", fan_bits).alias("node")).agg(F.sum("n").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
        out = out.unionByName(level.withColumn("level", F.lit(l)))
    return out.select("level", "node", "n", "digest")


def parity_differences(left: DataFrame, right: DataFrame, key: str, values: list[str], leaf_bits: int = 8, fan_bits: int = 6, levels: int = 3) -> DataFrame:
    """(key, change): the keys whose rows differ between two tables: missing (only left), extra (only right) or changed. Keys are integers; rows that repeat a key count
    as a set with multiples. A table in the shared folder.

    Both sides are read once for their hash trees. From the top level down only the ranges that differ are looked into, and only the rows of leaves
    that differ are read again and compared, so two tables that agree cost two aggregations. Null keys are one leaf of their own.
    """
    with Rounds(left.sparkSession) as tables:
        trees = [tables.table(hash_tree(t, key, values, leaf_bits, fan_bits, levels)) for t in (left, right)]
        open_nodes = None
        for l in range(levels - 1, -1, -1):
            a, b = (t.filter(F.col("level") == l).drop("level") for t in trees)
            if open_nodes is not None:
                a, b = (t.join(open_nodes, F.shiftright(t["node"], fan_bits).eqNullSafe(open_nodes["up"]), "left_semi") for t in (a, b))
            both = a.alias("a").join(b.alias("b"), F.col("a.node").eqNullSafe(F.col("b.node")), "full_outer")
            same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
            open_nodes = tables.table(both.filter(~same).select(F.coalesce("a.node", "b.node").alias("up")))
        leaf = lambda t: t.select(key, *values).join(open_nodes, F.shiftright(F.col(key).cast("long"), leaf_bits).eqNullSafe(open_nodes["up"]), "left_semi")
        state = lambda t, n: leaf(t).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(_digest([key, *values])).alias("d")).withColumn("side", F.lit(n))
        sides = state(left, 1).unionByName(state(right, 2)).groupBy("key").agg(
            *(F.max(F.when(F.col("side") == s, F.struct("n", "d"))).alias(name) for s, name in ((1, "l"), (2, "r")))
        )
        change = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(F.col("l") != F.col("r"), "changed")
        return tables.keep(sides.select(F.col("key").alias(key), change.alias("change")).filter("change IS NOT NULL"))
