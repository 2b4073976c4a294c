"""Range partitions: bounds, routing, what to make and what to drop, and trees of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.session import Rounds


def monthly(spark: SparkSession, table: str, first: str, months: int) -> DataFrame:
    """(part, low, high) of ``months`` half-open monthly ranges."""
    low = F.add_months(F.lit(first).cast("date"), F.col("id").cast("int")).cast("timestamp_ntz")
    rows = spark.range(months).select(low.alias("low"))
    return rows.select(F.concat(F.lit(f"{table}_"), F.date_format("low", "yyyy_MM")).alias("part"), "low", F.add_months(F.col("low").cast("date"), 1).cast("timestamp_ntz").alias("high"))


def route(rows: DataFrame, column: str, bounds: DataFrame) -> DataFrame:
    """Adds ``part``: the range that holds the row, else ``default``. The ranges are monthly, so the join is on the month."""
    months = bounds.withColumn("month", F.date_trunc("month", F.col("low").cast("timestamp")).cast("timestamp_ntz"))
    keyed = rows.withColumn("month", F.date_trunc("month", column).cast("timestamp_ntz"))
    inside = (F.col(column) >= F.col("low")) & (F.col(column) < F.col("high"))
    return keyed.join(months, "month", "left").withColumn("part", F.coalesce(F.when(inside, F.col("part")), F.lit("default"))).drop("month", "low", "high")


def daily(spark: SparkSession, table: str, first: str, days: int) -> DataFrame:
    """(part, low, high) of ``days`` half-open daily ranges."""
    low = F.date_add(F.lit(first).cast("date"), F.col("id").cast("int"))
    return spark.range(days).select(F.concat(F.lit(f"{table}_"), F.date_format(low, "yyyy_MM_dd")).alias("part"), low.cast("timestamp_ntz").alias("low"), F.date_add(low, 1).cast("timestamp_ntz").alias("high"))


def route_ranges(rows: DataFrame, column: str, bounds: DataFrame) -> DataFrame:
    """Adds ``part`` for half-open ranges of any length: the range that holds the row, the first by name where several do, else ``default``. A null bound is open to
    that side; rows without a value go to ``default``.

    Ranges are cut at the days that they touch, open ones at the first and last day of the rows, and a day's ranges become one list, so the join is by day and
    finds one row: its side grows with the ranges' days, and the rows are shuffled by day at most. Other columns may be of any type.
    """
    ends = rows.agg(F.min(column).alias("__first"), F.max(column).alias("__last"))
    open_low, open_high = F.col("low").isNull(), F.col("high").isNull()
    sound = F.coalesce(F.col("low") < F.col("high"), open_low | open_high)
    first = F.to_date(F.coalesce("low", F.least("__first", "high")))
    last = F.to_date(F.when(open_high, F.greatest("__last", "low")).otherwise(F.col("high") - F.expr("INTERVAL 1 MICROSECOND")))
    days = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
    cut = bounds.filter(sound).join(F.broadcast(ends)).select("part", "low", "high", F.explode(days).alias("__day"))  # one row beside each range
    of_day = cut.groupBy("__day").agg(F.sort_array(F.collect_list(F.struct("part", "low", "high"))).alias("__ranges"))
    holds = lambda r: (r["low"].isNull() | (r["low"] <= F.col(column))) & (r["high"].isNull() | (F.col(column) < r["high"]))
    found = F.try_element_at(F.filter("__ranges", holds), F.lit(1))["part"]
    hit = rows.drop("part").withColumn("__day", F.to_date(column)).join(of_day, "__day", "left")
    return hit.withColumn("part", F.coalesce(found, F.lit("default"))).drop("__day", "__ranges")


def expired(names: DataFrame, cutoff: str) -> DataFrame:
    """Partitions whose name's date suffix lies before the cutoff; names without one stay."""
    suffix = F.regexp_extract("part", "_([0-9]{4}_[0-9]{2}(?:_[0-9]{2})?)$", 1)
    day = F.coalesce(F.try_to_timestamp(suffix, F.lit("yyyy_MM_dd")), F.try_to_timestamp(suffix, F.lit("yyyy_MM")))
    return names.filter(F.coalesce(day < F.lit(cutoff).cast("timestamp"), F.lit(False)))


def tree(edges: DataFrame, root: str) -> DataFrame:
    """(child, parent, depth) below ``root``, level by level to the last one: one join each. A child that is met twice stands on a
    cycle or has two parents, which is an error."""
    spark = edges.sparkSession
    with Rounds(spark) as tables:
        level = tables.table(edges.filter(F.col("parent") == root).select("child", "parent", F.lit(1).alias("depth")))
        out, depth = level, 1
        while not level.isEmpty():
            depth += 1
            level = tables.table(edges.join(level.select(F.col("child").alias("parent")), "parent").select("child", "parent", F.lit(depth).alias("depth")))
            if not level.select("child").intersect(out.select("child").union(spark.createDataFrame([(root,)], "child string"))).isEmpty():
                raise ValueError(f"a partition below {root} is its own ancestor or has two parents")
            out = out.union(level)
        return tables.keep(out)
