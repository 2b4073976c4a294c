"""A keyed table in files that batches of changes are merged into.

Rows lie in folders by a hash of their key, so a batch touches the folders of its keys only: those are read, merged and written anew in one
dynamic partition overwrite, which moves the new files in when the job has ended; a job that fails leaves the table as it was. Each row keeps
the number of the batch that wrote it, deleted ones as well, so a batch that is repeated, even after later ones, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PART, _BATCH, _GONE = "part", "batch", "gone"


class KeyedTable:
    """``columns``: the schema of key and values, as DDL. ``parts``: the number of folders, fixed for the table's life. The folder is in the
    cluster's shared storage; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: str, parts: int = 64):
        self.spark, self.path, self.key, self.parts = spark, path, key, parts
        self.schema = f"{columns}, {_BATCH} long, {_GONE} boolean, {_PART} int"
        self.names = [f.name for f in spark.createDataFrame([], columns).schema.fields]

    def _files(self) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)

    def read(self) -> DataFrame:
        return self._files().filter(~F.col(_GONE)).select(*self.names)

    def merge(self, changes: DataFrame, number: int) -> int:
        """Applies a batch (op, key, values; and id, which orders changes of one key, where there is one): the last change of a key counts, D
        deletes. Returns how many folders were written. Rows with a null key are one key."""
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        order = F.struct(*(c for c in ("id",) if c in changes.columns), *(c for c in ("op", *self.names) if c in changes.columns))
        last = changes.groupBy(self.key).agg(F.max_by(F.struct("op", *(c for c in self.names if c != self.key)), order).alias("c"))
        fresh = last.select(
            *(F.col(n) if n == self.key else F.col(f"c.{n}") for n in self.names), F.lit(number).cast("long").alias(_BATCH), (F.col("c.op") == "D").alias(_GONE), part.alias(_PART),
        )
        touched = [r[0] for r in fresh.select(_PART).distinct().collect()]  # as many as there are folders at most
        if not touched:
            return 0
        old = self._files().filter(F.col(_PART).isin(touched))
        rest = [c for c in (*self.names, _BATCH, _GONE) if c != self.key]
        newest = F.max_by(F.struct(*rest), F.struct(F.col(_BATCH), F.col("fresh"))).alias("r")
        merged = old.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True))).groupBy(_PART, self.key).agg(newest)
        merged = merged.select(*(F.col(n) if n == self.key else F.col(f"r.{n}") for n in self.names), f"r.{_BATCH}", f"r.{_GONE}", _PART)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(self.path)
        return len(touched)
