"""Tables in the cluster's shared folder, and connected components over them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one on a local master, as in tests; on a
    cluster that is an error, since executors would write to disks of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame as a table in the shared folder, which cuts its lineage, and the table's path."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Tables of one computation: all are deleted when the block ends, by an error too, but for those of ``result``, which
    the caller gets and which stay as long as the shared folder does."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df, path = written(df, name)
        self.paths.append(path)
        return df

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name)[0]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node that links reach.

    Alternating large-star and small-star rounds; each round's edges are a table in the shared folder, the last one
    of ``scratch``. A node's minimum is aggregated and written before it is joined, so a node with very many edges is split by
    the adaptive skew join. Self links and repeated links do no harm; nulls are left out; no edges, no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = scratch.table(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        with Scratch(edges.sparkSession) as own:
            both = now.union(now.select(b, a))
            low = own.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
            large = own.table(both.join(low, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).filter(a != b).distinct(), "large")
            low2 = own.table(large.groupBy("a").agg(F.min("b").alias("m")), "low")
            small = large.join(low2, "a").select(F.explode(F.array(F.struct(a, F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
            now = scratch.table(small.filter(a != b).distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        delete(edges.sparkSession, scratch.paths.pop(-2))
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return now.select(a.alias("node"), b.alias("root")).union(now.select(b.alias("node"), b.alias("root")).distinct())
