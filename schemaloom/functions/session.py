"""Session helpers: the shared folder and tables of one computation in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(spark: SparkSession) -> SparkSession:
    """The session, with a checkpoint folder: that of spark.checkpoint.dir. Where it is unset, a temporary one on a local master,
    as in tests; on a cluster that is an error, since executors would write to disks of their own."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return spark


class Rounds:
    """Tables of an iterative computation, in the shared folder. Each cuts its lineage; ``drop`` deletes one early, and all others are
    deleted when the block ends, by an error too. ``keep`` writes a result, which stays for its reader."""

    def __init__(self, spark: SparkSession):
        self.spark = checkpointed(spark)
        self.folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        return self._write(df)[0]

    def table(self, df: DataFrame) -> DataFrame:
        found, path = self._write(df)
        self.paths[id(found)] = path
        self._held = [*getattr(self, "_held", []), found]  # ids stay those of these frames
        return found

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                self._delete(path)

    def _write(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.folder}/rounds/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths.values():
            self._delete(path)
