"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session without one gets its own; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="seriesloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Steps:
    """The states of an iteration, each written and read again: a lost executor costs one step, not the whole lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self.delete)

    def written(self, df: DataFrame) -> DataFrame:
        """``df`` as a table. It and the one before stay, those before them are deleted."""
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        self._remove(f"{self.root}/{self.n - 2}")
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self) -> None:
        self._remove(self.root)

    def _remove(self, path: str) -> None:
        try:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended
            pass
