"""Tables written between the jobs of one operator, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Spark removes the shuffle files of a finished write at once, so that the steps' files don't add up.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder; any other master must
    name a folder that all executors reach, so this raises ``ValueError``.
    """
    root = spark.conf.get(_SETTING, None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set(_SETTING, f"file://{root}")
        return f"file://{root}"
    return root.rstrip("/")


class Scratch:
    """Parquet tables of one run. A lost executor costs a re-read, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the table as read back, which cuts the lineage."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, *names: str) -> DataFrame:
        """Deletes all tables but the named ones, which alone ``df`` reads, and returns ``df``."""
        for name in [n for n in self.names if n not in names]:
            self.drop(name)
        return df

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        self.names.remove(name)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
