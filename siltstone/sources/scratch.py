"""Tables in the folder that all executors share, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local master gets one of our own; a cluster, whose machines
    share no temporary folder, gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        named = tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Parquet tables under one folder: a given one, or a fresh one of the shared folder that goes when the session ends.

    A written table is read back with its lineage cut, so a lost executor costs one re-read. release() deletes a table that no
    later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark, self.fresh = spark, root is None
        self.root = root or f"{shared_dir(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
        self.partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _path(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def write(self, df: DataFrame, name: str, partition_by: Sequence[str] = (), **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd").options(**options)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        if self.fresh:
            fs, root = self._path()
            fs.deleteOnExit(root)
            self.fresh = False
        return self.read(df, name)

    def read(self, like: DataFrame, name: str) -> DataFrame:
        """A written table of the columns of like; partition columns come last when read back, and as integers."""
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}").select(*(f"`{c}`" for c in like.columns))

    def release(self, *names: str) -> None:
        for name in names:
            fs, path = self._path(name)
            fs.delete(path, True)
