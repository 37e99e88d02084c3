"""Shared working folder: intermediate tables that every executor can read again."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has that name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; unset, a folder in the warehouse, which is shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


class Workspace:
    """Tables of one job under ``shared_dir``; the folder goes when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def _path(self, at: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` once and return it reread: lineage ends at the files."""
        self._n += 1
        at = f"{self.root}/{self._n}-{name}"
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._at = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables written here that nothing reads any more."""
        for t in tables:
            if getattr(t, "_at", "").startswith(self.root):
                self._fs.delete(self._path(t._at), True)

    def settle(self) -> None:
        """Let Spark remove the shuffle files of finished steps; it does so when the driver's garbage goes."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
