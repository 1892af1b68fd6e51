"""The folder that the cluster shares, and intermediate tables written to it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without that setting gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints", "tessera")


class Folder:
    """A folder of any of Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def names(self, name: str = "") -> list[str]:
        """What lies in the folder, sorted; nothing if there is no such folder."""
        p = self._path(self.path(name))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._path(self.path(name)), True)

    def rename(self, old: str, new: str) -> bool:
        """False if the new name is taken or the old one is gone."""
        if self.exists(new):
            return False
        return self._fs.rename(self._path(self.path(old)), self._path(self.path(new)))

    def write_text(self, name: str, text: str) -> bool:
        """A small text file that is whole or not there: written under another name, then renamed. False if it is there already."""
        part = f".{name.rsplit('/', 1)[-1]}-{uuid.uuid4().hex}"
        part = f"{name.rsplit('/', 1)[0]}/{part}" if "/" in name else part
        out = self._fs.create(self._path(self.path(part)), True)
        out.write(bytearray(text.encode()))
        out.close()
        done = self.rename(part, name)
        if not done:
            self.remove(part)
        return done

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


class Workspace:
    """Writes intermediate tables, so that a lost executor costs a re-read and not a recomputation of the lineage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """df as a written table; its plan starts from the files."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove staged tables that no later plan reads."""
        folder = Folder(self.spark, self.root)
        for name in names:
            folder.remove(name)

    def close(self) -> None:
        """Remove all that was staged; nothing may read it later."""
        Folder(self.spark, self.root).remove()
