"""Small files that say what is in a table: created by one writer only, whatever the file system."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of such files."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(self.path))

    def of(self, name: str):
        return self._path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.path)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.of(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file whole, or return False if it exists: of several writers exactly one gets True.

        The text goes to a file of its own first. A local file system then links it, others rename it, which
        fails where the name is taken (as HDFS does). An object store needs a committer with that promise.
        """
        tmp, final = self.of(f"{uuid.uuid4().hex}.tmp"), self.of(name)
        out = self.fs.create(tmp, False)
        out.write(text.encode())
        out.close()
        try:
            if self.fs.getScheme() == "file":
                try:
                    os.link(tmp.toUri().getPath(), final.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not self.fs.exists(final) and self.fs.rename(tmp, final)
        finally:
            self.fs.delete(tmp, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.of(name), True)


def scratch(spark: SparkSession) -> str:
    """The shared folder for tables that queries make: spark.checkpoint.dir; a local one only where all runs in one process."""
    import re
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
