"""Folders that driver and executors share, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where the session names none, a temporary one is taken on one
    machine (tests); on a cluster that would lose data, so it is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="leadloom-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


class Files:
    """The few file operations that a commit needs, on the file system of `path`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        sc = spark.sparkContext
        self._gateway, self._hadoop, self._conf = sc._gateway, sc._jvm.org.apache.hadoop.fs, sc._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._hadoop.Path(path)

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a file that isn't there yet, as a whole; False if it is there. A temporary file is renamed
        without overwriting, which HDFS does atomically."""
        folder, name = path.rsplit("/", 1)
        own = self._path(f"{folder}/.{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(own, False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        none = self._gateway.new_array(self._hadoop.Options.Rename, 1)
        none[0] = self._hadoop.Options.Rename.NONE
        try:
            self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(own, self._path(path), none)
            return True
        except Py4JJavaError as error:
            self._fs.delete(own, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
