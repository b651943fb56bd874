"""Folders that driver and executors share, and files that appear there whole or not at all."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where none is set, local mode gets a fresh one; a cluster fails."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """Small files and renames by the file system that a folder's address names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """What a folder holds, sorted; nothing if it is not there."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        """False where ``new`` is there already: of two that publish the same name, one wins."""
        if self.exists(new):
            return False
        self.fs.mkdirs(self._path(new).getParent())
        return self.fs.rename(self._path(old), self._path(new))

    def write(self, name: str, text: str) -> bool:
        """Write beside and rename, so that no reader meets half of it."""
        aside = f"_aside/{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(aside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return self.rename(aside, name)

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
