"""Names of files in a folder of whichever file system Spark can reach: listing, renaming, small texts."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder on whichever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._utils = spark._jvm.org.apache.commons.io.IOUtils
        self.root = path.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        at = self._path(f"{self.root}/{below}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self._utils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_text(self, name: str, text: str) -> None:
        """Written beside its place and renamed into it."""
        there, beside = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/.{name.replace('/', '-')}")
        out = self._fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(there.getParent())
        self._fs.delete(there, False)
        if not self._fs.rename(beside, there):
            raise OSError(f"cannot write {there}")

    def rename(self, name: str, to: str) -> None:
        if not self._fs.rename(self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{to}")):
            raise OSError(f"cannot rename {name} to {to} in {self.root}")
