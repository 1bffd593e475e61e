"""Listing, dating and deleting files wherever Spark can read and write."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        path = self._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self._conf), path

    def delete(self, path: str, recursive: bool = True) -> None:
        fs, path = self._at(path)
        fs.delete(path, recursive)

    def total(self, addresses: list[str]) -> int:
        """Bytes of the files at these addresses, as DataFrame.inputFiles names them."""
        found = (self._jvm.org.apache.hadoop.fs.Path(self._jvm.java.net.URI(a)) for a in addresses)
        return sum(p.getFileSystem(self._conf).getFileStatus(p).getLen() for p in found)

    def age(self, path: str) -> float:
        """Seconds since the file was written."""
        fs, path = self._at(path)
        return (self._jvm.java.lang.System.currentTimeMillis() - fs.getFileStatus(path).getModificationTime()) / 1000

    def listing(self, path: str) -> tuple[tuple[str, int, int], ...]:
        """Name, size and time of what a folder holds, or of the file itself; empty where
        there is nothing. Tables rewritten at the same path list differently."""
        fs, path = self._at(path)
        if not fs.exists(path):
            return ()
        return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))
