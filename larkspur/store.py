"""Small files and folders on whatever file system the path names, through Hadoop's client."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; a temporary one only in local mode, as in tests."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not re.match(r"local(\[(\d+|\*)(,\d+)?\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return place or tempfile.mkdtemp(prefix="larkspur-")


class Store:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write beside the file, then rename over it in one step: readers see the old or the new content."""
        aside = f"{path}.new"
        stream = self._fs(path).create(self._path(aside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        how = self.conf.getClass().getClassLoader().loadClass("org.apache.hadoop.fs.Options$Rename").getEnumConstants()
        over = next(x for x in how if x.toString() == "OVERWRITE")
        array = self.jvm.java.lang.reflect.Array.newInstance(over.getClass(), 1)
        array[0] = over
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), self.conf) if self._path(path).toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        context.rename(self._path(aside), self._path(path), array)

    def folders(self, path: str) -> list[str]:
        """Names of the folders under ``path``."""
        if not self.exists(path):
            return []
        return [x.getPath().getName() for x in self._fs(path).listStatus(self._path(path)) if x.isDirectory()]

    def remove(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)
