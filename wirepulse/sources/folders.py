"""Names of files and folders in any store that Spark reaches, without opening files."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_TAKEN = "FileAlreadyExistsException"


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._folder = path.rstrip("/")
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self._folder).getFileSystem(hadoop)

    def names(self, pattern: str) -> list[str]:
        """Names of what is there under a pattern, such as ``part=*``."""
        return [f.getPath().getName() for f in self._files.globStatus(self._at(pattern)) or []]

    def nested(self, pattern: str) -> list[tuple[str, str]]:
        """(folder, name) of what is there under a pattern such as ``part=*/*``."""
        found = (f.getPath() for f in self._files.globStatus(self._at(pattern)) or [])
        return [(p.getParent().getName(), p.getName()) for p in found]

    def create(self, name: str) -> bool:
        """An empty file; False if it exists already."""
        try:
            self._files.create(self._at(name), False).close()
        except Py4JJavaError as error:
            if _TAKEN not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def modified(self, name: str) -> int:
        """Milliseconds since 1970."""
        return self._files.getFileStatus(self._at(name)).getModificationTime()

    def delete(self, name: str) -> bool:
        return self._files.delete(self._at(name), True)

    def _at(self, name: str):
        return self._path(f"{self._folder}/{name}")
