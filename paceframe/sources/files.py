"""Small files and moves in whatever store Spark reads; rows never pass here."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


class Files:
    """The store that holds ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        """What lies in a folder; nothing if there is none."""
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))] if self.exists(folder) else []

    def below(self, folder: str) -> list[str]:
        """Paths of all files below a folder, relative to it."""
        if not self.exists(folder):
            return []
        root = self.fs.makeQualified(self._path(folder)).toString().rstrip("/") + "/"
        found, listed = [], self.fs.listFiles(self._path(folder), True)
        while listed.hasNext():
            found.append(listed.next().getPath().toString().removeprefix(root))
        return sorted(found)

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str, replace: bool = False) -> None:
        """Writes beside the place and moves; readers never see a part of a file."""
        beside = f"{path}.writing"
        stream = self.fs.create(self._path(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if replace:
            self.remove(path)
        if not self.move(beside, path):
            raise FileExistsError(path)

    def move(self, source: str, target: str) -> bool:
        """Whether ``source`` has become ``target``; it hasn't if there was one."""
        target_path = self._path(target)
        self.fs.mkdirs(target_path.getParent())
        return not self.fs.exists(target_path) and self.fs.rename(self._path(source), target_path)

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)
