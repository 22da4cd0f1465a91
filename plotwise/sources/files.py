"""Small file operations on whatever file system a path belongs to (local, HDFS, object stores), through Hadoop's FileSystem."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    modified: int
    is_folder: bool


class Files:
    """Files of a session; paths without a scheme are those of the default file system."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, folder: str) -> list[Entry]:
        fs, p = self._at(folder)
        return [Entry(s.getPath().toString(), s.getPath().getName(), s.getModificationTime(), s.isDirectory()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def glob(self, pattern: str) -> list[str]:
        fs, p = self._at(pattern)
        return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, source: str, target: str) -> None:
        """To a path that isn't there yet."""
        fs, p = self._at(source)
        if not fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(target)):
            raise OSError(f"can't move {source} to {target}")

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, content: bytes) -> None:
        """The whole file at once: it is written beside its place and renamed over what is there, so readers see the old or the new one."""
        fs, p = self._at(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), self._conf)
        option = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        context.rename(fs.makeQualified(beside), fs.makeQualified(p), options)

    def migrate(self, source: str, target: str) -> str:
        """moved, duplicate (the same bytes were there; the source goes) or absent; ValueError where the target has other bytes."""
        if not self.exists(source):
            return "absent"
        if not self.exists(target):
            self.move(source, target)
            return "moved"
        if self.read(source) != self.read(target):
            raise ValueError(f"{target} is there with another content")
        self.delete(source)
        return "duplicate"


def inside(root: str, path: str) -> str:
    """The path under the root; ValueError where it leads out of it, also by an absolute path."""
    whole = posixpath.normpath(posixpath.join(root, path))
    if whole != posixpath.normpath(root) and not whole.startswith(posixpath.normpath(root).rstrip("/") + "/"):
        raise ValueError(f"{path} leads out of {root}")
    return whole


def blocked(path: str, folders: tuple[str, ...], files: tuple[str, ...] = ()) -> bool:
    """Whether a request path, its dots resolved, is one of the folders, below one, or one of the files; hidden environment files always are."""
    p = "/" + posixpath.normpath(path.split("?", 1)[0].split("#", 1)[0]).lstrip("/")
    return any(p == f or p.startswith(f.rstrip("/") + "/") for f in folders) or p in files or p == "/.env" or p.startswith("/.env.")
