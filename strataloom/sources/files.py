"""Small files on any of Hadoop's file systems, replaced in one step: for refs and commits."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Files below root. Only the driver uses it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def is_file(self, name: str) -> bool:
        p = self.path(name)
        return self.fs.exists(p) and self.fs.getFileStatus(p).isFile()

    def is_folder(self, name: str) -> bool:
        p = self.path(name)
        return self.fs.exists(p) and self.fs.getFileStatus(p).isDirectory()

    def read(self, name: str) -> bytes | None:
        if not self.is_file(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """A temporary file in the same folder is renamed over the old one; a reader sees either whole."""
        target = self.path(name)
        self.fs.mkdirs(target.getParent())
        temporary = self.jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(temporary, True)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(self.fs.getConf()).getUri(), self.fs.getConf())
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        array[0] = options.OVERWRITE
        context.rename(temporary, target, array)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename(self, name: str, to: str) -> None:
        if not self.fs.rename(self.path(name), self.path(to)):
            raise OSError(f"{name} can't be renamed to {to}")

    def walk(self, name: str) -> list[str]:
        """Files below a folder, by name, without those that begin with a dot."""
        if not self.is_folder(name):
            return []
        found = []
        for status in self.fs.listStatus(self.path(name)):
            leaf = status.getPath().getName()
            if not leaf.startswith("."):
                child = f"{name}/{leaf}"
                found += self.walk(child) if status.isDirectory() else [child]
        return sorted(found)
