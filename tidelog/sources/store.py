"""Small files through Spark's own file system layer, so that any store Spark reaches will do."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Appears whole or not at all; fails if the name is taken, also when two writers race for it.

        A file of its own name is written first.  A local one is then linked to the final name, which fails where that
        exists; on HDFS a rename does.  Object stores rename by copying, but show an object only when it is closed, so
        there the final name is created with overwriting off.
        """
        target, scheme = self._path(name), self.fs.getUri().getScheme()
        written = target if scheme not in ("file", "hdfs", "viewfs", "webhdfs") else self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        taken = FileExistsError(f"{self.root}/{name}: another writer has committed this version")
        self.fs.mkdirs(target.getParent())
        if self.fs.exists(target):
            raise taken
        try:
            stream = self.fs.create(written, False)
            stream.write(bytearray(text.encode()))
            stream.close()
            if scheme == "file":
                local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(target), local(written))
            elif written is not target and not self.fs.rename(written, target):
                raise taken
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise taken from e
            raise
        finally:
            if written is not target:
                self.fs.delete(written, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
