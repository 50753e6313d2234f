"""The few file operations that commits need, through Hadoop's API.

``create`` is exclusive and shows a file whole or not at all: a finished temporary file gets its name by a hard
link on local and NFS paths, elsewhere by a rename, which HDFS and its kin refuse where the name is taken. A
plain object store whose rename overwrites gives no such promise and can't hold a store with several writers.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.reader = jvm.org.apache.commons.io.IOUtils
        self.local = self.fs.getUri().getScheme() == "file"

    def create(self, path: str, text: str) -> bool:
        """False if the file is there already."""
        if self.exists(path):
            return False
        folder, _, name = path.rpartition("/")
        draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        if self.local:
            place, draft = (self.path(p).toUri().getPath() for p in (path, draft))
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with open(draft, "w") as f:
                f.write(text)
            try:
                os.link(draft, place)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        out = self.fs.create(self.path(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.rename(self.path(draft), self.path(path)):
            return True
        self.fs.delete(self.path(draft), False)
        return False

    def read(self, path: str) -> str:
        if self.local:
            with open(self.path(path).toUri().getPath()) as f:
                return f.read()
        stream = self.fs.open(self.path(path))
        try:
            return self.reader.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if there is no such folder. Drafts are left out."""
        p = self.path(path)
        found = [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []
        return [n for n in found if not n.startswith(".")]

    def exists(self, path: str) -> bool:
        return os.path.exists(self.path(path).toUri().getPath()) if self.local else self.fs.exists(self.path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)
