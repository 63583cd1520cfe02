"""Small files in any store that Spark can reach, made whole or not at all."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Hadoop's file systems, from the driver. Names that begin with a dot are invisible to readers."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def _place(self, path: str):
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.conf), place

    def exists(self, path: str) -> bool:
        system, place = self._place(path)
        return system.exists(place)

    def make(self, path: str) -> None:
        system, place = self._place(path)
        system.mkdirs(place)

    def delete(self, path: str) -> None:
        system, place = self._place(path)
        system.delete(place, True)

    def read(self, path: str) -> str | None:
        system, place = self._place(path)
        if not system.exists(place):
            return None
        stream = system.open(place)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, replace: bool = False) -> bool:
        """Whether the file was made: written under another name, then renamed in one step. Without
        ``replace`` a file that is there stays, and the answer is False."""
        folder, _, name = path.rpartition("/")
        own = f"{folder}/.{name}.{uuid.uuid4().hex}"
        system, place = self._place(own)
        stream = system.create(place, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if replace else kind.NONE
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.getFileSystem(self.conf).getUri(), self.conf).rename(place, target, how)
        except Py4JJavaError as error:
            system.delete(place, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True
