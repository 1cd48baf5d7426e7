"""Rounds of an iteration in a folder of the caller's: a table a round, and a manifest that says which are whole.

A round counts once its manifest file is there; that file is written beside and renamed, so a driver lost at any point
leaves either the round before or this one.  Data folders carry a number of their own, so that a lost attempt is never
taken for a round.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """Small files and folders of the store that Spark names by a path."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.base}/{name}" if name else self.base)

    def names(self, below: str) -> list[str]:
        if not self._fs.exists(self.at(below)):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self.at(below)))

    def read(self, name: str) -> dict:
        stream = self._fs.open(self.at(name))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, content: dict) -> None:
        """A new file, whole or not at all; one that is there already is an error."""
        draft = f"_draft-{uuid.uuid4().hex}"
        stream = self._fs.create(self.at(draft), False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        self._fs.mkdirs(self.at(name).getParent())
        if self._fs.exists(self.at(name)) or not self._fs.rename(self.at(draft), self.at(name)):
            self._fs.delete(self.at(draft), False)
            raise FileExistsError(f"{self.base}/{name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)


class Rounds:
    """Committed rounds below ``base``; the last ``keep`` stay, older ones are deleted as later ones are committed."""

    def __init__(self, spark: SparkSession, base: str, keep: int = 1) -> None:
        self.spark, self.folder, self.keep = spark, Folder(spark, base), keep

    def committed(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names("rounds")]

    def facts(self, k: int) -> dict:
        return self.folder.read(f"rounds/{k:06d}.json")

    def table(self, k: int) -> DataFrame:
        return self.read(self.facts(k)["data"])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.base}/{name}")

    def write(self, df: DataFrame, name: str) -> str:
        """A table of the folder that counts once a round's facts name it."""
        name = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder.base}/{name}")
        return name

    def commit(self, k: int, data: str, **facts: object) -> None:
        self.folder.create(f"rounds/{k:06d}.json", {"data": data, **facts})
        for old in self.committed():
            if old <= k - self.keep:
                gone = self.facts(old)["data"]
                self.folder.delete(f"rounds/{old:06d}.json")  # first, so that no manifest names a table that is gone
                self.folder.delete(gone)
