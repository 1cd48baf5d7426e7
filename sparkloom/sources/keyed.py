"""Tables of cells by key and qualifier: puts that replace cells, gets that read little.

Cells lie in buckets of the key's hash, sorted by key, with a Bloom filter of the keys in every row group.  A put
rewrites the buckets that it touches and leaves the others; the manifest that names each bucket's folder is numbered, and
the next one is put in place at once or not at all, so a reader sees a put whole or not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.rounds import Folder


class KeyedTable:
    """Cells (key string, qualifier string, value of the kind named at creation) below ``path``."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2) -> None:
        self.spark, self.folder, self.keep = spark, Folder(spark, path), keep

    @classmethod
    def create(cls, spark: SparkSession, path: str, value: str = "long", buckets: int = 64, row_group_bytes: int = 8 << 20) -> KeyedTable:
        """An empty table; one that is there is dropped, any other folder that isn't empty is an error."""
        table = cls(spark, path)
        if table.folder.names("") and not table.folder.names("manifests"):
            raise FileExistsError(table.folder.base)
        table.folder.delete("")
        table.folder.create("manifests/000000.json", {"buckets": buckets, "value": value, "row_group_bytes": row_group_bytes, "folders": {}})
        return table

    def _manifest(self) -> tuple[int, dict]:
        names = self.folder.names("manifests")
        if not names:
            raise FileNotFoundError(f"no table at {self.folder.base}")
        return int(names[-1].removesuffix(".json")), self.folder.read(f"manifests/{names[-1]}")

    def _schema(self, manifest: dict) -> str:
        return f"key string, qualifier string, value {manifest['value']}"

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """The cells of the buckets named, of all without names; other folders aren't opened."""
        folders = [f for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], self._schema(manifest))
        return self.spark.read.schema(self._schema(manifest)).parquet(*[f"{self.folder.base}/{f}" for f in folders])

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(manifest["buckets"])).cast("int")

    def put(self, cells: DataFrame) -> None:
        """Add cells (key, qualifier, value); one whose key and qualifier are there is replaced.  Of cells that repeat in
        one put the largest value counts; cells with a null key or qualifier are no cells and left out.  Of two puts at the
        same time the one that comes last fails, and nothing of it is seen.
        """
        number, manifest = self._manifest()
        new = cells.select("key", "qualifier", F.col("value").cast(manifest["value"]).alias("value")).where("key is not null and qualifier is not null")
        new = new.withColumn("bucket", self._bucket(manifest))
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # as many as there are buckets at most
        if not touched:
            return
        old = self._read(manifest, touched).withColumn("bucket", self._bucket(manifest))
        both = old.withColumn("put", F.lit(0)).unionByName(new.withColumn("put", F.lit(1)))
        merged = both.groupBy("bucket", "key", "qualifier").agg(F.max(F.struct("put", "value")).alias("last")).select("bucket", "key", "qualifier", "last.value")
        name = f"data-{uuid.uuid4().hex}"
        keys = ["bucket", "key", "qualifier"]
        writer = merged.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy("bucket")
        writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.block.size", manifest["row_group_bytes"])
        writer.parquet(f"{self.folder.base}/{name}")
        folders = manifest["folders"] | {str(b): f"{name}/bucket={b}" for b in touched}
        self.folder.create(f"manifests/{number + 1:06d}.json", manifest | {"folders": folders})
        self._clean(number + 1)

    def _named(self, name: str) -> set[str]:
        """Data folders that a manifest names."""
        return {f.split("/")[0] for f in self.folder.read(f"manifests/{name}")["folders"].values()}

    def _clean(self, number: int) -> None:
        """Delete manifests before the last ``keep``, and the data that only they name."""
        names = self.folder.names("manifests")
        old = [n for n in names if int(n.removesuffix(".json")) <= number - self.keep]
        kept = set().union(*[self._named(n) for n in names if n not in old])
        for name in old:
            gone = self._named(name) - kept
            self.folder.delete(f"manifests/{name}")  # first, so that no manifest names data that is gone
            for data in gone:
                self.folder.delete(data)

    def get(self, *keys: str) -> DataFrame:
        """The cells of some keys: their buckets only are opened, and of those the row groups that may hold a key."""
        manifest = self._manifest()[1]
        asked = self.spark.createDataFrame([(k,) for k in keys], "key string").select(self._bucket(manifest)).distinct()
        return self._read(manifest, [r[0] for r in asked.collect()]).where(F.col("key").isin(list(keys)))

    def cells(self) -> DataFrame:
        return self._read(self._manifest()[1])
