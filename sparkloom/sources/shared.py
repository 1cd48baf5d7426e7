"""Tables in the folder that driver and executors share: they cut lineage and survive the loss of an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and all runs on one machine, as in tests."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write ``df`` once to the shared folder in as many buckets of ``key`` as a shuffle has partitions, and read it back.

    Joins of two such tables on ``key`` move no row, and a write after a shuffle on ``key`` puts one file in a bucket.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables written here that no later step reads; anything else is left alone."""
    for t in tables:
        spark = t.sparkSession
        root = shared_dir(spark).split(":")[-1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            above, name = folder.rsplit("/", 1)
            if above.endswith(root) and re.fullmatch(r"[a-z_]+-[0-9a-f]{32}", name):
                spark.sql(f"drop table if exists `{name.replace('-', '_')}`")
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
