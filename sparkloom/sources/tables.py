"""Scans and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Delimited star-schema tables, columns by position; names follow the Parquet tables.
TBL_SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int",
    "customer": "c_custkey long, c_name string, c_address string, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "supplier": "s_suppkey long, s_name string",
    "part": "p_partkey long, p_name string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tbl(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A '|'-delimited table; columns beyond the schema are ignored."""
    return spark.read.schema(TBL_SCHEMAS[table]).option("sep", "|").option("mode", "PERMISSIVE").csv(path)


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of one or more collections, one after another, by one scan."""
    return spark.read.text(list(paths))


def prefix_range(column: str, prefix: str) -> Column:
    """Rows whose date starts with ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD``, as a half-open range that Parquet scans can use."""
    parts = [int(p) for p in prefix.split("-")]
    lo = datetime(*(parts + [1, 1])[:3])
    if len(parts) == 1:
        hi = datetime(lo.year + 1, 1, 1)
    elif len(parts) == 2:
        hi = datetime(lo.year + lo.month // 12, lo.month % 12 + 1, 1)
    else:
        hi = datetime.fromordinal(lo.toordinal() + 1)
    kind = T.TimestampNTZType()
    return (F.col(column) >= F.lit(lo).cast(kind)) & (F.col(column) < F.lit(hi).cast(kind))


def after(column: str, date: str) -> tuple[Column, Column]:
    """(before, after) of a date by the comparison of strings: a prefix sorts before all dates that it starts."""
    full = len(date.split("-")) == 3
    lo = datetime(*([int(p) for p in date.split("-")] + [1, 1])[:3])
    at = F.lit(lo).cast(T.TimestampNTZType())
    return F.col(column) < at, (F.col(column) > at) if full else (F.col(column) >= at)


def parse_adjacency(lines: DataFrame, separator: str = r"\s+") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lines ``id neighbour neighbour ...``; a lone id is a dangling node, repeats stay."""
    fields = F.split(F.trim("value"), separator)
    rows = lines.where(F.length(F.trim("value")) > 0).select(F.transform(fields, lambda x: x.cast("long")).alias("f"))
    nodes = rows.select(F.col("f")[0].alias("id"))
    edges = rows.select(F.col("f")[0].alias("src"), F.explode(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0)))).alias("dst"))
    return nodes, edges


def parse_instances(lines: DataFrame) -> DataFrame:
    """(doc_id, label, features) of lines ``docid label f1 f2 ...``."""
    f = F.split("value", " ")
    return lines.select(f[0].alias("doc_id"), f[1].alias("label"), F.transform(F.slice(f, 3, F.greatest(F.size(f) - 2, F.lit(0))), lambda x: x.cast("int")).alias("features"))


def parse_model(lines: DataFrame, *keep: str) -> DataFrame:
    """(feature, weight) of lines ``(feature,weight)`` or ``feature TAB weight``, after the columns to keep; other lines are left out."""
    f = F.split(F.regexp_replace("value", "[()\\s]+", ","), ",")
    rows = lines.select(*keep, F.filter(f, lambda x: x != "").alias("f")).where(F.size("f") == 2)
    return rows.select(*keep, F.col("f")[0].cast("int").alias("feature"), F.col("f")[1].cast("double").alias("weight"))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, feature, weight) of a folder of models, a file each: the number of ``part-NNNNN`` and 1.  One scan reads
    all; files of other names are an error, as their models have no number."""
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1)
    known = F.when(number == "", F.raise_error(F.concat(F.lit("no number in the name of "), F.col("_metadata.file_name")))).otherwise(number)
    return parse_model(spark.read.text(path).select("value", (known.cast("int") + 1).alias("model_id")), "model_id")


def write_models(models: DataFrame, path: str, n_models: int) -> None:
    """Models 1 to ``n_models`` of (model_id, feature, weight) as files part-00000 and on; one without features has no file."""
    rows = models.repartitionById(n_models, F.col("model_id").cast("int") - 1)
    rows.select(F.concat(F.lit("("), F.col("feature").cast("string"), F.lit(","), F.col("weight").cast("string"), F.lit(")")).alias("value")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Key-value text, tab separated; an existing output is replaced."""
    df.write.mode("overwrite").csv(path, sep="\t")


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """A keyed table for point lookups: ranges of the keys in files, sorted, so that scans prune by footer statistics."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def replace_table(df: DataFrame, name: str) -> None:
    """Drop and create a catalogue table."""
    df.write.mode("overwrite").saveAsTable(name)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table whose later joins on ``key`` need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
