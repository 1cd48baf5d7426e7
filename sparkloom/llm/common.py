"""Shared helpers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.joins import connected_components, salted_join
from sparkloom.sources.shared import materialise, new_path

__all__ = ["connected_components", "hash_bound", "hot_join", "join_counted", "materialise", "need", "new_path", "salted_join"]

#: Bytes that a broadcast side may take on an executor.
BROADCAST_BYTES = 64 << 20


def need(df: DataFrame, *names: str) -> DataFrame:
    """Select the named columns only, so that further columns, whatever their names, can't clash."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def join_counted(large: DataFrame, small: DataFrame, on: list[str], row_bytes: int = 64) -> DataFrame:
    """Inner join of whole texts with the rows asked for: ``small``, a written table, is counted, and broadcast if its
    rows fit BROADCAST_BYTES, so that the texts needn't be shuffled; beyond that both sides are shuffled."""
    return large.join(F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small, on)


#: Rows of a key that one task may take in hot_join.
KEY_ROWS = 20_000


def hot_join(left: DataFrame, right: DataFrame, key: str, mix: Column, counted: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key`` where ``right`` has each key once, for wide rows: only the keys that ``left`` (or
    ``counted``, cheaper rows with the same keys) holds more than KEY_ROWS times are copied, once for every KEY_ROWS.

    ``mix`` is any column of ``left`` that spreads its rows.  The hot keys are one in KEY_ROWS rows at most; they are
    broadcast if their counted size allows it.
    """
    hot = (counted if counted is not None else left).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > KEY_ROWS)
    hot = materialise(hot.select(key, F.ceil(F.col("_n") / KEY_ROWS).cast("int").alias("_copies")), "hot")
    n = hot.count()
    if not n:
        return left.join(right, key)
    hot = F.broadcast(hot) if n * 64 <= BROADCAST_BYTES else hot
    copies = F.coalesce("_copies", F.lit(1))
    spread = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(mix), copies).cast("int")).drop("_copies")
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return spread.join(copied, [key, "_salt"]).drop("_salt")


def hash_bound(keys: DataFrame, rows: int) -> int:
    """The hash up to which about ``rows`` rows (k) lie, never more unless hashes are equal: the smallest are found by a
    top-k, which keeps ``rows`` values a task."""
    top = keys.orderBy("k").limit(rows).agg(F.max("k")).first()[0]
    return (1 << 63) - 1 if top is None else top
