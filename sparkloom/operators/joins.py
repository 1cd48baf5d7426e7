"""Joins and components that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import discard, materialise

#: Copies of the unique side of a salted join, so that a key with a third of all rows is dealt over as many tasks.
SALTS = 8


def salted_join(left: DataFrame, right: DataFrame, key: str, mix: Column, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` where ``right`` has each key once and ``left`` may have a hot key.

    ``mix`` is any column of ``left`` that spreads its rows.  The right side is copied SALTS times, so the hot key's
    rows go to SALTS tasks at least, and adaptive execution can split them further.
    """
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    # never null, so that the join infers no filter for one side only and both sides can use one shuffle
    spread = left.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(mix), F.lit(SALTS)).cast("int"), F.lit(0)))
    copies = right.withColumn("_salt", F.explode(salts))
    return spread.join(copies, [key, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node that isn't the smallest of its component, the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014).  Each step only takes minima per node, which
    combine before the shuffle, and salted joins; a node with very many neighbours never meets in one task.  Every
    round is written to the shared folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialise(e, "edges")

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = signature(e)
    if not seen[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), least, "u", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, old = materialise(large.where("u <> v").distinct(), "large"), e
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u", F.col("v"))
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(old, large)
        now = signature(e)
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")
