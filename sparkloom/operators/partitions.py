"""Graphs written by partition of their nodes: only messages between partitions are shuffled.

Nodes and the edges that they send along are kept in buckets of an explicit partition number, edges within a partition
apart from crossing ones.  A round sums the messages within a partition where they arise; crossing ones are summed for
their target where they arise too, and then sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.graph import ALPHA, _shares
from sparkloom.sources.shared import bucketed, discard, materialise

#: Joins on a partition and an id may use the buckets of the partition.
COLOCATED = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def _with(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def place(nodes: DataFrame, partitions: int, by_range: bool):
    """The partition of an id: a range of the ids between the smallest and the largest, or the id modulo the number."""
    if not by_range:
        return lambda id_: F.pmod(id_.cast("long"), F.lit(partitions)).cast("int")
    lo, hi = nodes.agg(F.min("id"), F.max("id")).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // partitions))
    return lambda id_: F.least(F.greatest(F.floor((id_ - (lo or 0)) / width), F.lit(0)), F.lit(partitions - 1)).cast("int")


@dataclass
class Partitioned:
    """nodes (part, id), inner (part, src, dst, share), crossing (part, src, dst, to, share), each in buckets of part."""

    nodes: DataFrame
    inner: DataFrame
    crossing: DataFrame
    n: int


def write(nodes: DataFrame, edges: DataFrame, partitions: int, by_range: bool) -> Partitioned:
    """The graph in buckets; targets without a record have a partition as well, in which nothing takes their messages."""
    part = place(nodes, partitions, by_range)
    shares = _shares(edges).select(part(F.col("src")).alias("part"), "src", "dst", part(F.col("dst")).alias("to"), "share")
    shares = materialise(shares, "shares")
    inner = bucketed(shares.where(F.col("part") == F.col("to")).drop("to"), "inner", "part")
    crossing = bucketed(shares.where(F.col("part") != F.col("to")), "crossing", "part")
    discard(shares)
    known = bucketed(nodes.select(part(F.col("id")).alias("part"), "id"), "nodes", "part")
    return Partitioned(known, inner, crossing, known.count())


def _round(graph: Partitioned, ranks: DataFrame) -> tuple[DataFrame, Observation]:
    """(part, id, inc), and what its writing observes: mass, messages summed within partitions, messages shuffled."""

    def sent(edges: DataFrame, *to: str) -> DataFrame:
        met = edges.join(ranks.withColumnRenamed("id", "src"), ["part", "src"])
        return met.groupBy("part", *to, "dst").agg(F.sum(F.col("share") * F.col("rank")).alias("mass"))

    inside = sent(graph.inner).select("part", F.col("dst").alias("id"), F.col("mass").alias("own"))
    # dealt by the target's partition, as the buckets are: the sums and the join below need no further shuffle
    across = sent(graph.crossing, "to").repartition("to").groupBy(F.col("to").alias("part"), F.col("dst").alias("id")).agg(F.sum("mass").alias("other"), F.count(F.lit(1)).alias("shuffled"))
    rows = graph.nodes.join(inside, ["part", "id"], "left").join(across, ["part", "id"], "left")
    nothing = F.lit(0.0)
    rows = rows.select("part", "id", (F.coalesce("own", nothing) + F.coalesce("other", nothing)).alias("inc"), F.col("own").isNotNull().alias("met"), "shuffled")
    seen = Observation()
    counters = [F.sum("inc").alias("mass"), F.count(F.when(F.col("met"), 1)).alias("inside"), F.coalesce(F.sum("shuffled"), F.lit(0)).alias("shuffled")]
    return rows.observe(seen, *counters).select("part", "id", "inc"), seen


def _rounds(graph: Partitioned, alpha: float) -> Iterator[tuple[DataFrame, dict]]:
    spark = graph.nodes.sparkSession
    ranks, old = graph.nodes.select("part", "id", F.lit(1.0 / max(graph.n, 1)).alias("rank")), []
    yield ranks, {}
    while True:
        with _with(spark, COLOCATED):
            inc, seen = _round(graph, ranks)
            inc = bucketed(inc, "inc", "part")
        discard(*old)
        miss = max(0.0, 1.0 - (seen.get["mass"] or 0.0))
        jump: Column = alpha / graph.n + (1 - alpha) * (F.col("inc") + miss / graph.n)
        ranks, old = inc.select("part", "id", jump.alias("rank")), [inc]
        yield ranks, seen.get


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int, partitions: int = 8, by_range: bool = True, alpha: float = ALPHA) -> DataFrame:
    """(id, rank): the ranks of ``graph.pagerank`` over a graph written by partition."""
    if nodes.isEmpty():
        return nodes.select("id", F.lit(0.0).alias("rank"))
    rounds = _rounds(write(nodes, edges, partitions, by_range), alpha)
    for _ in range(iterations):
        next(rounds)
    return next(rounds)[0].select("id", "rank")


def messages(nodes: DataFrame, edges: DataFrame, partitions: int = 8) -> DataFrame:
    """(strategy, inside, shuffled): what a round moves by either way of partitioning, observed as it is written."""
    rows = []
    for by_range in (False, True):
        counts = {"inside": 0, "shuffled": 0}
        if not nodes.isEmpty():
            rounds = _rounds(write(nodes, edges, partitions, by_range), ALPHA)
            next(rounds)
            counts = next(rounds)[1]
        rows.append(("range" if by_range else "modulo", counts["inside"], counts["shuffled"]))
    return nodes.sparkSession.createDataFrame(rows, "strategy string, inside long, shuffled long")
