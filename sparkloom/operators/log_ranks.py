"""Ranks as natural logarithms, so that those too small for a double don't vanish."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sparkloom.operators.graph import ALPHA, _shares
from sparkloom.sources.shared import discard, materialise

#: Logarithms of one bucket are summed as plain numbers between 1 and e**WIDTH; far below the largest double, so that
#: any number of them can be added up.
WIDTH = 300.0


def log_sum(df: DataFrame, key: str, x: str) -> DataFrame:
    """(key, x): the logarithm of the sum of exponentials of each key.

    A value is its bucket's number and a scaled number within it.  Scaled numbers are summed a key and bucket, partially
    before the shuffle; the few buckets of a key are then added up on the scale of the largest.
    """
    bucket = F.floor(F.col(x) / WIDTH)
    parts = df.where(F.col(x).isNotNull()).groupBy(key, bucket.alias("b")).agg(F.sum(F.exp(F.col(x) - bucket * WIDTH)).alias("s"))
    parts = parts.groupBy(key).agg(F.max("b").alias("top"), F.collect_list(F.struct("b", "s")).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda acc, e: acc + e["s"] * F.exp((e["b"] - F.col("top")) * WIDTH))
    return parts.select(key, (F.col("top") * WIDTH + F.log(total)).alias(x))


def log_add(a: Column, b: Column) -> Column:
    """The logarithm of e**a + e**b; null stands for nothing."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b))))


def _log(x: float) -> Column:
    return F.lit(log(x) if x > 0 else None).cast("double")


def _arrived(nodes: DataFrame, shares: DataFrame, ranks: DataFrame) -> tuple[DataFrame, float]:
    """(id, inc) of every node, null where nothing arrives, and the mass that didn't arrive."""
    sent = shares.join(ranks.where("log_rank is not null").withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.log("share") + F.col("log_rank")).alias("inc"))
    seen = Observation()
    inc = materialise(nodes.select("id").join(log_sum(sent, "id", "inc"), "id", "left").observe(seen, F.sum(F.exp("inc")).alias("mass")), "inc")
    return inc, max(0.0, 1.0 - (seen.get["mass"] or 0.0))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int, alpha: float = ALPHA) -> DataFrame:
    """(id, log_rank): logarithms of the ranks of ``graph.pagerank``."""
    n = nodes.count()
    ranks, old = nodes.select("id", F.lit(-log(max(n, 1))).alias("log_rank")), []
    if not n:
        return ranks
    shares = materialise(_shares(edges), "shares")
    for _ in range(iterations):
        inc, miss = _arrived(nodes, shares, ranks)
        discard(*old)
        ranks, old = inc.select("id", log_add(_log(alpha / n), log(1 - alpha) + log_add(F.col("inc"), _log(miss / n))).alias("log_rank")), [inc]
    return ranks


def personalised(nodes: DataFrame, edges: DataFrame, source: int, iterations: int, alpha: float = ALPHA) -> DataFrame:
    """(id, log_rank): logarithms of the ranks of ``graph.personalised`` from one source; null where it doesn't reach, and
    everywhere if it isn't a node."""
    here = F.col("id") == source
    ranks, old = nodes.select("id", F.when(here, 0.0).alias("log_rank")), []
    shares = materialise(_shares(edges), "shares")
    for _ in range(iterations):
        inc, miss = _arrived(nodes, shares, ranks)
        discard(*old)
        arrived = log(1 - alpha) + log_add(F.col("inc"), F.when(here, _log(miss)))
        ranks, old = inc.select("id", log_add(F.when(here, _log(alpha)), arrived).alias("log_rank")), [inc]
    return ranks
