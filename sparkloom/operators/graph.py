"""Graph ranking: PageRank, personalised PageRank for many sources at once, top nodes, ranges, weak components.

Ranks are linear doubles (``log_ranks`` has logarithms).  Each iteration joins the edges with the ranks, sums by target
and writes one table to the shared folder; the mass that dangling and vanished nodes lose, and what else is counted, is
observed by the pass that writes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.joins import connected_components
from sparkloom.sources.rounds import Rounds
from sparkloom.sources.shared import bucketed, discard, materialise

ALPHA = 0.15
#: Edges of one source beyond which they are joined apart from the buckets, where adaptive execution can split them.
HUB_EDGES = 1 << 20


def graph_build(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, first_neighbour, last_neighbour): the adjacency of every node, repeats counted; -1 where there is none."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("lo"), F.max("dst").alias("hi"))
    return nodes.join(out, nodes["id"] == out["src"], "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("out_degree"), F.coalesce("lo", F.lit(-1)).cast("long").alias("first_neighbour"), F.coalesce("hi", F.lit(-1)).cast("long").alias("last_neighbour"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, n_active, n_missing): nodes with neighbours, and edges to ids without a record."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.join(nodes.select(F.col("id").alias("dst"), F.lit(1).alias("known")), "dst", "left")
    e = e.agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_active"), F.count(F.when(F.col("known").isNull(), 1)).alias("n_missing"))
    return n.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k").drop("k")


def _shares(edges: DataFrame) -> DataFrame:
    """Edges with the share of its source's mass that each carries."""
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return edges.join(degree, "src").select("src", "dst", (1.0 / F.col("degree")).alias("share"))


def _next(inc: DataFrame, n: int, alpha: float, mass: float | None) -> DataFrame:
    miss = max(0.0, 1.0 - (mass or 0.0))
    return inc.select("id", (alpha / n + (1 - alpha) * (F.col("inc") + miss / n)).alias("rank"))


def _step(nodes: DataFrame, shares: DataFrame, ranks: DataFrame) -> tuple[DataFrame, Observation]:
    """(id, inc) of every node, and what its writing observes: the mass that arrives, messages sent along edges, nodes that
    received any, nodes without a record that did, and messages saved by summing up for a target.

    All of it is observed by the tasks that write, each of which counts once, however often tasks before are run again.
    """
    sent = shares.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("inc"), F.count(F.lit(1)).alias("n"))
    rows = nodes.select("id", F.lit(True).alias("known")).join(sent, "id", "full")
    seen, count = Observation(), F.count(F.lit(1))
    rows = rows.observe(
        seen, F.sum(F.when(F.col("known"), F.col("inc"))).alias("mass"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"), F.count("n").alias("received"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("saved"), (count - F.count("known")).alias("missing"),
    )
    return rows.where("known").select("id", F.coalesce("inc", F.lit(0.0)).alias("inc")), seen


def _counted_rounds(nodes: DataFrame, edges: DataFrame, alpha: float) -> Iterator[tuple[DataFrame, dict]]:
    """Ranks at the start and after each iteration with its counters; a round's table goes once the next one is written."""
    n = nodes.count()
    ranks, old = nodes.select("id", F.lit(1.0 / max(n, 1)).alias("rank")), []
    yield ranks, {}
    shares = materialise(_shares(edges), "shares")
    while True:
        inc, seen = _step(nodes, shares, ranks)
        inc = materialise(inc, "inc")
        discard(*old)
        ranks, old = _next(inc, n, alpha, seen.get["mass"]), [inc]
        yield ranks, seen.get


def _rounds(nodes: DataFrame, edges: DataFrame, alpha: float) -> Iterator[DataFrame]:
    return (ranks for ranks, _ in _counted_rounds(nodes, edges, alpha))


def pagerank_counters(nodes: DataFrame, edges: DataFrame, iterations: int, alpha: float = ALPHA) -> DataFrame:
    """(round, messages, received, saved, missing, mass) of each iteration of ``pagerank``, observed in passing."""
    rows = [] if nodes.isEmpty() else [(k, c["messages"], c["received"], c["saved"], c["missing"], c["mass"] or 0.0) for k, (_, c) in enumerate(islice(_counted_rounds(nodes, edges, alpha), 1, iterations + 1), 1)]
    return nodes.sparkSession.createDataFrame(rows, "round int, messages long, received long, saved long, missing long, mass double")


def pagerank_resumable(nodes: DataFrame, edges: DataFrame, base: str, end: int, alpha: float = ALPHA, keep: int = 1) -> DataFrame:
    """The ranks of ``pagerank`` after ``end`` iterations, from the last round that is committed below ``base``.

    A lost driver goes on there: rounds committed by then aren't run again, and neither the nodes nor the edges need be
    built again, as round 0 keeps them.  The last ``keep`` rounds stay for later calls; an ``end`` before them is an error.
    """
    rounds = Rounds(nodes.sparkSession, base, keep)
    done = rounds.committed()
    if not done:
        n = nodes.count()
        if not n:
            return nodes.select("id", F.lit(0.0).alias("rank"))
        # the uniform start as a table of what arrived: nothing, and all of the mass is missing
        first = nodes.select("id", F.lit(1.0 / n).alias("inc"))
        rounds.commit(0, rounds.write(first, "inc"), n=n, mass=None, nodes=rounds.write(nodes.select("id"), "nodes"), shares=rounds.write(_shares(edges), "shares"))
        done = [0]
    if done[-1] > end and end not in done:
        raise ValueError(f"round {end} is gone; the rounds from {done[0]} to {done[-1]} are kept")
    at = max(k for k in done if k <= end)
    facts = rounds.facts(at)
    n, shares, known = facts["n"], rounds.read(facts["shares"]), rounds.read(facts["nodes"])

    def ranks() -> DataFrame:
        return rounds.table(at).withColumnRenamed("inc", "rank") if at == 0 else _next(rounds.table(at), n, alpha, facts["mass"])

    while at < end:
        inc, seen = _step(known, shares, ranks())
        data = rounds.write(inc, "inc")
        rounds.commit(at + 1, data, **{k: facts[k] for k in ("n", "nodes", "shares")}, **seen.get)
        at += 1
        facts = rounds.facts(at)
    return ranks()


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int, alpha: float = ALPHA) -> DataFrame:
    """(id, rank) after a fixed number of iterations from the uniform start.

    inc(v) = sum of r(u) / outdegree(u); miss = 1 - sum of inc over nodes, not below 0;
    r'(v) = alpha / N + (1 - alpha) (inc(v) + miss / N).
    """
    if nodes.isEmpty():
        return nodes.select("id", F.lit(0.0).alias("rank"))
    return next(islice(_rounds(nodes, edges, alpha), iterations, None))


def pagerank_copartitioned(nodes: DataFrame, edges: DataFrame, iterations: int, alpha: float = ALPHA, hub_edges: int = HUB_EDGES) -> DataFrame:
    """The ranks of ``pagerank``; only messages are shuffled, never the edges or the ranks.

    Edges are bucketed by source once, each round's ranks by id as they are written.  Sources of more than ``hub_edges``
    edges stay outside the buckets, so that none of them makes one long task.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    hub = 1.0 / F.col("share") > hub_edges + 0.5
    shares = materialise(_shares(edges), "shares")
    light, heavy = bucketed(shares.where(~hub), "edges", "src"), materialise(shares.where(hub), "hubs")
    discard(shares)
    parts = [light] if heavy.isEmpty() else [light, heavy]
    known = bucketed(nodes.select("id"), "nodes", "id")
    ranks, old = known.select("id", F.lit(1.0 / n).alias("rank")), []
    for _ in range(iterations):
        from_each = [p.join(ranks, p["src"] == ranks["id"]).select("dst", (F.col("share") * F.col("rank")).alias("mass")) for p in parts]
        sent = from_each[0] if len(parts) == 1 else from_each[0].unionByName(from_each[1])
        sent = sent.groupBy(F.col("dst").alias("id")).agg(F.sum("mass").alias("inc"))
        seen = Observation()
        inc = bucketed(known.join(sent, "id", "left").select("id", F.coalesce("inc", F.lit(0.0)).alias("inc")).observe(seen, F.sum("inc").alias("mass")), "inc", "id")
        discard(*old)
        ranks, old = _next(inc, n, alpha, seen.get["mass"]), [inc]
    return ranks


#: Sources whose ranks stand in one row of a node.
CHUNK = 32


def _present(nodes: DataFrame, sources: list[int]) -> list[int]:
    """The sources that are nodes, each once, in order."""
    known = {r[0] for r in nodes.where(F.col("id").isin(sources)).select("id").distinct().collect()}
    return [s for s in dict.fromkeys(sources) if s in known]


def _all_present(nodes: DataFrame, sources: list[int]) -> list[int]:
    known = _present(nodes, sources)
    if missing := set(sources) - set(known):
        raise ValueError(f"not in the graph: {sorted(missing)}")
    return known


def _personal_rounds(nodes: DataFrame, edges: DataFrame, sources: list[int], alpha: float) -> Iterator[DataFrame]:
    """(id, chunk, pairs map<position, rank>) at the start and after each iteration, of the nodes that any source of the
    chunk reaches: a row a node, with the sources that reach it only.  A round's table goes once the next one is written.

    Messages carry a node's pairs; they are summed position by position, partially before the shuffle.
    """
    spark = nodes.sparkSession
    width = min(CHUNK, len(sources))
    kinds = "id long, chunk int, pairs map<int,double>"
    at_home = lambda value: spark.createDataFrame([(int(s), i // CHUNK, {i % CHUNK: value}) for i, s in enumerate(sources)], kinds)
    place = {s: i for i, s in enumerate(sources)}
    ranks, old = at_home(1.0), []
    yield ranks
    shares, ids = materialise(_shares(edges), "shares"), nodes.select(F.col("id").cast("long").alias("id"))
    own = F.try_element_at(F.create_map(*[F.lit(x).cast("long") for s, i in place.items() for x in (s, i)]), F.col("id"))  # a source's position
    while True:
        sent = shares.join(ranks.withColumnRenamed("id", "src"), "src").select(F.col("dst").cast("long").alias("id"), "chunk", "share", "pairs")
        sent = sent.unionByName(at_home(0.0).withColumn("share", F.lit(0.0)))
        value = lambda i: F.sum(F.col("share") * F.coalesce(F.try_element_at("pairs", F.lit(i)), F.lit(0.0))).alias(f"v{i}")
        sums = sent.groupBy("id", "chunk").agg(*[value(i) for i in range(width)]).join(ids, "id", "left_semi")
        seen = Observation()
        metrics = [F.sum(F.when(F.col("chunk") == i // CHUNK, F.col(f"v{i % CHUNK}"))).alias(f"m{i}") for i in range(len(sources))]
        entries = F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"v{i}").alias("v")) for i in range(width)])
        kept = F.filter(entries, lambda e: (e["v"] > 0) | (F.col("chunk") * CHUNK + e["k"]).eqNullSafe(own))
        inc = materialise(sums.observe(seen, *metrics).select("id", "chunk", F.map_from_entries(kept).alias("pairs")).where(F.size("pairs") > 0), "inc")
        discard(*old)
        lost = F.array(*[F.lit(max(0.0, 1.0 - (seen.get[f"m{i}"] or 0.0))) for i in range(len(sources))])
        here = alpha + (1 - alpha) * F.element_at(lost, (own + 1).cast("int"))
        ranks = inc.select("id", "chunk", F.transform_values("pairs", lambda k, v: (1 - alpha) * v + F.when((F.col("chunk") * CHUNK + k).eqNullSafe(own), here).otherwise(0.0)).alias("pairs"))
        old = [inc]
        yield ranks


def _long(ranks: DataFrame, sources: list[int]) -> DataFrame:
    names = F.array(*[F.lit(int(s)).cast("long") for s in sources])
    return ranks.select("id", "chunk", F.explode("pairs").alias("k", "rank")).select(names[F.col("chunk") * CHUNK + F.col("k")].alias("source"), "id", "rank")


def personalised_reached(nodes: DataFrame, edges: DataFrame, sources: list[int], iterations: int, alpha: float = ALPHA) -> DataFrame:
    """(source, id, rank) for every source in one run, of the nodes that it reaches.

    At the source r' = alpha + (1 - alpha) (inc + miss), elsewhere (1 - alpha) inc.  The sources are a short list; one
    that isn't a node reaches nothing and has no row.
    """
    sources = _present(nodes, sources)
    if not sources:
        return nodes.sparkSession.createDataFrame([], "source long, id long, rank double")
    return _long(next(islice(_personal_rounds(nodes, edges, sources, alpha), iterations, None)), sources)


def personalised(nodes: DataFrame, edges: DataFrame, sources: list[int], iterations: int, alpha: float = ALPHA) -> DataFrame:
    """(source, id, rank) as above for all nodes, 0 where a source doesn't reach; a source that isn't a node is an error."""
    sources = _all_present(nodes, sources)
    return _all_nodes(nodes, personalised_reached(nodes, edges, sources, iterations, alpha), sources)


def _all_nodes(nodes: DataFrame, reached: DataFrame, sources: list[int]) -> DataFrame:
    each = nodes.select(F.explode(F.array(*[F.lit(int(s)).cast("long") for s in sources])).alias("source"), F.col("id").cast("long").alias("id"))
    return each.join(reached, ["source", "id"], "left").select("source", "id", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def top(ranks: DataFrame, n: int) -> DataFrame:
    return ranks.orderBy(F.desc("rank"), "id").limit(n)


def top_per_source(ranks: DataFrame, n: int) -> DataFrame:
    order = W.partitionBy("source").orderBy(F.desc("rank"), "id")
    return ranks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def dump_top(ranks: DataFrame, n: int) -> DataFrame:
    """(source, place, line): the best nodes of each source as lines ``rank id``, the best first."""
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("rank"), "id"))
    return ranks.withColumn("place", place).where(F.col("place") <= n).select("source", "place", F.format_string("%.5f %d", F.col("rank"), F.col("id")).alias("line"))


def range_partition(nodes: DataFrame, partitions: int) -> DataFrame:
    """(bucket, n): dense ids dealt to ranges, int(id / count * partitions) modulo partitions."""
    count = nodes.count()
    bucket = F.pmod(F.floor(F.col("id") * partitions / F.lit(float(max(count, 1)))).cast("long"), F.lit(partitions).cast("long"))
    return nodes.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def repartition_graph(nodes: DataFrame, partitions: int, by_range: bool) -> DataFrame:
    return nodes.repartitionByRange(partitions, "id") if by_range else nodes.repartition(partitions, "id")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_components, n_edges, n_nodes): components over undirected edges; a node without edges is one, and the end of an
    edge is a node even without a record."""
    roots = connected_components(edges, "src", "dst")
    nodes = nodes.select("id").unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    each = nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").agg(F.countDistinct(F.coalesce("root", "id")).alias("n_components"), F.count(F.lit(1)).alias("n_nodes"))
    n = edges.distinct().count()
    return each.select("n_components", F.lit(n).cast("long").alias("n_edges"), "n_nodes")


def sequential_pagerank(nodes: DataFrame, edges: DataFrame, jump: float = ALPHA, tolerance: float = 1e-9, most: int = 200) -> DataFrame:
    """(id, rank) of distinct edges, iterated until no rank moves by more than the tolerance in eight rounds."""
    return _settled(_rounds(nodes, edges.distinct(), jump), tolerance, most, ["id"])


def sequential_personalised(nodes: DataFrame, edges: DataFrame, source: int, jump: float = ALPHA, tolerance: float = 1e-9, most: int = 200) -> DataFrame:
    """(id, rank) from one source, of distinct edges, iterated as above."""
    rounds = (_long(r, [source]) for r in _personal_rounds(nodes, edges.distinct(), _all_present(nodes, [source]), jump))
    return _all_nodes(nodes, _settled(rounds, tolerance, most, ["source", "id"]), [source]).drop("source")


def _settled(rounds: Iterator[DataFrame], tolerance: float, most: int, keys: list[str], step: int = 8) -> DataFrame:
    last = materialise(next(rounds), "ranks")
    for _ in range(0, most, step):
        now = materialise(next(islice(rounds, step - 1, None)), "ranks")
        change = F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
        moved = now.join(last.withColumnRenamed("rank", "before"), keys, "full").agg(F.max(change)).first()[0]
        discard(last)
        last = now
        if moved is None or moved <= tolerance:
            return last
    raise RuntimeError(f"ranks moved by {moved} after {most} rounds")


def dump(ranks: DataFrame, edges: DataFrame, neighbours: int = 10) -> DataFrame:
    """(line): ``{id rank [neighbours]}`` with the first neighbours by id; ranks among neighbours are cut before lists are made."""
    place = F.row_number().over(W.partitionBy("src").orderBy("dst"))
    first = edges.withColumn("place", place).where(F.col("place") <= neighbours).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("adj"))
    rows = ranks.join(first, ranks["id"] == first["src"], "left")
    adjacent = F.coalesce(F.array_join(F.transform("adj", lambda x: x.cast("string")), ", "), F.lit(""))
    return rows.select(F.format_string("{%d %.4f [%s]}", F.col("id"), F.col("rank"), adjacent).alias("line"))
