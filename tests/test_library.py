"""Hand fixtures and invariants."""

import math
from collections import Counter
from itertools import combinations
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.text import clean, first_words, head_parts, head_words, raw_tokens, snippet, tokens
from sparkloom.operators import classify, graph, log_ranks, meetings, search, text_stats
from sparkloom.operators.joins import connected_components
from sparkloom.plans import oracle, registry
from sparkloom.sources import shared, tables


def test_tokens(spark):
    row = spark.createDataFrame([("  Father's, --THE  42 x9 Été ",)], "text string").select(tokens("text").alias("t")).first()
    assert row.t == ["father's", "the", "x", "t"]


def test_first_words_go_on_past_an_empty_one(spark):
    names = [a + b + "q" for a in "abcdefghij" for b in "abcdefghij"]
    text = " ".join(names[:99] + ["42", "survivor", "late"])
    got = spark.createDataFrame([(text,)], "text string").select(raw_tokens("text").alias("r")).select(first_words(F.col("r")).alias("w")).first().w
    assert got == names[:99] + ["survivor"]


def test_shares_take_each_sum_once(spark):
    """A word with very many successors: a sum taken for every successor would need 10**10 steps."""
    import time

    n = 100_000
    text = spark.range(n).agg(F.array_join(F.collect_list(F.concat(F.lit("hub w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))), " ").alias("text"))
    start = time.monotonic()
    got = text_stats.bigram_stripe_shares(text).where("a = 'hub'").select(F.size("shares").alias("n"), F.element_at("shares", "wa").alias("share")).first()
    assert (got.n, got.share) == (n, 1 / n) and time.monotonic() - start < 60


ODD_TEXTS = ["", " ", "a", "-", " 1'a--b'' x9 9x", "\n\ta\r\fb\x0bc ", "42 " * 120 + "late later", "x " * 98 + "7 8 9 y", "w " * 99 + "7", "é-É aéb İI \u212aelvin", None]


def test_tokens_are_found_without_a_function_on_each(spark):
    rows = spark.createDataFrame([(t,) for t in ODD_TEXTS], "text string")
    plain = F.filter(F.transform(raw_tokens("text"), clean), lambda x: x != "")
    got = rows.select("text", tokens("text").alias("t"), plain.alias("p"))
    assert all(r.t == r.p for r in got.collect())
    assert "lambda" not in got.select("t")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("at", [1, 2, 99, 100])
def test_head_words(spark, at):
    rows = spark.createDataFrame([(t,) for t in ODD_TEXTS if t is not None], "text string")
    got = rows.select(head_words(head_parts("text", at), at).alias("h"), first_words(raw_tokens("text"), at).alias("f"))
    assert all(r.h == r.f for r in got.collect())


def test_pair_counts_in_bounded_memory(spark, monkeypatch):
    monkeypatch.setattr(text_stats, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(text_stats, "PAIRS_HELD", 120)
    lists = [sorted({(k * i * i + 3 * i) % 41 for i in range(k % 23)}) for k in range(60)] + [[], [5]]
    want = Counter(x * 41 + y for ids in lists for x, y in combinations(ids, 2))
    rows = spark.createDataFrame([(ids,) for ids in lists], "ids array<long>").repartition(3)
    got = text_stats.pair_counts(rows, 41)
    assert {r.code: r.n for r in got.collect()} == want
    # a task tells counts, not pairs
    one = text_stats.pair_counts(spark.createDataFrame([([1, 2, 3],)] * 40, "ids array<long>").coalesce(1), 41)
    assert sorted(r.n for r in one.collect()) == [40, 40, 40]
    assert text_stats.pair_counts(rows.limit(0), 1).count() == 0


def test_pmi_without_frequent_words(spark):
    assert text_stats.pmi_pairs(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")).count() == 0


def test_snippet(spark):
    rows = spark.createDataFrame([("a" * 81 + "\nb",), ("short\nnext",)], "text string").select(snippet("text").alias("s")).collect()
    assert [r.s for r in rows] == ["a" * 80 + "...", "short"]


def test_few_records_have_no_pmi(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(9)], "doc_id long, text string")
    assert text_stats.pmi_pairs(docs).count() == 0


def test_pmi_is_symmetric_and_frequencies_sum_to_one(spark, sf):
    docs = tables.load(spark, sf, "documents")
    pmi = {(r.x, r.y): r.pmi for r in text_stats.pmi_pairs(docs).collect()}
    assert pmi and all(pmi[y, x] == v for (x, y), v in pmi.items())
    worst = text_stats.bigram_relfreq_pairs(docs).groupBy("a").agg(F.abs(F.sum("freq") - 1).alias("d")).agg(F.max("d")).first()[0]
    assert worst < 1e-4


def _plain_pmi(texts, least=10):
    """(x, y) -> (n, pmi), by brute force over the words of whole texts."""
    sets = [set(t.split()) for t in texts]
    one = Counter(w for s in sets for w in s)
    two = Counter((x, y) for s in sets for x in s for y in s if x != y)
    return {(x, y): (n, round(math.log10(n * len(texts) / (one[x] * one[y])), 6)) for (x, y), n in two.items() if n >= least}


LATE_TEXTS = [" ".join(f"w{chr(97 + i % 7)}{chr(97 + k)}x" for k in range(18)) + " 7" * 120 + (" late later" if i % 3 else " late") + " 8" * 300 + " last" for i in range(90)]


def _small_blocks(monkeypatch):
    for name, value in (("BLOCK_MEETINGS", 300), ("PACKED", 100), ("RANGES", 16), ("AT_ONCE", 5)):
        monkeypatch.setattr(meetings, name, value)
    monkeypatch.setattr(text_stats, "ROWS_AT_ONCE", 50)


def test_pmi_pairs_takes_whole_texts(spark, monkeypatch):
    _small_blocks(monkeypatch)
    docs = spark.createDataFrame(list(enumerate(LATE_TEXTS)) + [(90, None), (91, "")], "doc_id long, text string").repartition(3)
    want = _plain_pmi([*LATE_TEXTS, "", ""])
    want = {k: v for k, v in want.items() if not {"7", "8"} & set(k)}
    assert ("later", "last") in want and ("wbcx", "late") in want
    rows = text_stats.pmi_pairs(docs).collect()
    assert len(rows) == len(want) and {(r.x, r.y): (r.n, r.pmi) for r in rows} == want


def test_pmi_stripes_takes_whole_texts(spark, monkeypatch):
    _small_blocks(monkeypatch)
    docs = spark.createDataFrame(list(enumerate(LATE_TEXTS)), "doc_id long, text string").repartition(3)
    want = {}
    for (x, y), (n, pmi) in _plain_pmi(LATE_TEXTS).items():
        if not {"7", "8"} & {x, y}:
            k, total, most = want.get(x, (0, 0, -math.inf))
            want[x] = k + 1, total + n, max(most, pmi)
    assert "later" in want
    assert {r.x: (r.n_successors, r.total, r.max_pmi) for r in text_stats.pmi_stripes(docs).collect()} == want


def test_decode_gives_the_index_back_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    docs = spark.createDataFrame([(i, "the cat" if i % 2 else "the dog the") for i in range(20)], "doc_id long, text string")
    want = {tuple(r) for r in search.index_long(docs).collect()}
    assert {(r.term, r.doc_id, r.tf) for r in search.decode(search.encode(docs)).collect()} == want
    gaps = sorted((r.doc_id, r.gap) for r in search.index_gaps(docs).where("term = 'the'").collect())
    assert gaps == [(i, min(i, 1)) for i in range(20)]


def test_rpn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "b c"), (4, "d")], "doc_id long, text string")
    ids = lambda q: sorted(r.doc_id for r in search.search(docs, q).collect())
    assert ids("a b OR c AND") == [3] and ids("a") == [1] and ids("nothing") == [] and ids("nothing d OR") == [4]
    with pytest.raises(ValueError):
        search.compile_rpn("a AND")


def _toy(spark):
    lines = spark.createDataFrame([("1 2 3",), ("2\t3",), ("3",), ("4 1 9",), ("",)], "value string")
    return tables.parse_adjacency(lines)


def test_pagerank_toy(spark):
    nodes, edges = _toy(spark)
    got = {r.id: r["rank"] for r in graph.pagerank(nodes, edges, 5).collect()}
    assert math.isclose(sum(got.values()), 1, abs_tol=1e-12)
    assert [round(got[i], 5) for i in (1, 2, 3, 4)] == [0.20336, 0.22928, 0.42500, 0.14236]
    stats = graph.graph_stats(nodes, edges).first()
    assert (stats.n_nodes, stats.n_edges, stats.n_active, stats.n_missing) == (4, 5, 3, 1)


@pytest.mark.parametrize("hub_edges", [1, 1 << 20])
def test_copartitioned_ranks_are_the_same(spark, hub_edges):
    nodes, edges = _toy(spark)
    want = {r.id: r["rank"] for r in graph.pagerank(nodes, edges, 5).collect()}
    got = {r.id: r["rank"] for r in graph.pagerank_copartitioned(nodes, edges, 5, hub_edges=hub_edges).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-12) for i in want)
    assert graph.pagerank_copartitioned(nodes.limit(0), edges.limit(0), 5).count() == 0


def test_copartitioned_tables_shuffle_messages_only(spark, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = shared.bucketed(spark.range(100).selectExpr("id % 10 src", "id dst", "0.1D share"), "edges", "src")
        ranks = shared.bucketed(spark.range(100).selectExpr("id", "0.01D rank"), "ranks", "id")
        sent = edges.join(ranks, edges["src"] == ranks["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("inc"))
        ranks.select("id").join(sent, "id", "left").explain()
        assert capsys.readouterr().out.count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_discard_deletes_written_tables_only(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/own")
    own, written, buckets = spark.read.parquet(f"{tmp_path}/own"), shared.materialise(spark.range(3), "t"), shared.bucketed(spark.range(3), "b", "id")
    files = [f for d in (own, written, buckets) for f in d.inputFiles()]
    shared.discard(own, written, buckets)
    left = [f for f in files if Path(urlparse(f).path).exists()]
    assert left and all("/own/" in f for f in left)


def test_personalised_toy(spark):
    nodes, edges = _toy(spark)
    got = {r.id: round(r["rank"], 6) for r in graph.personalised(nodes, edges, [1], 1).collect()}
    assert got == {1: 0.15, 2: 0.425, 3: 0.425, 4: 0.0}
    with pytest.raises(ValueError):
        graph.personalised(nodes, edges, [77], 1)


def test_a_source_without_a_record_reaches_nothing(spark, tmp_path):
    nodes, edges = _toy(spark)
    with_it, without = (sorted(map(tuple, graph.personalised_reached(nodes, edges, s, 2).collect())) for s in ([77, 1, 78, 2], [1, 2]))
    assert with_it == without and {r[0] for r in with_it} == {1, 2}
    assert graph.personalised_reached(nodes, edges, [77], 2).count() == 0
    assert {(r.id, r.log_rank) for r in log_ranks.personalised(nodes, edges, 77, 2).collect()} == {(i, None) for i in (1, 2, 3, 4)}


@pytest.mark.parametrize("name", ["ppr_dump", "ppr_vectors", "ppr_vectors_top"])
def test_a_large_part_among_the_sources(spark, sf, tmp_path, name):
    import duckdb

    duck = duckdb.connect()
    for table in ("customer", "orders", "lineitem", "part"):
        rows = spark.read.parquet(f"{sf}/{table}.parquet")
        if table == "part":  # source 7 has no record
            rows = rows.withColumn("p_size", F.when(F.col("p_partkey") == 3, 50).otherwise(F.col("p_size")))
        rows.write.parquet(f"{tmp_path}/{table}.parquet")
        duck.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), duck.execute(oracle.SQL[name]).df()
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].itertuples(index=False)))
    assert rows(got) == rows(want) and set(got.source) == {0, 2, 4, 1, 40}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (70, 70)] + [(100, k) for k in range(101, 140)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {55: 50, 60: 50} | {k: 100 for k in range(101, 140)}
    assert connected_components(edges.limit(0)).count() == 0


def test_training_matches_plain_gradient_steps(spark):
    rows = [(i, "spam" if i % 3 == 0 else "ham", [i % 5, 7, 7]) for i in range(30)]
    got = {r.feature: r.weight for r in classify.train(spark.createDataFrame(rows, "doc_id long, label string, features array<int>")).collect()}
    w: dict[int, float] = {}
    for _, label, fs in rows:
        s = sum(w.get(f, 0) for f in fs)
        for f in fs:
            w[f] = w.get(f, 0) + ((label == "spam") - 1 / (1 + math.exp(-s))) * 0.002
    assert got.keys() == w.keys() and all(math.isclose(got[k], w[k], rel_tol=1e-12) for k in w)


def test_the_training_task_reads_packed_rows(spark):
    """1,000 features a row are read by the one task in under two bytes each; odd rows count as before."""
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "spam").otherwise("ham").alias("label"),
                                   F.expr("transform(sequence(1, 1000), i -> cast(pmod(xxhash64(id, i), 20000) as int))").alias("features"))
    batches = [b for b in rows.select("doc_id", "doc_id", F.lit(True), "features").toArrow().to_batches()]
    assert sum(len(x) for b in classify._pack(iter(batches)) for x in b.column(3).to_pylist()) < 2 * 200 * 1000 * 1.5
    odd = spark.createDataFrame([(1, "spam", [5, 5, 0]), (2, None, []), (3, "ham", None), (4, "spam", [2**20 - 1])], "doc_id long, label string, features array<int>")
    for seed in (None, 42):
        got = {r.feature: r.weight for r in classify.train(odd, seed).collect()}
        assert got.keys() == {0, 5, 2**20 - 1} and math.isclose(got[5], 2 * got[0], rel_tol=1e-12)


def test_vote_counts_zero_as_against(spark):
    inst = spark.createDataFrame([(1, "spam", [1])], "doc_id long, label string, features array<int>")
    models = spark.createDataFrame([(1, 1, 0.0), (2, 1, 2.0), (3, 1, -1.0)], "model_id int, feature int, weight double")
    assert classify.apply_ensemble(inst, models, "vote").first().score == -1.0
    assert round(classify.apply_ensemble(inst, models, "average").first().score, 6) == 0.333333


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "nation.tbl").write_text("0|ALGERIA|0|x|\n1|ARGENTINA|1|y|\n")
    assert [tuple(r) for r in tables.read_tbl(spark, str(tmp_path / "nation.tbl"), "nation").collect()] == [(0, "ALGERIA"), (1, "ARGENTINA")]
    lines = spark.createDataFrame([("d1 spam 3 4 4",)], "value string")
    assert tuple(tables.parse_instances(lines).first()) == ("d1", "spam", [3, 4, 4])
    df = spark.createDataFrame([("b", 2), ("a", 1)], "word string, n long")
    tables.write_tsv(df, str(tmp_path / "out"))
    tables.write_tsv(df, str(tmp_path / "out"))
    assert tables.read_lines(spark, str(tmp_path / "out")).count() == 2
    tables.write_sorted(df, str(tmp_path / "sorted"), "word")
    assert spark.read.parquet(str(tmp_path / "sorted")).where("word = 'a'").first().n == 1
    for _ in range(2):
        tables.replace_table(df, "counts_test")
    assert spark.table("counts_test").count() == 2


def test_models_of_either_form(spark):
    lines = spark.createDataFrame([("(3,0.5)",), ("4\t-1.25E-3",), ("",)], "value string")
    assert [tuple(r) for r in tables.parse_model(lines).collect()] == [(3, 0.5), (4, -0.00125)]


def test_date_prefixes_reach_the_scan(spark, sf, capsys):
    tables.load(spark, sf, "lineitem").where(tables.prefix_range("l_shipdate", "1996-12")).select("l_tax").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan and "l_comment" not in plan


def test_sequential_ranks_settle(spark):
    nodes, edges = _toy(spark)
    got = {r.id: r["rank"] for r in graph.sequential_pagerank(nodes, edges).collect()}
    assert math.isclose(sum(got.values()), 1, abs_tol=1e-9)


def _random_graph(spark, n=60, m=300, seed=2):
    import random

    r = random.Random(seed)
    edges = [(r.randrange(n - 10), r.randrange(n + 5)) for _ in range(m)]  # some dangle, some ids have no record
    return spark.range(n).select("id"), spark.createDataFrame(edges, "src long, dst long"), edges


def _plain_ranks(n, edges, k, source=None, alpha=0.15):
    out = {}
    for s, d in edges:
        out.setdefault(s, []).append(d)
    r = {i: (1 / n if source is None else float(i == source)) for i in range(n)}
    for _ in range(k):
        inc = dict.fromkeys(range(n), 0.0)
        for s, ds in out.items():
            for d in ds:
                if d in inc:
                    inc[d] += r[s] / len(ds)
        miss = max(0.0, 1 - sum(inc.values()))
        r = {i: alpha / n + (1 - alpha) * (x + miss / n) if source is None else (1 - alpha) * x + (i == source) * (alpha + (1 - alpha) * miss) for i, x in inc.items()}
    return r


@pytest.mark.parametrize("chunk", [32, 2])
def test_vectors_of_many_sources_are_single_runs(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    nodes, edges, plain = _random_graph(spark)
    sources = [3, 17, 55, 8, 3]
    got = {(r.source, r.id): r["rank"] for r in graph.personalised(nodes, edges, sources, 3).collect()}
    want = {(s, i): x for s in sources for i, x in _plain_ranks(60, plain, 3, s).items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    reached = {(r.source, r.id) for r in graph.personalised_reached(nodes, edges, sources, 3).collect()}
    assert reached == {k for k, x in want.items() if x > 0}
    rows = next(r for i, r in enumerate(graph._personal_rounds(nodes, edges, [3, 17, 55, 8], 0.15)) if i == 2)
    assert rows.count() <= len({(i // chunk, k) for i, s in enumerate([3, 17, 55, 8]) for k, x in _plain_ranks(60, plain, 2, s).items() if x > 0})


def test_a_lost_driver_goes_on(spark, tmp_path, monkeypatch):
    nodes, edges, plain = _random_graph(spark)
    base, steps, step = f"file://{tmp_path}/ranks", [], graph._step

    def lost(*args):
        if len(steps) == 2:
            raise KeyboardInterrupt
        steps.append(1)
        return step(*args)

    monkeypatch.setattr(graph, "_step", lost)
    with pytest.raises(KeyboardInterrupt):
        graph.pagerank_resumable(nodes, edges, base, 4)
    (tmp_path / "ranks" / "inc-lost").mkdir()  # what a lost attempt leaves is no round
    monkeypatch.setattr(graph, "_step", lambda *a: steps.append(2) or step(*a))
    got = {r.id: r["rank"] for r in graph.pagerank_resumable(nodes.limit(0), edges.limit(0), base, 4).collect()}
    want = _plain_ranks(60, plain, 4)
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-12) for i in want)
    assert steps == [1, 1, 2, 2]
    graph.pagerank_resumable(nodes, edges, base, 4)
    assert steps == [1, 1, 2, 2] and [p.name for p in (tmp_path / "ranks/rounds").glob("*.json")] == ["000004.json"]
    assert len(list((tmp_path / "ranks").glob("inc-*"))) == 2  # the last round and the lost attempt
    with pytest.raises(ValueError):
        graph.pagerank_resumable(nodes, edges, base, 2)


def test_counters_are_observed_in_passing(spark):
    nodes, edges, plain = _random_graph(spark)
    rows = graph.pagerank_counters(nodes, edges, 3).collect()
    n, to = sum(s < 60 for s, _ in plain), {d for s, d in plain if s < 60}
    assert [(r.round, r.messages, r.received, r.saved, r.missing) for r in rows] == [(k, n, len(to), n - len(to), len({d for d in to if d >= 60})) for k in (1, 2, 3)]
    assert graph.pagerank_counters(nodes.limit(0), edges, 2).count() == 0


def test_log_ranks(spark):
    from sparkloom.operators import log_ranks

    nodes, edges, plain = _random_graph(spark)
    got = {r.id: r.log_rank for r in log_ranks.pagerank(nodes, edges, 3).collect()}
    assert all(math.isclose(math.exp(got[i]), x, rel_tol=1e-10) for i, x in _plain_ranks(60, plain, 3).items())
    got = {r.id: r.log_rank for r in log_ranks.personalised(nodes, edges, 3, 3).collect()}
    want = _plain_ranks(60, plain, 3, 3)
    assert all(got[i] is None if x == 0 else math.isclose(math.exp(got[i]), x, rel_tol=1e-10) for i, x in want.items())
    # many far-apart buckets, and ranks that a double can't hold
    rows = spark.createDataFrame([(1, -800.0), (1, -800.0), (1, -5000.0), (2, -2000.5), (3, 650.0), (3, 650.0), (4, None)], "k int, x double")
    sums = {r.k: r.x for r in log_ranks.log_sum(rows, "k", "x").collect()}
    assert sums.keys() == {1, 2, 3} and all(math.isclose(sums[k], v) for k, v in {1: -800 + math.log(2), 2: -2000.5, 3: 650 + math.log(2)}.items())
    fan = 10**50
    shares = spark.createDataFrame([(i, i + 1, 1.0 / fan) for i in range(7)], "src long, dst long, share double")
    ranks = spark.range(8).select("id", F.when(F.col("id") == 0, 0.0).alias("log_rank"))
    for _ in range(7):
        ranks = log_ranks._arrived(spark.range(8), shares, ranks)[0].withColumnRenamed("inc", "log_rank")
    assert math.isclose(ranks.where("id = 7").first().log_rank, -7 * math.log(fan))


def test_ranks_that_do_not_settle_raise(spark):
    nodes, edges = _toy(spark)
    with pytest.raises(RuntimeError):
        graph.sequential_pagerank(nodes, edges, tolerance=-1.0, most=8)


@pytest.mark.parametrize("by_range", [True, False])
def test_partitioned_graph_has_the_same_ranks(spark, by_range):
    from sparkloom.operators import partitions

    nodes, edges, plain = _random_graph(spark)
    got = {r.id: r["rank"] for r in partitions.pagerank(nodes, edges, 3, 4, by_range).collect()}
    want = _plain_ranks(60, plain, 3)
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-12) for i in want)
    assert partitions.pagerank(nodes.limit(0), edges.limit(0), 3).count() == 0


def test_only_crossing_messages_are_shuffled(spark, capsys):
    from sparkloom.operators import partitions

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes, edges, _ = _random_graph(spark)
        g = partitions.write(nodes, edges, 4, True)
        with partitions._with(spark, partitions.COLOCATED):
            partitions._round(g, g.nodes.withColumn("rank", F.lit(0.1)))[0].explain()
        assert capsys.readouterr().out.count("Exchange") == 1
        clusters = spark.createDataFrame([(i, (i // 15) * 15 + (i + 1) % 15) for i in range(60)], "src long, dst long")
        got = {r.strategy: (r.inside, r.shuffled) for r in partitions.messages(spark.range(60), clusters, 4).collect()}
        assert got["range"] == (60, 0) and got["modulo"][1] > 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
