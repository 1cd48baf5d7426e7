"""The registered queries, at fixed parameters, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import feature_id, tokens
from sparkloom.operators import classify, graph, log_ranks, partitions, postings, relational, search, text_stats
from sparkloom.sources import lines, tables
from sparkloom.sources.keyed import KeyedTable
from sparkloom.sources.shared import materialise, new_path
from sparkloom.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
MONTH, YEAR, DAY = "1996-11", "1996", "1996-11-01"


def _docs(f: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: f(load(spark, sf_dir, "documents"), *args)


def _tables(f: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: f(partial(load, spark, sf_dir), *args)


def part_supplier(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts point to their suppliers; suppliers dangle.  Even ids are parts, odd ones suppliers."""
    t = partial(load, spark, sf_dir)
    edges = t("lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()
    return t("part").select((F.col("p_partkey") * 2).alias("id")).unionByName(t("supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"))), edges


def nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Supplier nations point to customer nations, thinned by residues so that some dangle and components differ."""
    t = partial(load, spark, sf_dir)
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).where("(s_nationkey * 7 + c_nationkey * 3) % 5 = 0 and s_nationkey % 4 <> 3")
    edges = rows.select(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).distinct()
    return t("nation").select(F.col("n_nationkey").cast("long").alias("id")), edges


def purchases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers (even ids) point to the parts (odd ids) that they ordered, parts to customers who returned many of them.

    Large parts have no record, so messages to them vanish; parts that nobody returned dangle.
    """
    t = partial(load, spark, sf_dir)
    lines = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    lines = lines.select((F.col("o_custkey") * 2).alias("c"), (F.col("l_partkey") * 2 + 1).alias("p"), (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    lines = materialise(lines.toDF("c", "p", "back").groupBy("c", "p").agg(F.bool_or("back").alias("back")), "lines")
    edges = lines.select(F.col("c").alias("src"), F.col("p").alias("dst")).unionByName(lines.where("back").select(F.col("p").alias("src"), F.col("c").alias("dst")))
    kept = t("part").where("p_size < 45").select((F.col("p_partkey") * 2 + 1).alias("id"))
    return t("customer").select((F.col("c_custkey") * 2).alias("id")).unionByName(kept), edges


def pagerank_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds, then a third by a call that finds them below the same folder."""
    base, (nodes, edges) = new_path(spark, "rounds"), part_supplier(spark, sf_dir)
    graph.pagerank_resumable(nodes, edges, base, 2)
    return graph.pagerank_resumable(nodes, edges, base, 3)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.round("rank", 8))


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    label = F.when(F.col("quality") == 0, "spam").otherwise("ham")
    return materialise(docs.select("doc_id", label.alias("label"), F.transform(tokens("text"), feature_id).alias("features")), "instances")


def _models(instances: DataFrame) -> DataFrame:
    """Three made-up models over two thirds of the features."""
    vocab = instances.select(F.explode("features").alias("feature")).distinct().where("feature % 3 <> 0")
    rows = vocab.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("model_id"), "feature")
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("model_id").cast("string"), F.col("feature").cast("string"))), 1, 4), 16, 10).cast("int")
    return rows.withColumn("weight", (digits % 2001 - 1000) / F.lit(1000.0))


def spam_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.train(_instances(spark, sf_dir), seed=42)


def spam_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _instances(spark, sf_dir)
    return classify.apply_model(rows, _models(rows).where("model_id = 1").drop("model_id"))


def spam_apply_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trainer's weights, written and read back, score the instances."""
    rows, path = _instances(spark, sf_dir), new_path(spark, "model")
    tables.write_tsv(classify.train(rows, seed=42), path)
    return classify.apply_model(rows, tables.parse_model(tables.read_lines(spark, path)))


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, doc_id, tf) of an index that is written sorted by term, so that a lookup reads few row groups."""
    path = new_path(spark, "index")
    search.write_index(load(spark, sf_dir, "documents"), path)
    return spark.read.parquet(path)


def stored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compressed index, written sorted by term and first document."""
    path = new_path(spark, "blocks")
    postings.write_blocks(load(spark, sf_dir, "documents"), path)
    return spark.read.parquet(path)


def bool_compressed(query: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.with_snippets(postings.matches(stored_blocks(spark, sf_dir), query), load(spark, sf_dir, "documents"))

    return run


def index_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each term, and what their columns say of it without decoding."""
    blocks = stored_blocks(spark, sf_dir).groupBy("term")
    return blocks.agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n").alias("df"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.sum("sum_tf").alias("sum_tf"))


def bigram_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's map of successors, written out in order."""
    entries = F.transform(F.map_entries("stripe"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return text_stats.bigram_stripes(load(spark, sf_dir, "documents")).select("a", F.array_join(entries, ",").alias("stripe"))


def delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table through a '|'-delimited file."""
    path, rows = new_path(spark, "tbl"), load(spark, sf_dir, "orders")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("string"), F.to_date("o_orderdate"), "o_orderpriority"]
    rows.select(*columns).write.csv(path, sep="|")
    return tables.read_tbl(spark, path, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderdate", "o_orderpriority")


def adjacency_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of parts and suppliers through adjacency lines: every node and its neighbours."""
    path, (nodes, edges) = new_path(spark, "adjacency"), part_supplier(spark, sf_dir)
    lists = nodes.join(edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("adj")), "id", "left")
    lists.select(F.concat_ws(" ", F.col("id").cast("string"), F.transform("adj", lambda x: x.cast("string"))).alias("value")).write.text(path)
    return graph.graph_build(*tables.parse_adjacency(tables.read_lines(spark, path)))


def instance_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled instances through text lines: features and their sum a document."""
    path = new_path(spark, "instances")
    _instance_lines(_instances(spark, sf_dir)).write.text(path)
    return _instance_sums(tables.parse_instances(tables.read_lines(spark, path)))


def _instance_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(" ", F.col("doc_id").cast("string"), "label", F.transform("features", lambda x: x.cast("string"))).alias("value"))


def _instance_sums(rows: DataFrame) -> DataFrame:
    total = F.aggregate("features", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "label", F.size("features").cast("long").alias("n_features"), total.alias("total"))


def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the texts through a text file, and their characters."""
    path = new_path(spark, "lines")
    load(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    return tables.read_lines(spark, path).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.char_length("value")).alias("n_chars"))


def spam_ensemble_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ensemble's votes by three written model files, read by one scan."""
    path, rows = new_path(spark, "models"), _instances(spark, sf_dir)
    tables.write_models(_models(rows), path, 3)
    return classify.apply_ensemble(rows, tables.read_models(spark, path), "vote")


def instances_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three written training sets as one."""
    paths, rows = [new_path(spark, "instances") for _ in range(3)], _instances(spark, sf_dir)
    for i, path in enumerate(paths):
        _instance_lines(rows.where(F.col("doc_id") % 3 == i)).write.text(path)
    return _instance_sums(tables.parse_instances(tables.read_lines(spark, *paths)))


def bigram_stripe_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's map of shares, as its size, its sum and its largest share."""
    shares = F.map_values("shares")
    total = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x)
    return text_stats.bigram_stripe_shares(load(spark, sf_dir, "documents")).select("a", F.size("shares").cast("long").alias("n"), F.round(total, 6).alias("total"), F.round(F.array_max(shares), 8).alias("most"), F.element_at(F.map_keys("shares"), 1).alias("b"), F.round(F.element_at(shares, 1), 8).alias("share"))


def bool_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the texts through text files, searched by an index of files and byte offsets, and fetched by those: each
    snippet and how many lines give it."""
    path = new_path(spark, "collection")
    load(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    rows = lines.read_keyed_lines(spark, path).withColumn("id", F.xxhash64("file"))  # postings carry a number in place of the path
    hits = search.matches(search.index_long(rows.withColumnRenamed("value", "text"), "id", "offset"), "the of AND de la AND OR nosuchterm OR", "id", "offset")
    files = spark.read.text(path).select(F.col("_metadata.file_path").alias("file")).distinct().withColumn("id", F.xxhash64("file"))
    return lines.fetch_lines(hits.join(files, "id")).groupBy("snippet").agg(F.count(F.lit(1)).alias("n"))


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed lines: how many there are, different keys, characters, and bytes up to the ends of all files."""
    path = new_path(spark, "lines")
    load(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    end = F.col("offset") + F.octet_length("value") + 1
    files = lines.read_keyed_lines(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("offset").alias("keys"), F.sum(F.char_length("value")).alias("chars"), F.max(end).alias("bytes"))
    return files.agg(F.sum("n").alias("n_lines"), F.sum("keys").alias("n_keys"), F.sum("chars").alias("n_chars"), F.sum("bytes").alias("n_bytes"))


def word_table(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """Word counts as cells: those of documents with even numbers first, then those of all, which replace them."""
    table, docs = KeyedTable.create(spark, new_path(spark, "cells"), buckets=16), load(spark, sf_dir, "documents")
    for part in (docs.where("doc_id % 2 = 0"), docs):
        table.put(text_stats.word_count(part).select(F.col("word").alias("key"), F.lit("c:count").alias("qualifier"), F.col("n").alias("value")))
    return table


def _counts(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("key").alias("word"), F.col("value").alias("n"))


def bool_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search whose postings are cells, a qualifier a document, got by term."""
    table, docs = KeyedTable.create(spark, new_path(spark, "cells"), buckets=16), load(spark, sf_dir, "documents")
    table.put(search.index_long(docs).select(F.col("term").alias("key"), F.concat(F.lit("p:"), F.col("doc_id").cast("string")).alias("qualifier"), F.col("tf").alias("value")))
    query = "the of AND de la AND OR nosuchterm OR"
    rows = table.get(*search.compile_rpn(query)[0]).select(F.col("key").alias("term"), F.substring("qualifier", 3, 20).cast("long").alias("doc_id"))
    return search.with_snippets(search.matches(rows, query), docs)


def _ensemble(method: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _instances(spark, sf_dir)
        return classify.apply_ensemble(rows, _models(rows), method)

    return query


QUERIES: dict[str, Query] = {
    "word_count": _docs(text_stats.word_count),
    "prefix_count": _docs(text_stats.prefix_count),
    "line_count": _docs(text_stats.line_count),
    "word_lookup": _docs(text_stats.word_lookup, "the"),
    "pmi_pairs": _docs(text_stats.pmi_pairs),
    "pmi_stripes": _docs(text_stats.pmi_stripes),
    "pmi_top_for_word": _docs(text_stats.pmi_top_for_word, "the"),
    "bigram_relfreq_pairs": _docs(text_stats.bigram_relfreq_pairs),
    "bigram_marginals": _docs(text_stats.bigram_marginals),
    "bigram_relfreq_stripes": _docs(text_stats.bigram_relfreq_stripes),
    "inverted_index": _docs(search.inverted_index),
    "inverted_index_long": _docs(search.index_long),
    "inverted_index_gaps": _docs(search.index_gaps),
    "index_decode": _docs(lambda docs: search.decode(search.encode(docs))),
    "bool_and": _docs(search.search, "the shor AND"),
    "bool_or": _docs(search.search, "und que OR"),
    "bool_rpn": _docs(search.search, "the of AND de la AND OR nosuchterm OR"),
    "bool_rpn_stored": lambda spark, d: search.search(load(spark, d, "documents"), "the of AND de la AND OR nosuchterm OR", stored_index(spark, d)),
    "bool_rpn_compressed": bool_compressed("the of AND de la AND OR nosuchterm OR"),
    "bool_and_compressed": bool_compressed("the shor AND"),
    "index_compressed": index_compressed,
    "index_decode_compressed": lambda spark, d: postings.decompress(stored_blocks(spark, d)),
    "bool_fetch": bool_fetch,
    "line_offsets": line_offsets,
    "keyed_word_count": lambda spark, d: _counts(word_table(spark, d).cells()),
    "keyed_get": lambda spark, d: _counts(word_table(spark, d).get("the", "und", "shor", "nosuchterm")),
    "bool_rpn_keyed": bool_keyed,
    "word_lookup_stored": lambda spark, d: stored_index(spark, d).where(F.col("term") == "the").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")),
    "bigram_stripes": bigram_stripes,
    "line_scan": line_scan,
    "delimited_scan": delimited_scan,
    "adjacency_scan": adjacency_scan,
    "instance_scan": instance_scan,
    "instances_concatenated": instances_concatenated,
    "bigram_stripe_shares": bigram_stripe_shares,
    "spam_ensemble_files": spam_ensemble_files,
    "ppr_dump": lambda spark, d: graph.dump_top(graph.personalised_reached(*purchases(spark, d), [0, 2, 4, 1, 7, 40], 4), 10),
    "q1": _tables(relational.q1, DAY),
    "q1_prefix_month": _tables(relational.q1, MONTH),
    "q1_prefix_year": _tables(relational.q1, YEAR),
    "q2": _tables(relational.q2, MONTH),
    "q3": _tables(relational.q3, MONTH),
    "q4": _tables(relational.q4, MONTH),
    "q5": _tables(relational.q5),
    "q6": _tables(relational.q6, MONTH),
    "q6_prefix_year": _tables(relational.q6, YEAR),
    "q7": _tables(relational.q7, "1996-01-01"),
    "graph_build": lambda spark, d: graph.graph_build(*part_supplier(spark, d)),
    "graph_stats": lambda spark, d: graph.graph_stats(*part_supplier(spark, d)),
    "pagerank": lambda spark, d: _rounded(graph.pagerank(*part_supplier(spark, d), 3)),
    "pagerank_copartitioned": lambda spark, d: _rounded(graph.pagerank_copartitioned(*part_supplier(spark, d), 3)),
    "pagerank_settled": lambda spark, d: graph.sequential_pagerank(*nations(spark, d), tolerance=1e-7).select("id", F.round("rank", 5).alias("rank")),
    "ppr_settled": lambda spark, d: graph.sequential_personalised(*nations(spark, d), 5, tolerance=1e-7).select("id", F.round("rank", 5).alias("rank")),
    "pagerank_top": lambda spark, d: graph.top(_rounded(graph.pagerank(*part_supplier(spark, d), 3)), 20),
    "pagerank_dump": lambda spark, d: graph.dump(graph.pagerank(*nations(spark, d), 3), nations(spark, d)[1]),
    "ppr_multi": lambda spark, d: _rounded(graph.personalised(*nations(spark, d), [0, 5, 12], 4)),
    "ppr_top": lambda spark, d: graph.top_per_source(_rounded(graph.personalised(*nations(spark, d), [0, 5, 12], 4)), 5),
    "pagerank_resumed": lambda spark, d: _rounded(pagerank_resumed(spark, d)),
    "pagerank_counters": lambda spark, d: graph.pagerank_counters(*purchases(spark, d), 3).withColumn("mass", F.round("mass", 8)),
    "pagerank_purchases": lambda spark, d: _rounded(graph.pagerank(*purchases(spark, d), 4)),
    "pagerank_log": lambda spark, d: log_ranks.pagerank(*purchases(spark, d), 4).withColumn("log_rank", F.round("log_rank", 7)),
    "pagerank_ranged": lambda spark, d: _rounded(partitions.pagerank(*purchases(spark, d), 4)),
    "partition_messages": lambda spark, d: partitions.messages(*purchases(spark, d)),
    "ppr_vectors": lambda spark, d: _rounded(graph.personalised_reached(*purchases(spark, d), [0, 2, 4, 1, 7, 40], 4)),
    "ppr_vectors_top": lambda spark, d: graph.top_per_source(_rounded(graph.personalised_reached(*purchases(spark, d), [0, 2, 4, 1, 7, 40], 4)), 10),
    "ppr_log": lambda spark, d: log_ranks.personalised(*purchases(spark, d), 2, 4).withColumn("log_rank", F.round("log_rank", 7)),
    "graph_partition_range": lambda spark, d: graph.range_partition(nations(spark, d)[0], 10),
    "graph_wcc": lambda spark, d: graph.weak_components(*nations(spark, d)),
    "spam_train": spam_train,
    "spam_apply": spam_apply,
    "spam_apply_trained": spam_apply_trained,
    "spam_ensemble_avg": _ensemble("average"),
    "spam_ensemble_vote": _ensemble("vote"),
    "spam_auc": lambda spark, d: classify.one_minus_auc(spam_apply(spark, d)),
}
