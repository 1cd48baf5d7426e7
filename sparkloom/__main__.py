"""Command line: ``python -m sparkloom COMMAND --input PATH [--output PATH] ...``; results without an output are printed."""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import classify, graph, postings, relational, search, text_stats
from sparkloom.sources import lines, tables

Command = Callable[[SparkSession, argparse.Namespace], DataFrame]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """A text collection: one record a line.  Ids are those of the reader's partitions and don't change between reads of the same files."""
    return tables.read_lines(spark, path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def _text(f: Callable[[DataFrame], DataFrame]) -> Command:
    return lambda spark, a: f(_lines(spark, a.input))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table, or a '|'-delimited one where the folder holds NAME.tbl; the columns that a file lacks are null."""
    try:
        return tables.load(spark, folder, name)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df = tables.read_tbl(spark, f"{folder}/{name}.tbl", name)
    for c, kind in df.dtypes:
        if kind == "date":
            df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def _relational(name: str) -> Command:
    def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
        get = lambda t: _table(spark, a.input, t)
        return relational.q5(get) if name == "q5" else getattr(relational, name)(get, a.date)

    return run


def _graph(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return tables.parse_adjacency(tables.read_lines(spark, a.input))


def _pagerank(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    ranks = graph.pagerank(*_graph(spark, a), a.iterations, a.jump)
    return graph.top(ranks, a.top) if a.top else ranks


def _personalised(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    ranks = graph.personalised(*_graph(spark, a), [int(s) for s in a.sources.split(",")], a.iterations, a.jump)
    return graph.top_per_source(ranks, a.top) if a.top else ranks


def _partition(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    nodes, _ = _graph(spark, a)
    placed = graph.repartition_graph(nodes, a.partitions, a.range)
    return placed.select("id", F.spark_partition_id().alias("partition"))


def _instances(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return tables.parse_instances(tables.read_lines(spark, *a.input.split(",")))  # several sets are one, end to end


def _model(spark: SparkSession, path: str) -> DataFrame:
    return tables.parse_model(tables.read_lines(spark, path))


def _ensemble(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    paths = a.model.split(",")
    if len(paths) == 1:  # a folder of part files, a model each
        models = tables.read_models(spark, paths[0])
        return classify.apply_ensemble(_instances(spark, a), models, a.method, models.agg(F.max("model_id")).first()[0] or 1)
    models = None
    for i, p in enumerate(paths, 1):
        m = _model(spark, p).select(F.lit(i).alias("model_id"), "feature", "weight")
        models = m if models is None else models.unionByName(m)
    return classify.apply_ensemble(_instances(spark, a), models, a.method, len(paths))


def _word_table(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    tables.replace_table(text_stats.word_count(_lines(spark, a.input)), a.table)
    return spark.table(a.table).agg(F.count(F.lit(1)).alias("words"))


def _index_table(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    tables.replace_table(search.index_long(_lines(spark, a.input)), a.table)
    return spark.table(a.table).agg(F.count(F.lit(1)).alias("postings"))


def _index_blocks(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The compressed index below ``--table``, and its size."""
    postings.write_blocks(_lines(spark, a.input), a.table)
    return spark.read.parquet(a.table).agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("postings"), F.sum(F.octet_length("data")).alias("bytes"))


def _fetch(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Matching lines by file and byte offset."""
    rows = lines.read_keyed_lines(spark, a.input).withColumnRenamed("value", "text")
    hits = search.matches(search.index_long(rows, "file", "offset"), a.query, "file", "offset")
    return lines.fetch_lines(hits).select("file", "offset", "snippet").orderBy("file", "offset")


COMMANDS: dict[str, Command] = {
    "word-count": _text(text_stats.word_count), "prefix-count": _text(text_stats.prefix_count), "line-count": _text(text_stats.line_count),
    "pmi-pairs": _text(text_stats.pmi_pairs), "pmi-stripes": _text(text_stats.pmi_stripes),
    "bigram-pairs": _text(text_stats.bigram_relfreq_pairs), "bigram-stripes": _text(text_stats.bigram_relfreq_stripes), "bigram-marginals": _text(text_stats.bigram_marginals),
    "build-index": _text(search.inverted_index), "build-index-compressed": lambda s, a: search.encode(_lines(s, a.input)).select("term", "block", "base", F.to_json("postings").alias("postings")),
    "build-index-blocks": lambda s, a: _index_blocks(s, a), "search-blocks": lambda s, a: search.with_snippets(postings.matches(s.read.parquet(a.table), a.query), _lines(s, a.input)).orderBy("doc_id"),
    "fetch": _fetch,
    "search": lambda s, a: search.search(_lines(s, a.input), a.query).orderBy("doc_id"),
    "build-graph": lambda s, a: graph.graph_build(*_graph(s, a)), "graph-stats": lambda s, a: graph.graph_stats(*_graph(s, a)), "partition-graph": _partition,
    "pagerank": _pagerank, "personalised-pagerank": _personalised, "components": lambda s, a: graph.weak_components(*_graph(s, a)),
    "sequential-pagerank": lambda s, a: graph.sequential_pagerank(*_graph(s, a), a.jump).orderBy(F.desc("rank"), "id"),
    "sequential-personalised": lambda s, a: graph.sequential_personalised(*_graph(s, a), int(a.sources), a.jump).orderBy(F.desc("rank"), "id"),
    "dump-ranks": lambda s, a: graph.dump(graph.pagerank(*_graph(s, a), a.iterations, a.jump), _graph(s, a)[1]),
    "train-spam": lambda s, a: classify.train(_instances(s, a), a.shuffle), "apply-spam": lambda s, a: classify.apply_model(_instances(s, a), _model(s, a.model)), "apply-ensemble": _ensemble,
    "word-table": _word_table, "word-fetch": lambda s, a: s.table(a.table).where(F.col("word") == a.term), "index-table": _index_table,
    "search-table": lambda s, a: search.search(_lines(s, a.input), a.query, s.table(a.table)).orderBy("doc_id"),
    **{q: _relational(q) for q in ("q1", "q2", "q3", "q4", "q5", "q6", "q7")},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sparkloom", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    for name, kind, default in (
        ("input", str, None), ("output", str, None), ("date", str, None), ("query", str, None), ("table", str, None), ("term", str, None), ("model", str, None), ("method", str, "average"),
        ("sources", str, None), ("shuffle", int, None), ("iterations", int, 10), ("top", int, 0), ("partitions", int, 8), ("reducers", int, None), ("jump", float, graph.ALPHA),
    ):
        p.add_argument(f"--{name}", type=kind, default=default)
    p.add_argument("--range", action="store_true", help="partition by ranges of ids in place of hashes")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"sparkloom {a.command}").getOrCreate()
    if a.reducers:
        spark.conf.set("spark.sql.shuffle.partitions", a.reducers)
    out = COMMANDS[a.command](spark, a)
    if a.output:
        tables.write_tsv(out, a.output)
    else:
        out.show(100, truncate=False)


if __name__ == "__main__":
    os.environ.setdefault("PYSPARK_PYTHON", "python3")
    main()
