"""Word, prefix, bigram and co-occurrence statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import head_parts, head_words, tokens
from sparkloom.operators.joins import salted_join
from sparkloom.operators.meetings import meetings
from sparkloom.sources.shared import materialise


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(tokens(text)).alias("word"))


def word_count(docs: DataFrame) -> DataFrame:
    return words(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def prefix_count(docs: DataFrame, size: int = 2) -> DataFrame:
    w = words(docs).where(F.length("word") >= size)
    return w.groupBy(F.substring("word", 1, size).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def line_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"))


def word_lookup(docs: DataFrame, word: str) -> DataFrame:
    """One word's count; the predicate is below the aggregation, so nothing else is shuffled."""
    return word_count(docs.select("text")).where(F.col("word") == word)


def _numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """``words`` with dense numbers ``id`` from 0, and their count; written, as numbers follow from the order of the rows."""
    rows = materialise(words.withColumn("at", F.monotonically_increasing_id()), "numbered")  # partition << 33, row
    part = F.shiftright("at", 33)
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one a partition
    base, total = {}, 0
    for k, n in sizes:
        base[k], total = total, total + n
    starts = F.create_map(*[F.lit(x).cast("long") for k, b in base.items() for x in (k, b)]) if base else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return rows.withColumn("id", F.element_at(starts, part.cast("long")) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at"), total


#: Codes of pairs that a task makes at once, and different ones that it holds before it tells their counts.
PAIRS_AT_ONCE, PAIRS_HELD = 1 << 22, 1 << 23
#: Rows that a task of ``pmi_pairs`` holds before it tells them.
ROWS_AT_ONCE = 1 << 18


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order with the sums of their counts."""
    c, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    return c[starts], np.add.reduceat(n, starts)


def pair_counts(lists: DataFrame, n_ids: int) -> DataFrame:
    """(code, n) of (ids array<long>, each once and sorted): in how many rows ids x < y below ``n_ids`` meet, as x * n_ids + y.

    Tasks count in numpy what they read, in bounded memory, and tell each pair once or a few times; Spark adds up.
    """

    def tell(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(codes), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + (1 << 18)]), pa.array(counts[i : i + (1 << 18)])], names=["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0
        for b in batches:
            column = b.column(0)
            flat, starts = np.asarray(column.flatten()), np.asarray(column.offsets)
            starts, sizes = starts[:-1] - starts[0], np.diff(starts)
            for size in np.unique(sizes[sizes > 1]):
                i, j = np.triu_indices(size, 1)
                rows = starts[sizes == size]
                step = max(1, PAIRS_AT_ONCE // len(i))
                for at in range(0, len(rows), step):
                    ids = flat[rows[at : at + step, None] + np.arange(size)]
                    made = np.sort((ids[:, i] * n_ids + ids[:, j]).ravel())
                    ends = np.flatnonzero(np.append(made[1:] != made[:-1], True))
                    codes.append(made[ends])
                    counts.append(np.diff(ends, prepend=-1))
                    held += len(ends)
                    if held > PAIRS_HELD:
                        one, n = _summed(codes, counts)
                        codes, counts, held = [one], [n], len(one)
                        if held > PAIRS_HELD // 2:
                            yield from tell(one, n)
                            codes, counts, held = [], [], 0
        if codes:
            yield from tell(*_summed(codes, counts))

    return lists.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _pmi(n: np.ndarray, nx: np.ndarray, ny: np.ndarray, total: int) -> np.ndarray:
    return np.round(np.log10(n * float(total) / (nx * ny)), 6) + 0.0  # no negative zero


def _whole(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, id) of the words of each whole record that ``least`` or more records have, (w, n, id) of these words, and how many."""
    seen = materialise(docs.select("doc_id", F.explode(F.array_distinct(tokens("text"))).alias("w")), "seen")
    counts, size = _numbered(seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy("n", "w"))
    ids = counts.select("w", F.col("id").cast("int").alias("id")).hint("shuffle_hash")  # the words alone are built; records needn't be sorted
    return seen.where("doc_id is not null").join(ids, "w").select("doc_id", "id"), counts, size


def pmi_pairs(docs: DataFrame, least: int = 10) -> DataFrame:
    """(x, y, n, pmi) of ordered pairs of words that ``least`` or more records share.

    A pair that frequent has two words that frequent, so rarer words go before pairs are made; each pair is counted once,
    by the task that has its rarer word, and mirrored there.
    """
    total = docs.count()
    rows, counts, size = _whole(docs, least)

    def tell(found: Iterator[tuple[int, np.ndarray, np.ndarray]], words: pa.Array, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
        def both() -> Iterator[pa.RecordBatch]:
            x, y, n = np.repeat(xs, [len(k) for k in ys]), np.concatenate(ys), np.concatenate(ns)
            pmi, first, second = pa.array(_pmi(n, totals[x], totals[y], total)), words.take(pa.array(x)), words.take(pa.array(y))
            for a, b in ((first, second), (second, first)):
                whole = pa.RecordBatch.from_arrays([a, b, pa.array(n), pmi], names=["x", "y", "n", "pmi"])
                yield from (whole.slice(i, 1 << 16) for i in range(0, len(n), 1 << 16))

        xs, ys, ns, held = [], [], [], 0
        for x, y, n in found:
            xs.append(x)
            ys.append(y)
            ns.append(n)
            held += len(y)
            if held >= ROWS_AT_ONCE:
                yield from both()
                xs, ys, ns, held = [], [], [], 0
        if held:
            yield from both()

    return meetings(rows, counts, size, least, tell, "x string, y string, n long, pmi double")


def pmi_stripes(docs: DataFrame, least: int = 10) -> DataFrame:
    """(x, n_successors, total, max_pmi): each word's map of partners, summed up; tasks sum up what they count themselves."""
    total = docs.count()
    rows, counts, size = _whole(docs, least)

    def tell(found: Iterator[tuple[int, np.ndarray, np.ndarray]], words: pa.Array, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
        partners, sums, most = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64), np.full(size, -np.inf)
        for x, y, n in found:
            pmi = _pmi(n, totals[x], totals[y], total)
            partners[x] += len(y)
            sums[x] += n.sum()
            most[x] = max(most[x], pmi.max())
            partners[y] += 1  # each once
            sums[y] += n
            most[y] = np.maximum(most[y], pmi)
        some = np.flatnonzero(partners)
        whole = pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.array(partners[some]), pa.array(sums[some]), pa.array(most[some])], names=["x", "n", "total", "pmi"])
        yield from (whole.slice(i, 1 << 16) for i in range(0, len(some), 1 << 16))

    told = meetings(rows, counts, size, least, tell, "x string, n long, total long, pmi double")
    return told.groupBy("x").agg(F.sum("n").alias("n_successors"), F.sum("total").alias("total"), F.max("pmi").alias("max_pmi"))


def head_pmi_pairs(docs: DataFrame, least: int = 10, at: int = 100) -> DataFrame:
    """(x, y, n, pmi) of ordered pairs of words that the heads of ``least`` or more records share; see ``head_words``.

    A pair that frequent has two words that frequent, so rarer words go before pairs are made; words are numbered, pairs
    are counted once, as one number each, and mirrored at the end.
    """
    total, spark = docs.count(), docs.sparkSession
    seen = materialise(docs.select("doc_id", head_parts("text", at).alias("p")).select("doc_id", F.explode(head_words(F.col("p"), at)).alias("w")), "seen")
    counts, size = _numbered(seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    # the pairs outweigh what is read, so the records are dealt over as many tasks as a shuffle has, however small they are
    kept = seen.join(counts.select("w", "id"), "w").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    lists = kept.groupBy("doc_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids")  # at most ``at`` words a record
    pairs = pair_counts(lists, size).where(F.col("n") >= least).select(F.expr(f"code div {max(size, 1)}").alias("i"), (F.col("code") % max(size, 1)).alias("j"), "n")
    x, y = counts.toDF("x", "nx", "i"), counts.toDF("y", "ny", "j")
    one = pairs.join(x, "i").join(y, "j").select("x", "y", "n", F.round(F.log10(F.col("n") * F.lit(float(total)) / (F.col("nx") * F.col("ny"))), 6).alias("pmi"))
    return one.select(F.explode(F.array(F.struct("x", "y", "n", "pmi"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "n", "pmi"))).alias("r")).select("r.*")


def pmi_top_for_word(docs: DataFrame, word: str, top: int = 10) -> DataFrame:
    """The partners of ``word`` of greatest PMI in the heads of records."""
    return head_pmi_pairs(docs).where(F.col("x") == word).select("y", "pmi").orderBy(F.desc("pmi"), "y").limit(top)


def bigrams(docs: DataFrame) -> DataFrame:
    """(a, b, n): adjacent tokens within a record."""
    t = docs.select(tokens("text").alias("t"))
    n = F.greatest(F.size("t") - 1, F.lit(0))  # no filter on the size: it would be pushed below and tokenise again
    pairs = t.select(F.explode(F.zip_with(F.slice("t", 1, n), F.slice("t", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def bigram_marginals(docs: DataFrame) -> DataFrame:
    """(a, n): bigrams that a word starts."""
    t = docs.select(tokens("text").alias("t"))
    return t.select(F.explode(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0)))).alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n"))


def bigram_relfreq_pairs(docs: DataFrame) -> DataFrame:
    """(a, b, n, freq): the share of a's bigrams that go on with b.  Marginals are joined with salt, so a frequent a isn't
    one task; the shuffle of the counts is used twice."""
    n = bigrams(docs)
    total = n.groupBy("a").agg(F.sum("n").alias("total"))
    return salted_join(n, total, "a", F.col("b")).select("a", "b", "n", F.round(F.col("n") / F.col("total"), 8).alias("freq"))


def bigram_stripes(docs: DataFrame) -> DataFrame:
    """(a, stripe map<b, n>): each word's successors with their counts, as many as the vocabulary at most."""
    return bigrams(docs).groupBy("a").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("b", "n")))).alias("stripe"))


def bigram_stripe_shares(docs: DataFrame) -> DataFrame:
    """(a, shares map<b, share>): each word's successors with the share of its bigrams that go on with them.

    The sum is an aggregate of its own: as an expression over the map it would move into the function that is applied to
    every entry, and be taken as often.
    """
    got = bigrams(docs).groupBy("a").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("b", "n"))).alias("p"))
    return got.select("a", F.map_from_entries(F.transform("p", lambda x: F.struct(x["b"], x["n"] / F.col("total")))).alias("shares"))


def bigram_relfreq_stripes(docs: DataFrame) -> DataFrame:
    n = bigrams(docs).groupBy("a").agg(F.count(F.lit(1)).alias("n_successors"), F.sum("n").alias("total"), F.max("n").alias("most"))
    return n.select("a", "n_successors", "total", F.round(F.col("most") / F.col("total"), 8).alias("max_freq"))
