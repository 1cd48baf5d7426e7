"""Inverted index and boolean retrieval.

Postings are kept in blocks of a range of document ids, so the list of a word that stands in every document is spread
over as many rows as there are blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.text import snippet, tokens
from sparkloom.operators import packed
from sparkloom.sources.shared import discard, materialise

BLOCK = packed.RANGE


def index_long(docs: DataFrame, *key: str) -> DataFrame:
    """(term, doc_id, tf), or with other columns for a key in place of the document's number."""
    key = key or ("doc_id",)
    return docs.select(*key, F.explode(tokens("text")).alias("term")).groupBy("term", *key).agg(F.count(F.lit(1)).alias("tf"))


def _block() -> Column:
    # never null, so that joins on it infer no filter for one side only and both sides can use one shuffle
    return F.coalesce(F.floor(F.col("doc_id") / BLOCK).cast("long"), F.lit(0).cast("long")).alias("block")


def inverted_index(docs: DataFrame) -> DataFrame:
    """(term, block, df, first_doc, last_doc, sum_tf, postings): sorted postings of each term and block of documents."""
    return packed.merged(packed.by_hash(packed.packed(docs)), _listed, "term string, block long, df long, first_doc long, last_doc long, sum_tf long, postings string")


def _listed(terms: pa.Array, block: np.ndarray, starts: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    ends = np.append(starts[1:], len(doc))
    each = pc.binary_join_element_wise(*(pa.array(x).cast(pa.string()) for x in (doc, tf)), ":")
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(doc)).astype(np.int32)), each)
    arrays = [terms, pa.array(block), pa.array(ends - starts), pa.array(doc[starts]), pa.array(doc[ends - 1]), pa.array(np.add.reduceat(tf, starts)), pc.binary_join(lists, ",")]
    return pa.RecordBatch.from_arrays(arrays, names=["term", "block", "df", "first_doc", "last_doc", "sum_tf", "postings"])


def write_index(docs: DataFrame, path: str) -> None:
    """(term, doc_id, tf) of (doc_id, text) as a table sorted by term and document, for point lookups.

    Packed postings are written before they are sorted, as the sort reads its input twice to find its bounds; a frequent
    term is spread over the files of its ranges of documents.
    """
    rows = materialise(packed.packed(docs), "packed")
    packed.long_rows(packed.by_range(rows)).write.mode("overwrite").parquet(path)
    discard(rows)


def index_gaps(docs: DataFrame) -> DataFrame:
    """(term, doc_id, gap, tf): the distance to the term's document before, or the id itself at the first.

    Windows are over a block; a block's first gap comes from the last document of the term's block before.
    """
    rows = index_long(docs).withColumn("block", _block())
    # the frequency, always above 0, is asked for on this side too, so that both sides read one shuffle of the counts
    ends = rows.groupBy("term", "block").agg(F.max("doc_id").alias("last"), F.max("tf").alias("most")).where("most > 0")
    ends = ends.select("term", "block", F.lag("last", 1, 0).over(W.partitionBy("term").orderBy("block")).alias("base"))
    before = F.lag("doc_id").over(W.partitionBy("term", "block").orderBy("doc_id"))
    return rows.withColumn("before", before).join(ends, ["term", "block"]).select("term", "doc_id", (F.col("doc_id") - F.coalesce("before", "base")).alias("gap"), "tf")


def encode(docs: DataFrame) -> DataFrame:
    """(term, block, base, postings array<struct<gap, tf>>): gap-encoded blocks; base is the document before the block."""
    rows = index_gaps(docs).withColumn("block", _block())
    got = rows.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "gap", "tf"))).alias("p"))
    base = F.col("p")[0]["doc_id"] - F.col("p")[0]["gap"]
    return got.select("term", "block", base.alias("base"), F.transform("p", lambda x: F.struct(x["gap"].alias("gap"), x["tf"].alias("tf"))).alias("postings"))


def decode(encoded: DataFrame) -> DataFrame:
    """(term, doc_id, tf): running sums of the gaps give the documents back."""
    rows = encoded.select("term", "block", "base", F.posexplode("postings").alias("i", "p"))
    run = W.partitionBy("term", "block").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("term", (F.col("base") + F.sum("p.gap").over(run)).alias("doc_id"), F.col("p.tf").alias("tf"))


def compile_rpn(query: str) -> tuple[list[str], Column]:
    """Terms of a postfix query and its condition over columns has_0, has_1, ...; operators are AND and OR in upper case."""
    terms: list[str] = []
    stack: list[Column] = []
    for token in query.split():
        if token in ("AND", "OR"):
            if len(stack) < 2:
                raise ValueError(f"{token} needs two operands: {query}")
            b, a = stack.pop(), stack.pop()
            stack.append(a & b if token == "AND" else a | b)
        else:
            if token not in terms:
                terms.append(token)
            stack.append(F.col(f"has_{terms.index(token)}"))
    if not stack:
        raise ValueError("empty query")
    return terms, stack[-1]


def search(docs: DataFrame, query: str, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, snippet) of the documents that a postfix query matches, one aggregation for all of its terms.

    A term that no document has matches nothing.
    """
    return with_snippets(matches(index if index is not None else index_long(docs), query), docs)


def matches(index: DataFrame, query: str, *key: str) -> DataFrame:
    """The keys that a postfix query matches, by one aggregation over the postings of its terms."""
    key, (terms, condition) = key or ("doc_id",), compile_rpn(query)
    rows = index.where(F.col("term").isin(terms))
    has = rows.groupBy(*key).agg(*[F.bool_or(F.col("term") == t).alias(f"has_{i}") for i, t in enumerate(terms)])
    return has.where(condition).select(*key)


def with_snippets(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, snippet) of documents (doc_id)."""
    return hits.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", snippet("text").alias("snippet"))
