"""Compressed posting blocks, and boolean retrieval that skips blocks.

A block holds at most BLOCK_POSTINGS postings of a term within one range of documents: gaps and frequencies as
variable-length integers of seven bits a byte, with the first and last document beside them.  A query first looks at the
ranges only: zones of documents in which they can't meet drop out, and only blocks that reach a live zone are read and
decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import packed
from sparkloom.operators.packed import RANGE, pack_integers, unpack_integers
from sparkloom.operators.search import compile_rpn
from sparkloom.sources.shared import discard, materialise

BLOCK_POSTINGS = 128
#: Documents of a zone, by which the ranges of different terms are compared: a block reaches 64 zones at most.
ZONE = 1_024
SCHEMA = "term string, first_doc long, last_doc long, n int, sum_tf long, data binary"


def compress(index: DataFrame) -> DataFrame:
    """(term, first_doc, last_doc, n, sum_tf, data) of an index (term, doc_id, tf); document numbers from 0 up."""
    return _compressed(index.withColumn("range", F.floor(F.col("doc_id") / RANGE)))


def _compressed(index: DataFrame) -> DataFrame:
    """The blocks of (term, range, doc_id, tf)."""
    lists = index.groupBy("term", "range").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("p"))
    made = partial(_blocks, BLOCK_POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = b.column(1)
                postings, offsets = lists.flatten(), np.asarray(lists.offsets)
                yield made(b.column(0), None, offsets[:-1] - offsets[0], *(np.asarray(postings.field(i)) for i in (0, 1)))

    return lists.select("term", "p").mapInArrow(run, SCHEMA)


def _blocks(most: int, terms: pa.Array, _: np.ndarray | None, lists: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    """The blocks of ``most`` postings at most of lists of postings, list i from ``lists[i]`` on."""
    counts = packed.sizes(lists, len(doc))
    of = np.repeat(np.arange(len(terms)), counts)
    place = np.arange(len(doc)) - np.repeat(lists, counts)
    starts = np.flatnonzero(place % most == 0)
    ends = np.append(starts[1:], len(doc))
    gap = np.diff(doc, prepend=0)
    gap[starts] = 0
    data, size = pack_integers(np.stack([gap, tf], axis=1).ravel())
    blob = packed.binary(data, size.reshape(-1, 2).sum(axis=1), starts)
    arrays = [terms.take(pa.array(of[starts])), pa.array(doc[starts]), pa.array(doc[ends - 1]), pa.array((ends - starts).astype(np.int32)), pa.array(np.add.reduceat(tf, starts)), blob]
    return pa.RecordBatch.from_arrays(arrays, names=["term", "first_doc", "last_doc", "n", "sum_tf", "data"])


def decompress(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, tf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = np.asarray(b.column(2)).astype(np.int64)
            pairs = unpack_integers(np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8)).reshape(-1, 2)
            starts = np.cumsum(n) - n
            gaps = pairs[:, 0].copy()
            gaps[starts] = np.diff(np.asarray(b.column(1)), prepend=0)  # from block to block the first documents are the sums' steps
            gaps[starts[1:]] -= np.add.reduceat(pairs[:, 0], starts)[:-1]
            rows = np.repeat(np.arange(b.num_rows), n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.cumsum(gaps)), pa.array(pairs[:, 1].copy())], names=["term", "doc_id", "tf"])

    return blocks.select("term", "first_doc", "n", "data").mapInArrow(run, "term string, doc_id long, tf long")


def write_blocks(docs: DataFrame, path: str) -> None:
    """The compressed index of (doc_id, text) as a table sorted by term and first document, for scans that prune.

    Postings are counted and packed by the tasks that read the texts, and written before they are sorted, as the sort
    reads its input twice to find its bounds; blocks are made of the sorted rows.
    """
    rows = materialise(packed.packed(docs), "packed")
    packed.merged(packed.by_range(rows), partial(_blocks, BLOCK_POSTINGS), SCHEMA).write.mode("overwrite").parquet(path)
    discard(rows)


def _hull(query: str) -> tuple[list[str], Column, Column]:
    """Terms of a postfix query, and the first and last document that can match, over columns lo_0, hi_0, lo_1, ...; null
    where none can."""
    terms, _ = compile_rpn(query)
    stack: list[tuple[Column, Column]] = []
    for token in query.split():
        if token not in ("AND", "OR"):
            i = terms.index(token)
            stack.append((F.col(f"lo_{i}"), F.col(f"hi_{i}")))
            continue
        (c, d), (a, b) = stack.pop(), stack.pop()
        if token == "AND":
            lo, hi = F.greatest(a, c), F.least(b, d)
            meet = a.isNotNull() & c.isNotNull() & (lo <= hi)
            stack.append((F.when(meet, lo), F.when(meet, hi)))
        else:
            stack.append((F.least(a, c), F.greatest(b, d)))
    return terms, *stack[-1]


def live_blocks(blocks: DataFrame, query: str) -> DataFrame:
    """The blocks that a postfix query has to decode: those of its terms that reach a zone in which their ranges can meet.

    Only terms and ranges are read for this; the data of the blocks left is read by a second scan.
    """
    terms, lo, hi = _hull(query)
    asked = blocks.where(F.col("term").isin(terms))
    zones = F.sequence(F.floor(F.col("first_doc") / ZONE), F.floor(F.col("last_doc") / ZONE))
    reach = asked.select("term", "first_doc", "last_doc", F.explode(zones).alias("zone"))
    inside = reach.select("term", "first_doc", "zone", F.greatest("first_doc", F.col("zone") * ZONE).alias("a"), F.least("last_doc", F.col("zone") * ZONE + ZONE - 1).alias("b"))
    bounds = [f(F.when(F.col("term") == t, F.col(c))).alias(f"{name}_{i}") for i, t in enumerate(terms) for f, c, name in ((F.min, "a", "lo"), (F.max, "b", "hi"))]
    live = inside.groupBy("zone").agg(*bounds).select("zone", lo.alias("lo"), hi.alias("hi")).where("lo is not null")
    kept = inside.join(live, "zone").where("a <= hi and b >= lo").select("term", "first_doc").distinct()
    return asked.join(kept, ["term", "first_doc"], "left_semi")


def matches(blocks: DataFrame, query: str) -> DataFrame:
    """(doc_id) of the documents that a postfix query of AND and OR matches; an unknown term matches nothing."""
    terms, condition = compile_rpn(query)
    rows = decompress(live_blocks(blocks, query))
    has = rows.groupBy("doc_id").agg(*[F.bool_or(F.col("term") == t).alias(f"has_{i}") for i, t in enumerate(terms)])
    return has.where(condition).select("doc_id")
