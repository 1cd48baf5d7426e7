"""Interaction audit of filters: what each removes, and what it alone removes, under every order of applying them.

A row's failures are a mask of five bits.  The first filter of an order that a mask fails is looked up in a table of 32
masks by 120 orders; tasks count removals by part, label, order and step, and their partial arrays are summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise, need, salted_join

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
STEPS = len(LETTERS) + 1  # the last one stands for rows that no filter removes
#: At [mask, order]: the step that removes a row that fails the filters of the mask.
FIRST = np.array([[next((k for k, f in enumerate(o) if mask >> LETTERS.index(f) & 1), len(LETTERS)) for o in ORDERS] for mask in range(1 << len(LETTERS))], dtype=np.int64)
#: Rows looked up at once, and parts that a task holds before it tells its sums.
SLICE, PARTS = 4096, 256

UPPER = bytes(range(65, 91))


def failures(text: str | None, min_words: int, distinct_percent: int, upper_percent: int, marks: bytes) -> int:
    """Mask of A to D that a whole text fails: few words, repeated words, many capitals, odd characters."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    ws = data.split()
    few, repeats = len(ws) < min_words, 100 * len(set(ws)) < distinct_percent * len(ws)
    capitals = 100 * (len(data) - len(data.translate(None, UPPER))) > upper_percent * len(text)
    odd = len(data.translate(None, marks)) < len(data)
    return few | repeats << 1 | capitals << 2 | odd << 3


def masks(docs: DataFrame, part_col: str = "lang", min_words: int = 100, distinct_percent: int = 80, upper_percent: int = 10, marks: str = "#$%&*|", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, mask): the filters that each row fails; E is a text equal to that of any smaller id.

    Texts are compared by their SHA-256; digests are counted before they are shuffled, and a text with very many copies is
    dealt over several tasks.  A null id is neither smaller nor larger than another.
    """
    odd = marks.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            got = pa.array([failures(t, min_words, distinct_percent, upper_percent, odd) for t in texts], pa.int32())
            digests = pa.array([sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), got, digests], names=["id", "part", "own", "digest"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = need(docs, id_col, part_col, text_col).toDF("id", "part", "text").withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit("")))
    own = materialise(rows.mapInArrow(run, f"id {kind}, part string, own int, digest binary"), "masks")
    least = own.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least")
    both = salted_join(own, least, "digest", F.col("id"), "left")
    return both.select("id", "part", (F.col("own") + F.when(F.col("id") > F.col("least"), 16).otherwise(0)).alias("mask"))


def removals(rows: DataFrame) -> DataFrame:
    """(part, order, step, removed, good, toxic) of rows (part, mask, label), label 1 for good and 2 for toxic rows; step 5 holds what stays."""
    cells = len(ORDERS) * STEPS
    names = ["part", "order", "step", "removed", "good", "toxic"]
    offset = np.arange(len(ORDERS)) * STEPS

    def tell(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, by_label in sums.items():
            n = np.arange(cells)
            counts = (by_label.sum(axis=0), by_label[1] + by_label[3], by_label[2] + by_label[3])
            yield pa.RecordBatch.from_arrays([pa.array([part] * cells, pa.string()), pa.array(n // STEPS, pa.int32()), pa.array(n % STEPS, pa.int32()), *map(pa.array, counts)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.column(0).slice(at, SLICE).dictionary_encode()
                mask, label = (np.asarray(b.column(i).slice(at, SLICE)) for i in (1, 2))
                group = np.asarray(part.indices).astype(np.int64) * 4 + label
                cell = group[:, None] * cells + offset + FIRST[mask]
                got = np.bincount(cell.ravel(), minlength=len(part.dictionary) * 4 * cells).reshape(-1, 4, cells)
                for name, counts in zip(part.dictionary.to_pylist(), got, strict=True):
                    sums[name] = sums[name] + counts if name in sums else counts
                if len(sums) > PARTS:
                    yield from tell(sums)
                    sums = {}
        yield from tell(sums)

    partial = rows.select("part", "mask", "label").mapInArrow(count, "part string, order int, step int, removed long, good long, toxic long")
    return partial.groupBy("part", "order", "step").agg(*[F.sum(c).alias(c) for c in names[3:]])


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", **limits: int) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each
    part, order of the five filters and step, zeros included.

    Parts are the values of ``part_col``, null and empty as one.  Null texts are empty: too few words, and equal to other
    empty ones.  Rows that repeat count each; a row is good or toxic if any of its labels says so; a null id has no
    label.  ``limits`` are those of ``masks``.  An empty table has no parts, so no rows; empty labels lose nothing.
    """
    flags = need(labels, id_col, "quality", "toxic").toDF("id", "quality", "toxic").where("id is not null")
    label = F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))
    rows = masks(docs, part_col, id_col=id_col, **limits).join(flags.groupBy("id").agg(label.alias("label")), "id", "left")
    sums = removals(rows.select("part", "mask", F.coalesce("label", F.lit(0)).alias("label")))
    names = F.array(*[F.lit(o) for o in ORDERS])
    sums = sums.select("part", names[F.col("order")].alias("filter_order"), (F.col("step") + 1).alias("step"), "removed", "good", "toxic")
    sums = sums.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    # a part has 720 rows at any size of input
    order, of = W.partitionBy("part", "filter_order"), W.partitionBy("part", "letter")
    left = F.sum("removed").over(order) - F.sum("removed").over(order.orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    fails, alone = (F.max(F.when(F.col("step") == k, F.col("removed"))).over(of) for k in (1, len(LETTERS)))
    got = sums.select(
        "part", "filter_order", "step", left.alias("kept"), "removed", (fails - F.col("removed")).alias("redundant"), alone.alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("removed").over(of).alias("shapley"),
    )
    return got.where(F.col("step") <= len(LETTERS))
