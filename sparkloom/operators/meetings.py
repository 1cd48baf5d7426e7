"""How often words meet in whole records, word by word: pairs are neither shuffled nor held."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import materialise

#: Meetings of a block of words, beyond LEAST_BLOCKS blocks; ids of a packed row; ranges of words whose meetings are told
#: apart; partners of a word that are held at once.
BLOCK_MEETINGS, LEAST_BLOCKS, PACKED, RANGES, AT_ONCE = 1 << 31, 64, 1 << 18, 4096, 1 << 20
PACKED_ROW = pa.schema([("ids", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())])
PACKED_DDL = "ids binary, sizes binary, words binary"

#: Rows from (x, ids y > x in order, their n) of one word at a time, the words and their counts by id.
Tell = Callable[[Iterator[tuple[int, np.ndarray, np.ndarray]], pa.Array, np.ndarray], Iterator[pa.RecordBatch]]


def _packed(ids: np.ndarray, sizes: np.ndarray, words: bytes | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"ids": ids.tobytes(), "sizes": sizes.tobytes(), "words": words}], PACKED_ROW)


def _packed_records(rows: DataFrame, n_ids: int) -> DataFrame:
    """Rows of about PACKED ids of (doc_id, id int): each record's ids in order, and how many each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, held = [], [], 0
        for b in batches:
            n = np.diff(np.asarray(b.column(0).offsets)).astype(np.int32)
            first = np.repeat(np.arange(len(n), dtype=np.int64) * n_ids, n)
            ids.append((np.sort(np.asarray(b.column(0).flatten()) + first) - first).astype(np.int32))
            sizes.append(n)
            held += len(first)
            if held >= PACKED:
                yield _packed(np.concatenate(ids), np.concatenate(sizes))
                ids, sizes, held = [], [], 0
        if held:
            yield _packed(np.concatenate(ids), np.concatenate(sizes))

    return rows.groupBy("doc_id").agg(F.collect_list("id").alias("ids")).select("ids").mapInArrow(run, PACKED_DDL)


def _packed_words(counts: DataFrame) -> DataFrame:
    """Rows of (w, n, id): ids, counts as sizes, and words, none of which has a line's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _packed(np.asarray(b.column(2)).astype(np.int32), np.asarray(b.column(1)), "\n".join(b.column(0).to_pylist()).encode())

    return counts.select("w", "n", "id").mapInArrow(run, PACKED_DDL)


def _unpacked(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=kind)


def _blocks(records: DataFrame, n_ids: int) -> list[tuple[int, int]]:
    """Ranges of ids whose words meet about as many greater ids, found from the meetings of RANGES ranges."""
    width = -(-n_ids // RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(RANGES, dtype=np.int64)
        for b in batches:
            for row in range(b.num_rows):
                ids, sizes = _unpacked(b.column(0)[row], np.int32), _unpacked(b.column(1)[row], np.int32)
                after = np.repeat(np.cumsum(sizes, dtype=np.int64), sizes) - np.arange(1, len(ids) + 1)
                met += np.bincount(ids // width, weights=after, minlength=RANGES).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(RANGES)), pa.array(met)], names=["at", "met"])

    met = records.mapInArrow(run, "at long, met long").groupBy("at").agg(F.sum("met").alias("met")).orderBy("at").collect()  # RANGES rows
    sums = np.cumsum([r.met for r in met]) if met else np.zeros(1)
    least = min(LEAST_BLOCKS, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = max(least, -(-int(sums[-1]) // BLOCK_MEETINGS))
    ends = np.unique(np.append((np.searchsorted(sums, sums[-1] * np.arange(1, n) / n) + 1) * width, n_ids).clip(max=n_ids))
    return [(int(a), int(b)) for a, b in zip(np.append(0, ends[:-1]), ends) if a < b]


def _places(ids: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
    """(x, where it is in ``ids``) of each x from lo to hi; those of about AT_ONCE places are held at once."""
    step, sums = 1 << 20, np.zeros(hi - lo, dtype=np.int64)
    for i in range(0, len(ids), step):
        part = ids[i : i + step]
        sums += np.bincount(part[part < hi] - lo, minlength=hi - lo)
    first = lo
    while first < hi:
        met = np.cumsum(sums[first - lo :])
        end = min(hi, first + max(1, int(np.searchsorted(met, AT_ONCE, side="right"))))
        at = np.concatenate([i + np.flatnonzero((ids[i : i + step] >= first) & (ids[i : i + step] < end)) for i in range(0, len(ids), step)] or [np.zeros(0, np.int64)])
        at = at[np.argsort(ids[at], kind="stable")]
        bounds = np.append(0, met[: end - first])
        yield from ((x, at[bounds[x - first] : bounds[x - first + 1]]) for x in range(first, end))
        first = end


def _counted(ids: np.ndarray, sizes: np.ndarray, lo: int, hi: int, n_ids: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(x, ids y > x, n) of each x from lo to hi: the y that it meets ``least`` times or more; one word's counts are held."""
    ends = np.cumsum(sizes, dtype=np.int64)
    for x, here in _places(ids, lo, hi):
        there = ends[np.searchsorted(ends, here, side="right")]
        here = here + 1
        met = np.cumsum(there - here)
        if not len(met) or not met[-1]:
            continue
        if met[-1] * 10 < n_ids - x:  # few: sorting them costs less than a count of every id
            ys = np.sort(np.concatenate([ids[i:j] for i, j in zip(here.tolist(), there.tolist())]))
            first = np.flatnonzero(np.append(True, ys[1:] != ys[:-1]))
            n = np.diff(first, append=len(ys))
            ys = ys[first]
        else:
            cuts = [*np.unique(np.searchsorted(met, np.arange(0, met[-1], AT_ONCE), side="right")).tolist(), len(met)]
            n = np.zeros(n_ids - x, dtype=np.int64)
            for p, q in zip([0, *cuts], cuts):
                if p < q:
                    n += np.bincount(np.concatenate([ids[i:j] for i, j in zip(here[p:q].tolist(), there[p:q].tolist())]) - x, minlength=n_ids - x)
            ys = np.arange(x, n_ids, dtype=np.int32)
        often = n >= least
        if often.any():
            yield x, ys[often], n[often]


def meetings(rows: DataFrame, counts: DataFrame, n_ids: int, least: int, tell: Tell, schema: str) -> DataFrame:
    """What ``tell`` makes of the pairs x < y that meet in ``least`` or more records of ``rows`` (doc_id, id int), each row
    once; ``counts`` (w, n, id) are the words by ids from 0 to ``n_ids``, those of the fewest records first.

    A task has a range of words, and of each record the ids from its first word there on.  It counts each of its words
    in turn over all records, so that a pair's count is whole where it is made.  Tasks read the packed records anew.
    """
    if not n_ids:
        return rows.sparkSession.createDataFrame([], schema)
    records, words = materialise(_packed_records(rows, n_ids), "records"), materialise(_packed_words(counts), "words")

    def block(lo: int, hi: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, sizes, names, totals = bytearray(), bytearray(), [""] * n_ids, np.zeros(n_ids, dtype=np.int64)  # bytes grow in place
            for b in batches:
                for row in range(b.num_rows):
                    ids = _unpacked(b.column(0)[row], np.int32)
                    if b.column(2)[row].is_valid:
                        totals[ids] = _unpacked(b.column(1)[row], np.int64)
                        for i, w in zip(ids.tolist(), b.column(2)[row].as_py().decode().split("\n")):
                            names[i] = w
                        continue
                    n = _unpacked(b.column(1)[row], np.int32)
                    ends = np.cumsum(n)
                    own = np.append(0, np.cumsum(ids >= lo))
                    own = own[ends] - own[ends - n]  # ids of each record from lo on
                    own[ids[np.minimum(ends - own, len(ids) - 1)] >= hi] = 0  # none of its words is of this block
                    own[own == 1] = 0
                    kept += ids[np.arange(len(ids)) >= np.repeat(ends - own, n)].data
                    sizes += own[own > 0].astype(np.int32).data
                b = ids = n = None  # a batch is large
            found = _counted(np.frombuffer(kept, np.int32), np.frombuffer(sizes, np.int32), lo, hi, n_ids, least)
            yield from tell(found, pa.array(names, pa.string()), totals)

        return records.union(words).coalesce(1).mapInArrow(run, schema)

    # no rows, but in several partitions: a union of single partitions alone would be a single one
    nothing = words.mapInArrow(lambda batches: (b for b in batches if b is None), schema)
    return reduce(DataFrame.union, [block(lo, hi) for lo, hi in _blocks(records, n_ids)], nothing)
