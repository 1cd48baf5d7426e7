"""Postings counted and packed by the tasks that read the texts, so that a shuffle moves a row a term and range of documents.

A row holds the postings of a term within one range of RANGE documents that one piece of the input has: gaps and
frequencies as variable-length integers.  Behind the shuffle the rows of a term and range are merged as they stream by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a range that rows don't cross, so that a very frequent term is spread over many rows and tasks.
RANGE = 65_536
#: Bytes of text that are tokenised at once, and that are counted at once.
CHUNK, PIECE = 1 << 19, 8 << 20
#: Postings that are merged at once, besides those of one term and range.
MERGED = 1 << 20
SCHEMA = "term string, range long, n int, data binary"
Merged = Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]


def pack_integers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each value) of numbers from 0, seven bits a byte, the lowest first; the top bit says that more follow."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >> np.uint64(7 * k) != 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        own = size > k
        low = (values[own] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        out[ends[own] - size[own] + k] = low | np.where(size[own] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def unpack_integers(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts).astype(np.int64)


def binary(data: np.ndarray, size: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of groups of values that begin at ``starts``, as one array."""
    to = np.append(0, np.cumsum(size))[np.append(starts, len(size))]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data)])


def tokens_of(own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, length of each token, text of each token) of lower-case texts between ``bounds``: ``functions.text.tokens``."""
    letters = np.flatnonzero((own >= 97) & (own <= 122))
    parts = (own == 32) | (own == 9) | (own == 10) | (own == 12) | (own == 13)
    run, text = np.cumsum(parts)[letters], np.searchsorted(bounds, letters, side="right") - 1
    new = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    first, last = np.append(True, new)[: len(letters)], np.append(new, True)[: len(letters)]
    starts, ends = letters[first], letters[last] + 1
    inside = np.zeros(len(own) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # a token that begins where another text's ends keeps 0: both go on
    return own[np.cumsum(inside[:-1], dtype=np.int8).view(bool)], ends - starts, text[first]


def _counted(ids: np.ndarray, pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The packed postings of tokens of the documents ``ids``."""
    data, size, text = (np.concatenate(x) for x in zip(*pieces, strict=True))
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    docs, place = np.unique(ids, return_inverse=True)
    key = np.sort(np.asarray(terms.indices).astype(np.int64) * len(docs) + place[text])
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    tf, (term, doc) = np.diff(np.append(at, len(key))), np.divmod(key[at], len(docs))
    doc = docs[doc]
    part = doc // RANGE
    new = np.append(True, (term[1:] != term[:-1]) | (part[1:] != part[:-1]))[: len(term)]
    starts = np.flatnonzero(new)
    gap = np.where(new, doc - part * RANGE, np.diff(doc, prepend=0))
    packed, bytes_of = pack_integers(np.stack([gap, tf], axis=1).ravel())
    n = np.diff(np.append(starts, len(term))).astype(np.int32)
    blob = binary(packed, bytes_of.reshape(-1, 2).sum(axis=1), starts)
    return pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(term[starts])), pa.array(part[starts]), pa.array(n), blob], names=["term", "range", "n", "data"])


def packed(docs: DataFrame) -> DataFrame:
    """(term, range, n, data) of (doc_id, text): the postings of pieces of the input, without a shuffle; documents without
    a number are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pieces, texts, held = [], [], 0, 0
        for b in batches:
            t = b.column(1)
            offsets = np.frombuffer(t.buffers()[1], np.int64 if pa.types.is_large_string(t.type) else np.int32)[t.offset : t.offset + len(t) + 1]
            data = np.frombuffer(t.buffers()[2] or b"", np.uint8)
            cuts = [0, *(np.flatnonzero(np.diff((offsets[1:] - offsets[0]) // CHUNK)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                bounds = offsets[lo : hi + 1].astype(np.int64)
                own, size, text = tokens_of(data[bounds[0] : bounds[-1]], (bounds - bounds[0])[:-1])
                ids.append(np.asarray(b.column(0))[lo:hi])
                pieces.append((own, size, text + texts))
                texts, held = texts + hi - lo, held + int(bounds[-1] - bounds[0])
                if held >= PIECE:
                    yield _counted(np.concatenate(ids), pieces)
                    ids, pieces, texts, held = [], [], 0, 0
        if pieces:
            yield _counted(np.concatenate(ids), pieces)

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def by_range(rows: DataFrame) -> DataFrame:
    """Packed rows dealt by ranges of the term and the documents, for tables that scans prune."""
    return rows.repartitionByRange("term", "range").sortWithinPartitions("term", "range")


def by_hash(rows: DataFrame) -> DataFrame:
    return rows.repartition("term", "range").sortWithinPartitions("term", "range")


def merged(rows: DataFrame, made: Merged, schema: str) -> DataFrame:
    """``made(terms, ranges, starts, docs, frequencies)`` of the groups of sorted packed rows: each term and range comes once,
    whole, with its documents in order; those of group i begin at ``starts[i]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in (part for whole in batches for part in _parts(whole, MERGED)):
            cut = int(_starts(b)[-1])
            if cut or (rest and _key(rest[-1], -1) != _key(b, 0)):  # what is held is whole, or ends in this batch
                yield made(*_merge(pa.Table.from_batches([*rest, b.slice(0, cut)]).combine_chunks().to_batches()[0]))
                rest = []
            rest.append(b.slice(cut))
        if rest:
            yield made(*_merge(pa.Table.from_batches(rest).combine_chunks().to_batches()[0]))

    return rows.select("term", "range", "n", "data").mapInArrow(run, schema)


def _parts(b: pa.RecordBatch, postings: int) -> Iterator[pa.RecordBatch]:
    cuts = np.flatnonzero(np.diff(np.cumsum(np.asarray(b.column(2)).astype(np.int64)) // postings)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
        if hi > lo:
            yield b.slice(lo, hi - lo)


def _key(b: pa.RecordBatch, at: int) -> tuple[str, int]:
    at %= b.num_rows
    return b.column(0)[at].as_py(), b.column(1)[at].as_py()


def _starts(b: pa.RecordBatch) -> np.ndarray:
    part = np.asarray(b.column(1))
    other = np.asarray(pc.not_equal(b.column(0).slice(1), b.column(0).slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False), bool)
    return np.flatnonzero(np.append(True, other | (part[1:] != part[:-1])))


def _merge(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts = _starts(b)
    n = np.asarray(b.column(2)).astype(np.int64)
    blob = b.column(3)
    offsets = np.frombuffer(blob.buffers()[1], np.int64 if pa.types.is_large_binary(blob.type) else np.int32)[blob.offset : blob.offset + len(blob) + 1]
    pairs = unpack_integers(np.frombuffer(blob.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]).reshape(-1, 2)
    row = np.cumsum(n) - n
    sums = np.cumsum(pairs[:, 0])
    within = sums - np.repeat(sums[row] - pairs[row, 0], n)
    group = np.repeat(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, b.num_rows))), n)
    key, tf = group * RANGE + within, pairs[:, 1]
    if not (key[1:] > key[:-1]).all():
        order = np.argsort(key, kind="stable")
        key, tf = key[order], tf[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, tf = key[new], np.add.reduceat(tf, new)  # rows of one document number count as one document
    part = np.asarray(b.column(1))[starts]
    group = key // RANGE
    return b.column(0).take(pa.array(starts)), part, np.searchsorted(group, np.arange(len(starts))), part[group] * RANGE + key % RANGE, np.ascontiguousarray(tf)


def sizes(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(starts, total))


def long_rows(rows: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of sorted packed rows, in the same order."""

    def made(terms: pa.Array, _: np.ndarray, starts: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(terms)), sizes(starts, len(doc)))
        return pa.RecordBatch.from_arrays([terms.take(pa.array(of)), pa.array(doc), pa.array(tf)], names=["term", "doc_id", "tf"])

    return merged(rows, made, "term string, doc_id long, tf long")
