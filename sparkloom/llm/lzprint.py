"""Lempel-Ziv phrase fingerprints.

A text is parsed into phrases, each the shortest run of characters that isn't a phrase yet (LZ78 with a set of phrases
for its dictionary).  Every phrase is hashed, from prefix sums over the text, and the smallest hashes are the
fingerprint.  The likeness of two fingerprints estimates the share of common phrases, which follows how well one text
compresses the other (Raff and Nicholas, 2017).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import need

SIZE = 128
MULTIPLIER = 0xD6E8FEB86659FD93
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
MASK = (1 << 64) - 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse; kept up to a bound."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 14)
        made = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, m, np.uint64)))) for m in (MULTIPLIER, INVERSE)]
        if size > 1 << 20:
            return made[0][:n], made[1][:n]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def parse(text: str, phrases: set[str], start: int = 0, at: int | None = None) -> tuple[list[int], int]:
    """Continue a parse: the last phrase began at ``start``, characters from ``at`` on are new.

    Returns the ends of the phrases found and where the unfinished phrase begins.
    """
    ends: list[int] = []
    end, n, add = (start if at is None else at) + 1, len(text), phrases.add
    while end <= n:
        phrase = text[start:end]
        if phrase in phrases:
            end += 1
        else:
            add(phrase)
            ends.append(end)
            start = end
            end += 1
    return ends, start


def _hashes(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each [start, end) of the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(0x51ED27)
    up, down = _powers(len(codes) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[1:])))
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(32)


def _sketch(h: np.ndarray) -> np.ndarray:
    """The SIZE smallest different 32-bit hashes, sorted."""
    h = h >> np.uint64(32)
    if len(h) > 4 * SIZE:
        h = np.partition(h, 2 * SIZE)[: 2 * SIZE]
    return np.unique(h)[:SIZE].astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases, 0 to 1; two empty fingerprints are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SIZE]  # sketches of fewer hashes are whole sets: their likeness is exact
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def _all(ends: list[int], rest: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all phrases; an unfinished last phrase counts as one."""
    e = np.array([*ends, n] if rest < n else ends, dtype=np.int64)
    return np.concatenate((np.zeros(min(1, len(e)), np.int64), e[:-1])), e


def fingerprint(text: str) -> np.ndarray:
    ends, rest = parse(text, set())
    return _sketch(_hashes(text, *_all(ends, rest, len(text)))) if text else np.zeros(0, np.uint32)


def pair(text: str, edited: str, same: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two texts whose first ``same`` characters are equal; those are parsed once."""
    if not text:
        return fingerprint(text), fingerprint(edited)
    phrases: set[str] = set()
    head, start = parse(text[:same], phrases)
    other = set(phrases)
    tail, rest = parse(text, phrases, start, same)
    tail2, rest2 = parse(edited, other, start, same)
    return tuple(_sketch(_hashes(t, *_all(head + e, r, len(t)))) if t else np.zeros(0, np.uint32) for t, e, r in ((text, tail, rest), (edited, tail2, rest2)))


def as_hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def neighbour_prints(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row per row.

    The edited text of a row has its last floor(n/4) code points replaced by the first as many (or all) of the next
    row's text in order of id, then text; the last row's next is the first.  Rows are dealt by ranges of the id, four a
    partition, cut at quantiles; the first row of each range is sent to the range before too,
    so each row meets its next without a window over all rows.  Ids are whole numbers; rows of one id, and those of a null
    one, fall in one range and so in one task.

    Null and empty texts have an empty fingerprint; empty and empty are alike (1), empty and other unlike (0).  Null
    ids come first; rows that repeat follow one another; a table of one row is its own next.
    """
    spark = docs.sparkSession
    rows = need(docs, id_col, text_col).toDF("id", "text").select("id", F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bounds = _bounds(rows, 4 * parts)
    cuts = spark.sparkContext.broadcast(bounds)

    kind = rows.schema["id"].dataType.simpleString()

    def range_of(ids: pa.Array) -> np.ndarray:
        """How many bounds are at or below each id; null ids are in the first range."""
        at = np.searchsorted(np.array(cuts.value, np.int64), np.asarray(ids.fill_null(0)), side="right")
        at[np.asarray(ids.is_null())] = 0
        return at.astype(np.int32)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(b.column(0))), b.column(0)], names=["part", "id"])

    numbered = rows.select("id").mapInArrow(number, f"part int, id {kind}")
    firsts = {r["part"]: r["first"] for r in numbered.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("first")).collect()}
    order = sorted(firsts)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    heads = {firsts[p]["id"]: before[p] for p in order}  # id of a range's first row -> the range that needs it
    sent = spark.sparkContext.broadcast(heads)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            at = range_of(ids)
            names = ["part", "guest", "id", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), bool)), ids, b.column(1)], names=names)
            also = [i for i, v in enumerate(ids.to_pylist()) if v in sent.value]
            if also:
                to = [sent.value[v] for v in ids.take(pa.array(also)).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([True] * len(to)), ids.take(pa.array(also)), b.column(1).take(pa.array(also))], names=names)

    dealt = rows.mapInArrow(deal, f"part int, guest boolean, id {kind}, text string")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "guest", F.col("id").asc_nulls_first(), "text")
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        held: tuple | None = None  # part, id, text: the row that waits for its next
        guests = False

        def done(row: tuple, nxt: str) -> tuple:
            text = row[2]
            n = len(text)
            cut = n - n // 4
            edited = text[:cut] + nxt[: n // 4]
            own, other = pair(text, edited, cut)
            return row[1], n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, other, likeness(own, other)

        waiting: tuple | None = None  # a finished row that waits for its next's fingerprint

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        out: list[tuple] = []

        def finish(row: tuple, sketch: np.ndarray) -> None:
            i, n, sha, own, other, near = row
            out.append((i, n, sha, as_hex(own), as_hex(other), near, likeness(own, sketch)))

        for b in batches:
            for part, guest, i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None and held[0] != part:  # a range without a guest: it can't be
                    raise RuntimeError("a range's next row is missing")
                if guest and guests:
                    continue  # repeats of the next range's first id
                if held is not None:
                    row = done(held, text)
                    if waiting is not None:
                        finish(waiting, row[3])
                    waiting = row
                held = None if guest else (part, i, text)
                if guest:
                    finish(waiting, fingerprint(text))
                    waiting = None
                guests = guest
                if len(out) >= 2000:
                    yield emit(out)
                    out = []
        if out:
            yield emit(out)

    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _bounds(rows: DataFrame, ranges: int) -> list[int]:
    """At most ranges - 1 ids that cut the rows into ranges of like counts; they place rows and don't change results."""
    quantiles = F.percentile_approx(F.col("id").cast("long"), [i / ranges for i in range(1, ranges)], 10_000)
    return sorted(set(rows.where("id is not null").select(quantiles.alias("q")).first()["q"] or []))
