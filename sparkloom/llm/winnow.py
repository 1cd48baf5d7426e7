"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every sliding window of ``span - k + 1`` k-grams, so any common run of
``span`` words holds a fingerprint that both sides kept.  Documents probe the benchmark's fingerprints and each hit is
extended word by word to the whole common run.  Items shorter than ``span`` words count as one window; they are looked
up by the hash of all their words at every position.

A benchmark of one block is broadcast.  Beyond that the fingerprints of both sides are joined, and only the texts that
share one are read again with the blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha1
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import join_counted, materialise, need

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


#: Of each byte: a-z for A-Z, a blank for what is in no word, else itself.
FOLD = bytes(c[0] if WORD.match(c) else 32 for c in (bytes([i]).lower() for i in range(256)))
FOLD_ARRAY = np.frombuffer(FOLD, np.uint8)
#: CRC-32 of each byte; bytes of texts that are hashed at once; bytes of a word beyond which it is hashed alone.
CRC = np.array([crc32(bytes([i])) for i in range(256)], np.uint32)
CRC ^= CRC[0]
CHUNK, LONG = 1 << 18, 24


def words(text: str | None) -> list[bytes]:
    """Words of digits, letters and anything beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def mixed(tokens: list[bytes]) -> np.ndarray:
    return _mix(np.fromiter(map(crc32, tokens), np.uint64, len(tokens)))


def _mix(h: np.ndarray) -> np.ndarray:
    h += np.uint64(1)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ h >> np.uint64(29)


def hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hashes of the words, words of each text) of some texts at a time, without nulls: mixed()
    of words() of one text after another."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    cuts = [0, *(np.flatnonzero(np.diff((offsets[1:] - offsets[0]) // CHUNK)) + 1).tolist(), len(texts)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo == hi:
            continue
        bounds = offsets[lo : hi + 1].astype(np.int64)
        own = FOLD_ARRAY[data[bounds[0] : bounds[-1]]]
        bounds -= bounds[0]
        inside = np.zeros(len(own) + 2, bool)
        inside[1:-1] = own != 32
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edge = bounds[(bounds > 0) & (bounds < len(own))]  # texts are parted though no blank stands between them
        first[edge], last[edge - 1] = inside[1:-1][edge], inside[1:-1][edge - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        yield lo, _mix(_crc(own, starts, ends).astype(np.uint64)), np.diff(np.searchsorted(starts, bounds))


def _crc(own: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes from starts to ends: all words' first bytes, all words' second bytes, and so on."""
    size = np.minimum(ends - starts, LONG + 1).astype(np.uint8)
    order = np.argsort(LONG + 1 - size, kind="stable")
    at, longer = starts[order], np.cumsum(np.bincount(size, minlength=LONG + 2)[::-1])[::-1]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for place in range(int(size.max()) if len(size) else 0):
        at, some = at[: int(longer[place + 1])], state[: int(longer[place + 1])]
        low = some.astype(np.uint8) ^ own.take(at)
        some >>= np.uint32(8)
        some ^= CRC.take(low)
        at += 1
    out = np.empty(len(state), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = crc32(own[starts[i] : ends[i]])
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for j in range(1, k):
        out *= BASE
        out += h[j : j + n]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xC4CEB9FE1A85EC53)


def kept(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost smallest hash of each window; of all of them if there are fewer."""
    if not len(g):
        return np.zeros(0, np.int64)
    if len(g) <= window:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))])
    at = np.arange(len(g) - window + 1) + rightmost(g, window)
    return at[np.concatenate((_TRUE, at[1:] != at[:-1]))]  # places never fall from window to window


_TRUE = np.ones(1, bool)


def rightmost(g: np.ndarray, window: int) -> np.ndarray:
    """How far in each window its rightmost smallest hash is."""
    n = len(g) - window + 1
    least, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        other = g[j : j + n]
        at[other <= least] = j
        np.minimum(least, other, out=least)
    return at


@dataclass
class Index:
    """Fingerprints of one block of benchmark items."""

    span: int
    k: int
    items: list[tuple[object, list[bytes]]] = field(default_factory=list)
    keys: np.ndarray | None = None
    places: list[tuple[int, int]] = field(default_factory=list)
    short: dict[int, dict[int, list[int]]] = field(default_factory=dict)

    def build(self) -> Index:
        found: list[tuple[int, int, int]] = []
        for i, (_, ws) in enumerate(self.items):
            h = mixed(ws)
            if len(ws) >= self.span:
                g = grams(h, self.k)
                found += [(int(g[p]), i, int(p)) for p in kept(g, self.span - self.k + 1)]
            elif ws:
                self.short.setdefault(len(ws), {}).setdefault(int(grams(h, len(ws))[0]), []).append(i)
        found.sort()
        self.keys = np.array([f[0] for f in found], dtype=np.uint64)
        self.places = [f[1:] for f in found]
        return self

    def hits(self, ws: list[bytes], h: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs (first word, end) of a text that lie in occurrences of windows, and the items they come from."""
        runs: list[tuple[int, int]] = []
        seen: set[int] = set()
        if len(ws) >= self.span and len(self.keys):
            g = grams(h, self.k)
            at = kept(g, self.span - self.k + 1)
            lo = np.searchsorted(self.keys, g[at])
            ok = lo < len(self.keys)
            ok[ok] = self.keys[lo[ok]] == g[at[ok]]
            ends: dict[tuple[int, int], int] = {}  # where the last run on this diagonal of this item ended
            for p, s in zip(at[ok].tolist(), lo[ok].tolist(), strict=True):
                key = self.keys[s]
                while s < len(self.keys) and self.keys[s] == key:
                    i, q = self.places[s]
                    s += 1
                    if ends.get((i, p - q), -1) > p:
                        continue
                    iw, a, b = self.items[i][1], 0, 0
                    while a < p and a < q and ws[p - a - 1] == iw[q - a - 1]:
                        a += 1
                    while p + b < len(ws) and q + b < len(iw) and ws[p + b] == iw[q + b]:
                        b += 1
                    ends[i, p - q] = p + b
                    if a + b >= self.span:
                        runs.append((p - a, p + b))
                        seen.add(i)
        for n, table in self.short.items():
            if len(ws) < n:
                continue
            g = grams(h, n)
            for p in np.flatnonzero(np.isin(g, np.array(list(table), dtype=np.uint64))).tolist():
                for i in table[int(g[p])]:
                    if ws[p : p + n] == self.items[i][1]:
                        runs.append((p, p + n))
                        seen.add(i)
        return runs, seen


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, lengths: range = range(1, 1 << 62)) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items of so many words, in blocks of at most block_bytes of text (a longer item is a block of its own)."""
    block: list[tuple[object, list[bytes]]] = []
    size = 0
    for row in need(benchmark, item_col, text_col).toLocalIterator():
        ws = words(row[1])
        if len(ws) not in lengths:
            continue
        cost = sum(map(len, ws)) + 60 * len(ws)
        if block and size + cost > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], ws))
        size += cost
    if block:
        yield block


def _digest(text_col: str) -> Column:
    return F.sha1(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))


def _prints(texts: DataFrame, text_col: str, span: int, k: int) -> DataFrame:
    """(other columns, n_words, prints): the different fingerprints of each text; none if it has fewer than span words."""
    rest = [c for c in texts.columns if c != text_col]
    kinds = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, prints = [], []
            for t in b.column(len(rest)):
                ws = words(t.as_py())
                g = grams(mixed(ws), k) if len(ws) >= span else np.zeros(0, np.uint64)
                n_words.append(len(ws))
                prints.append(np.unique(g[kept(g, span - k + 1)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(n_words, pa.int64()), pa.array(prints, pa.list_(pa.int64()))], names=[*rest, "n_words", "prints"])

    return texts.select(*rest, text_col).mapInArrow(run, ", ".join([*kinds, "n_words long, prints array<long>"]))


RUNS = "array<struct<start:int,stop:int>>"


def _scan(texts: DataFrame, block: list[tuple[object, list[bytes]]], span: int, k: int) -> DataFrame:
    """(key, n_words, runs, items) of (key, text) against one block of items, broadcast."""
    sent = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(span, k, sent.value).build()
        names = [None if i is None else str(i) for i, _ in index.items]
        for b in batches:
            n_words, runs, items = [], [], []
            for t in b.column(1):
                ws = words(t.as_py())
                got, seen = index.hits(ws, mixed(ws)) if ws else ([], set())
                n_words.append(len(ws))
                runs.append([{"start": x, "stop": y} for x, y in _union(got)])
                items.append(sorted({names[i] for i in seen if names[i] is not None}))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(runs, kind), pa.array(items, pa.list_(pa.string()))],
                names=["key", "n_words", "runs", "items"],
            )

    key = texts.schema[0].dataType.simpleString()
    return texts.mapInArrow(run, f"key {key}, n_words long, runs {RUNS}, items array<string>")


def find_overlap(
    docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 32 << 20,
) -> DataFrame:
    """(id_col, n_words, runs, items): one row per row of ``docs``.

    ``runs`` are the disjoint word runs [first, end) inside occurrences of benchmark windows, ``items`` the ids, as
    sorted strings, of the items with an occurring window.  A benchmark of at most ``block_bytes`` is broadcast and takes
    one pass over the documents.  Of a larger one the fingerprints are joined with the documents', and the blocks are
    then read against the different texts that share a fingerprint; items of under ``span`` words, which have none, take
    a pass a block over all documents.

    Null and empty texts have no words; null item texts match nothing; a null item id is left out of ``items`` but its
    windows count; documents that repeat count each, items that repeat an id once; an empty benchmark gives no hits.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _scan(need(docs, id_col, text_col), first, span, k).select(F.col("key").alias(id_col), "n_words", "runs", "items")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _digest(text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))
    rows_prints = materialise(_prints(rows, "text", span, k), "prints")
    known = _prints(benchmark.select(F.col(f"`{item_text_col}`").alias("text")), "text", span, k).select(F.explode("prints").alias("print")).distinct()
    shared = rows_prints.select("key", F.explode("prints").alias("print")).join(known, "print", "left_semi").select("key").distinct()
    hit = materialise(join_counted(rows.select("key", "text"), materialise(shared, "shared"), ["key"], 128).select("key", "text").dropDuplicates(["key"]), "texts")
    parts = [materialise(_scan(hit, b, span, k).where(F.size("runs") > 0), "overlap") for b in _blocks(benchmark, item_col, item_text_col, block_bytes, range(span, 1 << 62))]
    parts += [materialise(_scan(rows.select("key", "text"), b, span, k).where(F.size("runs") > 0), "overlap") for b in _blocks(benchmark, item_col, item_text_col, block_bytes, range(1, span))]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    # one row per text and block: bounded by the number of blocks
    hits = hits.select("key", "runs", "items").distinct()
    merged = hits.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    step = F.aggregate(
        F.array_sort("runs"),
        F.expr(f"cast(array() as {RUNS})"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    merged = merged.select("key", step.alias("runs"), F.array_sort(F.array_distinct("items")).alias("items"))
    whole = rows_prints.select("id", "key", "n_words").join(merged, "key", "left")
    none = F.expr(f"cast(array() as {RUNS})"), F.expr("cast(array() as array<string>)")
    return whole.select(F.col("id").alias(id_col), "n_words", F.coalesce("runs", none[0]).alias("runs"), F.coalesce("items", none[1]).alias("items"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, text_col: str = "text", item_text_col: str = "text", most_share: float = 0.0,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose share of words in benchmark windows is at most ``most_share``.

    With a benchmark of one block rows are judged in place and nothing is joined; beyond that the digests of the texts
    to leave out are found as in ``find_overlap`` and joined away.  Null and empty texts stay; rows that repeat are
    judged each, alike; null item texts match nothing; an empty table stays empty and an empty benchmark leaves all rows.
    """
    items = benchmark.select(F.lit(0).alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    blocks = _blocks(items, "item", "text", block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is not None:
        keyed = docs.select(_digest(text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))
        found = find_overlap(keyed, items, span, k, "key", "text", "item", "text", block_bytes)
        hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
        out = materialise(found.where(hit > F.lit(float(most_share)) * F.col("n_words")).select(F.col("key").alias("left_out")).distinct(), "left_out")
        return docs.join(out, _digest(text_col) == out["left_out"], "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(first)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(span, k, sent.value).build()
        for b in batches:
            keep = []
            for t in b.column(at):
                ws = words(t.as_py())
                runs = _union(index.hits(ws, mixed(ws))[0]) if ws else []
                keep.append(sum(y - x for x, y in runs) <= most_share * len(ws))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
