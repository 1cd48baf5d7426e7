"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint stands for all variants within half the radius; two fingerprints within the radius share at
least one variant.  Variants are dealt by their leading bits: a fingerprint is sent once to each group of variants that
its ball reaches (79 groups of 4,096 for radius 4) and the variants are written out there, so the shuffle carries some
eighty short rows a fingerprint in place of 2,081.  Fingerprints that share a variant are all within the radius of one
another, so linking each to the smallest of them loses no connection and never lists all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import connected_components, hot_join, join_counted, materialise, need, salted_join
from sparkloom.llm.winnow import grams, mixed

SEED = 42
#: Leading bits that deal variants to groups.
TOP_BITS = 12
#: Fingerprints that a group may hold before more bits divide it.
GROUP_ROWS = 200_000
#: Variants held in memory at once.
CHUNK = 1 << 21
#: Rows that a task gathers before it links the whole groups among them.
GATHER = 200_000


def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash over the word shingles of the whole text, repeats counted; no words: 0."""
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    n = len(gaps) + 1
    if n <= words:
        return xxhash.xxh64_intdigest(data, SEED)
    digest, step = xxhash.xxh64_intdigest, 1 << 16
    total, count = np.zeros(64, np.int64), n - words + 1
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    for at in range(0, count, step):
        to = min(count, at + step)
        pairs = zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist(), strict=True)
        h = np.array([digest(data[s:e], SEED) for s, e in pairs], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    set_bits = np.packbits(2 * total > count, bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed 64-bit number."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(got.view(np.int64))], schema=schema)

    return need(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


@lru_cache
def _masks(bits: int, most: int) -> list[np.ndarray]:
    """At r: the numbers of ``bits`` bits with at most r set, for r from 0 to ``most``."""
    out = [[0]]
    for r in range(1, most + 1):
        out.append(out[-1] + [sum(1 << i for i in c) for c in combinations(range(bits), r)])
    return [np.array(x, dtype=np.uint64) for x in out]


def _links(fps: np.ndarray, prefix: np.ndarray, width: np.ndarray, half: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Star links among fingerprints of one partition; ``prefix`` holds the ``width`` leading bits of the variants."""
    order = np.lexsort((fps, prefix, width))
    fps, prefix, width = fps[order], prefix[order], width[order]
    cut = np.flatnonzero((np.diff(prefix) != 0) | (np.diff(width) != 0)) + 1
    bounds = np.concatenate(([0], cut, [len(fps)]))
    masks: dict[int, list[np.ndarray]] = {}

    def write_out(lo: int, hi: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        """All variants in these rows' groups, and the row of each."""
        low = 64 - w
        lows = masks.setdefault(w, _masks(low, half))
        flips = fps[lo:hi] >> np.uint64(low) ^ prefix[lo:hi]
        used = np.bitwise_count(flips)
        vs, rows = [], []
        for r in range(half + 1):
            at = np.flatnonzero(used == half - r)
            if len(at):
                v = (fps[lo:hi][at] ^ flips[at] << np.uint64(low))[:, None] ^ lows[r][None, :]
                vs.append(v.ravel())
                rows.append(np.repeat(at + lo, len(lows[r])))
        return np.concatenate(vs), np.concatenate(rows)

    def stars(v: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        s = np.sort(v)
        dup = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(dup):
            return None
        at = np.searchsorted(dup, v)
        at[at == len(dup)] = 0
        hit = dup[at] == v
        group, f = at[hit], fps[rows[hit]]
        least = np.full(len(dup), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, group, f)
        pairs = np.unique(np.stack([least[group], f], axis=1), axis=0)
        pairs = pairs[(pairs[:, 0] != pairs[:, 1]) & (np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius)]
        return (pairs[:, 0], pairs[:, 1]) if len(pairs) else None

    i = 0
    while i < len(bounds) - 1:
        w = int(width[bounds[i]])
        per_row = sum(comb(64 - w, r) for r in range(half + 1))
        j = i + 1
        while j < len(bounds) - 1 and width[bounds[j]] == w and (bounds[j + 1] - bounds[i]) * per_row <= CHUNK * 4:
            j += 1
        lo, hi = int(bounds[i]), int(bounds[j])
        if j > i + 1 or (hi - lo) * per_row <= CHUNK * 4:
            got = stars(*write_out(lo, hi, w))
            if got:
                yield got
        elif hi - lo > 1:  # a group too large for memory: its variants are taken in turns, by a hash of the variant
            turns, slab = -(-(hi - lo) * per_row // CHUNK), max(1, CHUNK // per_row)
            for turn in range(turns):
                vs, rows = [], []
                for at in range(lo, hi, slab):
                    v, r = write_out(at, min(hi, at + slab), w)
                    mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(turns) == turn
                    vs.append(v[mine])
                    rows.append(r[mine])
                got = stars(np.concatenate(vs), np.concatenate(rows))
                if got:
                    yield got
        i = j


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
    """Each linked fingerprint's root among these links, so that a piece of a partition sends a link a node at most."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def _deal(values: np.ndarray, bits: int, top: int, half: int, extra: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, leading bits, how many) of the groups of variants that each value's ball reaches.

    A group has ``top`` leading bits in common, and as many more as ``extra`` holds for it.
    """
    first = values >> np.uint64(bits - top)
    for flip in _masks(top, half)[half].tolist():
        bucket = first ^ np.uint64(flip)
        more = extra[bucket.astype(np.int64)]
        for k in np.unique(more).tolist():
            own = np.flatnonzero(more == k)
            sub = values[own] >> np.uint64(bits - top - k) & np.uint64((1 << k) - 1)
            for m in _masks(k, half)[half - flip.bit_count()]:
                yield own, bucket[own] << np.uint64(k) | sub ^ m, top + k


def _extra(loads: np.ndarray, top: int, half: int, bits: int, most: int) -> np.ndarray:
    """Further leading bits for each group, by the rows that its variants come from: about ``most`` rows a group."""
    reach = sum(loads[..., np.arange(1 << top) ^ int(m)] for m in _masks(top, half)[half])
    return np.clip(np.ceil(np.log2(np.maximum(reach, 1) / most)), 0, bits - top).astype(int)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Sorted rows in pieces of GATHER or more that hold whole groups of the first ``keys`` columns."""
    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        held.append([np.asarray(c) for c in b.columns])
        size += b.num_rows
        if size >= GATHER:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            change = np.zeros(size - 1, bool)
            for c in cols[:keys]:
                change |= np.diff(c) != 0
            cut = np.flatnonzero(change)
            at = int(cut[-1]) + 1 if len(cut) else 0
            if at:
                yield [c[:at] for c in cols]
            held, size = [[c[at:] for c in cols]], size - at
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def ball_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links among the distinct values of column ``fp`` that connect just those within ``radius`` bits.

    Groups whose load is above GROUP_ROWS get further leading bits, as many as a count per group asks for; that count
    has 2**TOP_BITS rows at any size of input.  A task reads its groups in order and holds some of them at a time.
    """
    half = (radius + 1) // 2
    loads = np.zeros(1 << TOP_BITS)
    top = F.shiftrightunsigned("fp", 64 - TOP_BITS).cast("int")
    for r in fps.groupBy(top.alias("top")).count().collect():
        loads[r["top"]] = r["count"]
    extra = _extra(loads, TOP_BITS, half, 36, GROUP_ROWS)
    schema = pa.schema([("prefix", pa.int64()), ("width", pa.int32()), ("fp", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                fp = np.asarray(b.column(0).slice(at, 20_000)).view(np.uint64)
                for own, prefix, width in _deal(fp, 64, TOP_BITS, half, extra):
                    yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(np.full(len(prefix), width, np.int32)), pa.array(fp[own].view(np.int64))], schema=schema)

    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prefix, width, fp in _whole_groups(batches, 2):
            got = _forest(_links(fp.view(np.uint64), prefix.view(np.uint64), width, half, radius))
            if got:
                nodes = np.array(list(got.items()), dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[:, 0].copy()), pa.array(nodes[:, 1].copy())], schema=links)

    dealt = fps.select("fp").mapInArrow(deal, "prefix long, width int, fp long").repartition("prefix", "width").sortWithinPartitions("prefix", "width")
    return dealt.mapInArrow(link, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id): one row per row of ``docs``.

    Two texts are linked if their fingerprints differ in ``radius`` bits or fewer; component_id is the smallest id
    reachable over links.  Ids are whole numbers.  Null and empty texts have fingerprint 0 and are linked like any other; repeated rows stay;
    a null id takes part and its row is returned, but it is never a component_id unless the component has only null
    ids (then null).  An empty table gives an empty result.
    """
    own = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = materialise(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(ball_links(distinct, radius))
    roots = materialise(roots.select(F.col("node").alias("fp"), "root"), "roots")
    whole = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = salted_join(whole.select("fp", "root"), least, "root", F.col("fp")).select("fp", "component_id")
    out = salted_join(own, by_fp, "fp", F.col("id"), "left")
    return out.select(F.col("id").alias(id_col), "fp", "component_id")


#: The wide fingerprint: TABLES tables of TABLE_BITS bits, ball-hashed side by side, and a word to check candidates by.
TABLES, TABLE_BITS, TABLE_RADIUS = 38, 32, 2
WIDE_WORDS = TABLES * TABLE_BITS // 64 + 1
#: Of 1280 bits: texts within TIGHT are surely alike (0.9 or more), beyond LOOSE they surely aren't (under 0.73); at 0.8
#: they are 194 apart on average.  This holds for texts of SHORT shingles or more; shorter ones are compared as texts
#: within LOOSE_SHORT.  Candidates within FAMILY bits (0.5) belong to one family.
TIGHT, LOOSE, LOOSE_SHORT, FAMILY, SHORT = 123, 236, 330, 330, 32
CHECK_BITS = 20
#: Leading bits that deal a table's variants to groups, and rows that a group may hold before more divide it.
TABLE_TOP, TABLE_ROWS = 4, 100_000
#: Tables whose links gather texts that may be alike into families.
STAR_TABLES = 6
#: Texts of a family that a task compares with one another, or with as many others.
BLOCK = 512


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Different hashes of the word shingles of the whole text."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(grams(mixed(ws), min(words, len(ws)))) if ws else np.zeros(0, np.uint64)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of WIDE_WORDS words over a set of shingle hashes; none: 0."""
    total = np.zeros(64 * WIDE_WORDS, np.int64)
    for at in range(0, len(h), 4080):
        part = h[at : at + 4080]
        wide = np.empty((len(part), WIDE_WORDS), np.uint64)
        for k in range(WIDE_WORDS):
            x = part + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            wide[:, k] = x ^ x >> np.uint64(31)
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(h), bitorder="little").view("<u8").astype(np.uint64)


def _across(bucket: np.ndarray, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one bucket that have different roots, some CHUNK at a time."""
    order = np.lexsort((roots, bucket))
    new = np.diff(bucket[order]) != 0
    ends = [np.append(np.flatnonzero(cut) + 1, len(order)) for cut in (new, new | (np.diff(roots[order]) != 0))]
    bucket_end, root_end = (e[np.searchsorted(e, np.arange(len(order)), "right")] for e in ends)
    count = bucket_end - root_end
    total = np.cumsum(count)
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK, "right")))
        n = count[lo:hi]
        first = np.repeat(root_end[lo:hi] - (np.cumsum(n) - n), n)
        yield order[np.repeat(np.arange(lo, hi), n)], order[first + np.arange(len(first))]
        lo = hi


def _table_pairs(value: np.ndarray, flips: np.ndarray, width: int, group: np.ndarray, check: np.ndarray, roots: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of whole groups of one table and width that share a variant and whose check words are near: with
    ``roots`` all of different roots, each once a table; without, those of each row with the first, by check word, of the
    rows within half the radius of its value, and with the one before it."""
    half, low = (TABLE_RADIUS + 1) // 2, TABLE_BITS - width
    lows = _masks(low, half)
    used = np.bitwise_count(flips)
    base = value ^ flips << np.uint64(low)
    sizes = np.array([len(lows[half - r]) for r in range(half + 1)])[used]
    turns, slab = max(1, -(-int(sizes.sum()) // (4 * CHUNK))), max(1, CHUNK // len(lows[half]))
    for turn in range(turns):
        vs, rows = [], []
        for r in range(half + 1):
            at = np.flatnonzero(used == half - r)
            for k in range(0, len(at), slab):
                own = at[k : k + slab]
                v = (base[own][:, None] ^ lows[r][None, :]).ravel()
                who = np.repeat(own, len(lows[r]))
                if turns > 1:
                    mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(turns) == turn
                    v, who = v[mine], who[mine]
                vs.append(v)
                rows.append(who)
        v, who = np.concatenate(vs), np.concatenate(rows)
        order = np.lexsort((check[who], v, group[who]))
        v, who = v[order], who[order]
        new = np.concatenate(([True], (np.diff(v) != 0) | (np.diff(group[who]) != 0)))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(v)))
        bucket = np.repeat(np.arange(len(start)), size)
        if roots is None:
            at = np.flatnonzero(~new & (v == value[who]))
            pairs = ((who[start[bucket[at]]], who[at]), (who[at - 1], who[at]))
        else:
            shared = (size > 1)[bucket]
            v, who, bucket = v[shared], who[shared], bucket[shared]
            pairs = _met(v, bucket, who, value, roots)
        for a, b in pairs:
            near = np.bitwise_count(check[a] ^ check[b]) <= CHECK_BITS
            yield a[near], b[near]


def _met(v: np.ndarray, bucket: np.ndarray, who: np.ndarray, value: np.ndarray, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different roots, at the smallest variant that they share only."""
    for a, b in _across(bucket, roots[who]):
        apart = value[who[a]] ^ value[who[b]]
        bit = apart & (~apart + np.uint64(1))
        least = v[a] == np.minimum(value[who[a]] ^ bit, value[who[b]] ^ bit)
        yield who[a[least]], who[b[least]]


def wide_links(nodes: DataFrame) -> DataFrame:
    """(a, b): candidates among rows (node, wide array<long>), by ball hashing of each table: a few links a row, of
    STAR_TABLES tables, enough to gather families; or with a column ``root`` all pairs of different roots that share a
    variant of any table."""
    half, rooted = (TABLE_RADIUS + 1) // 2, "root" in nodes.columns
    tables = TABLES if rooted else STAR_TABLES
    loads = np.zeros((tables, 1 << TABLE_TOP))
    top = F.expr(f"shiftrightunsigned(element_at(wide, cast(t div 2 as int) + 1), case when t % 2 = 0 then {32 - TABLE_TOP} else {64 - TABLE_TOP} end) & {(1 << TABLE_TOP) - 1}")
    for r in nodes.select("wide", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t")).groupBy("t", top.cast("int").alias("top")).count().collect():
        loads[r["t"], r["top"]] = r["count"]
    extra = _extra(loads, TABLE_TOP, half, TABLE_BITS, TABLE_ROWS)
    names = ["key", "value", "check", "node"] + ["root"] * rooted

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, *root = (np.asarray(c) for i, c in enumerate(b.columns) if i != 1)
            wide = np.asarray(b.column(1).flatten()).view(np.uint64).reshape(b.num_rows, WIDE_WORDS)
            check = wide[:, -1].copy().view(np.int64)
            for t in range(tables):
                value = wide[:, t // 2] >> np.uint64(32 * (t % 2)) & np.uint64(0xFFFFFFFF)
                for own, prefix, width in _deal(value, TABLE_BITS, TABLE_TOP, half, extra[t]):
                    # table, width and leading bits are one key
                    key = prefix | np.uint64((t << 6 | width) << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, value[own])] + [pa.array(x[own]) for x in (check, node, *root)], names=names)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, value, check, node, *root in _whole_groups(batches, 1):
            kind, stars = key >> 32, []
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(kind)) + 1, [len(key)]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                width, own = int(kind[lo]) & 63, node[lo:hi]
                v = value[lo:hi].view(np.uint64)
                flips = v >> np.uint64(TABLE_BITS - width) ^ key[lo:hi].view(np.uint64) & np.uint64(0xFFFFFFFF)
                for a, b in _table_pairs(v, flips, width, key[lo:hi], check[lo:hi].view(np.uint64), root[0][lo:hi] if rooted else None):
                    pairs = np.stack([np.minimum(own[a], own[b]), np.maximum(own[a], own[b])], axis=1)
                    if rooted:
                        yield as_batch(pairs)
                    else:
                        stars.append(pairs)
            if stars:
                yield as_batch(np.unique(np.concatenate(stars), axis=0))

    def as_batch(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    dealt = nodes.select("node", "wide", *["root"] * rooted).mapInArrow(deal, "key long, value long, check long, node long" + ", root long" * rooted)
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long").distinct()


def _alike(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Whether two sets have a Jaccard similarity of ``similarity`` or more; two empty ones have."""
    if min(len(p), len(q)) < similarity * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both >= similarity * (len(p) + len(q) - both)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows, in whole groups of the first column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        key = np.asarray(b.column(0))
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != key[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _compare(rows: pa.Table, words: int, similarity: float) -> list[tuple[int, int]]:
    """Links that connect just the alike among texts of one block, or of two blocks between them: rows (task, node, block,
    across, n, wide, text).  Pairs are taken nearest bits first, and only if nothing connects them yet."""
    node, block, short = np.asarray(rows["node"]), np.asarray(rows["block"]), np.asarray(rows["n"]) < SHORT
    if len(node) < 2:
        return []
    wide = np.asarray(rows["wide"].combine_chunks().flatten()).view(np.uint64).reshape(len(node), WIDE_WORDS)
    across = bool(rows["across"][0].as_py())
    found = []
    for i in range(len(node) - 1):
        far = np.bitwise_count(wide[i + 1 :] ^ wide[i]).sum(axis=1, dtype=np.int64)
        ok = far <= np.where(short[i + 1 :] | short[i], LOOSE_SHORT, LOOSE)
        if across:
            ok &= block[i + 1 :] != block[i]
        j = np.flatnonzero(ok)
        found.append(np.stack([far[j], np.full(len(j), i), j + i + 1], axis=1))
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
    root, sets, out = list(range(len(node))), {}, []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def hashes(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = shingle_hashes(rows["text"][x].as_py(), words)
        return sets[x]

    for far, i, j in pairs.tolist():
        x, y = find(i), find(j)
        if x != y and (far <= TIGHT and not short[i] and not short[j] or _alike(hashes(i), hashes(j), similarity)):
            root[max(x, y)] = min(x, y)
            out.append((int(node[i]), int(node[j])))
    return out


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: one row of each group stays, that with the smallest id.

    Two texts are linked if the sets of their word shingles have a Jaccard similarity of ``similarity`` or more; groups
    are connected over links.  Texts at 0.8 differ in some 15 % of a SimHash's bits, beyond the reach of one ball in 64
    bits, so TABLES tables of TABLE_BITS bits are ball-hashed side by side (a pair at 0.8 shares a variant of one of them
    with a chance of 99 %) and verified: within TIGHT bits of the wide fingerprint a pair links, beyond LOOSE it doesn't,
    and between the two the texts themselves are compared.  The bits say less of texts of few shingles: those are
    compared as texts, and with under some 12 shingles one pair at 0.8 in six isn't found.

    Null and empty texts form one group; repeated rows are one group; of rows with a null id one stays before others;
    an empty table stays empty; further columns may have any names.
    """
    cols = docs.columns
    kind = docs.schema[id_col].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t.as_py(), words) for t in b.column(2)]
            wide = np.stack([wide_fingerprint(h) for h in hashes]) if b.num_rows else np.zeros((0, WIDE_WORDS), np.uint64)
            node = np.fromiter((xxhash.xxh64_intdigest(w.tobytes(), 0) for w in wide), np.uint64, b.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * WIDE_WORDS), pa.array(wide.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node.view(np.int64)), lists, pa.array([len(h) for h in hashes], pa.int32())], names=["id", "k", "node", "wide", "n"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.xxhash64(F.col(f"`{id_col}`"), text)  # rows that repeat have one key
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), key.alias("k"), text.alias("text"))
    own = materialise(keyed.mapInArrow(prints, f"id {kind}, k long, node long, wide array<long>, n int"), "wide")
    nodes = own.groupBy("node").agg(F.min(F.struct("id", "k")).alias("first"), F.min("wide").alias("wide"), F.min("n").alias("n"))
    nodes = materialise(nodes, "nodes")
    bits = nodes.select("node", "wide", (F.col("n") < SHORT).alias("short"))

    def near(pairs: DataFrame, most: int) -> DataFrame:
        """(a, b, far, short): the candidates within ``most`` bits, or LOOSE_SHORT where one is short."""
        half = salted_join(pairs.withColumnRenamed("a", "node"), bits, "node", F.col("b")).select(F.col("node").alias("a"), F.col("b").alias("node"), F.col("wide").alias("wa"), F.col("short").alias("sa"))
        both = salted_join(half, bits, "node", F.col("a")).select("a", F.col("node").alias("b"), F.zip_with("wa", "wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))).alias("d"), (F.col("sa") | F.col("short")).alias("short"))
        both = both.select("a", "b", F.aggregate("d", F.lit(0), lambda s, x: s + x).alias("far"), "short")
        return materialise(both.where(F.col("far") <= F.when(F.col("short"), LOOSE_SHORT).otherwise(most)), "near")

    def texts_of(asked: DataFrame) -> DataFrame:
        """(node, text) of rows (node)."""
        asked = materialise(asked.join(nodes.select("node", "first.k"), "node"), "asked")
        return join_counted(keyed.select("k", "text"), asked, ["k"]).groupBy("node").agg(F.first("text").alias("text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_alike(shingle_hashes(x.as_py(), words), shingle_hashes(y.as_py(), words), similarity) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            links = _compare(rows, words, similarity)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])

    # families: connected by candidates within the bits; whatever meets in any table and lies in two families is compared
    families = materialise(connected_components(near(materialise(wide_links(nodes), "candidates"), FAMILY).select("a", "b")), "families")
    grouped = materialise(nodes.join(families, "node", "left").select("node", "wide", "n", F.coalesce("root", "node").alias("root")), "grouped")
    pairs = near(materialise(wide_links(grouped.select("node", "wide", "root")), "candidates"), LOOSE)
    surely = (F.col("far") <= TIGHT) & ~F.col("short")
    doubtful = materialise(pairs.where(~surely).select("a", "b"), "doubtful")
    texts = materialise(texts_of(doubtful.select(F.col("a").alias("node")).unionByName(doubtful.select(F.col("b").alias("node"))).distinct()), "texts")
    full = hot_join(doubtful.withColumnRenamed("a", "node"), texts, "node", F.col("b")).select(F.col("node").alias("a"), F.col("b").alias("node"), F.col("text").alias("ta"))
    full = hot_join(full, texts, "node", F.col("a"), counted=doubtful.withColumnRenamed("b", "node")).select("a", F.col("node").alias("b"), "ta", F.col("text").alias("tb"))
    links = materialise(full.mapInArrow(verify, "a long, b long"), "sure").unionByName(pairs.where(surely).select("a", "b"))
    # within a family all are compared with all, block by block: a task holds two blocks and tells no more than links
    sizes = grouped.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialise(salted_join(grouped, sizes, "root", F.col("node")).select("node", "root", "wide", "n", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "members")
    members = members.join(texts_of(members.select("node")), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("task")
    members = members.select(task, "node", "block", F.when(F.col("block") == F.col("other"), 0).otherwise(1).alias("across"), "n", "wide", "text").repartition("task").sortWithinPartitions("task", "node")
    links = links.unionByName(materialise(members.mapInArrow(inside, "a long, b long"), "links"))
    roots = materialise(connected_components(links), "roots")
    grouped = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = grouped.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.k").alias("k"))
    repeats = own.groupBy("k").agg((F.count(F.lit(1)) > 1).alias("repeats"))
    mark, flag = "kept", "repeats"
    while {mark, flag} & set(cols):  # names that no column has
        mark, flag = mark + "_", flag + "_"
    kept = materialise(kept.join(repeats, "k").toDF(mark, flag), "kept")
    rows = join_counted(docs.withColumn(mark, key), kept, [mark])
    named = [F.col(f"`{c}`") for c in cols]
    if kept.where(F.col(flag)).isEmpty():
        return rows.select(*named)
    # only rows that repeat, id and text, are shuffled to leave one of them
    return rows.where(~F.col(flag)).select(*named).unionByName(rows.where(F.col(flag)).dropDuplicates([mark]).select(*named))
