"""MinHash near-duplicates by fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017).

A set's sketch has T coordinates.  In round i every element is hashed to one coordinate and a value, and a coordinate
keeps the smallest (round, value) that it is offered; in T further rounds every element goes to one coordinate, so that
each is filled.  Two sketches agree in a coordinate with the chance of the sets' Jaccard similarity, and the number of
agreements is as concentrated as that of independent draws, at the cost of a few rounds in place of T.

Bands of coordinates find candidates; every link is confirmed on the full sets.  A group of sets that share a band is
first tied to one of its sets.  Groups that then still hold sets of several components are gone through in blocks: those
of different components are compared by sketch, and where the sketches are near the full sets are compared within the task,
unless links connect the two by then.  So no pair above the bound that shares a band goes unseen, a task tells no more than
a link a set, and the rows told stay linear in groups of any size; comparisons grow with the square of the look-alikes
of a group that nothing links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import connected_components, hot_join, join_counted, materialise, need, salted_join
from sparkloom.llm.winnow import grams
from sparkloom.sources.shared import discard

#: Coordinates, a power of two, and the bits of a coordinate's number.
T, T_BITS = 128, 7
#: Chance that a pair at the bound shares no band, or agrees in fewer coordinates than asked for.
MISS = 1e-6
#: Sets, and shingles, that a task compares with one another, or with as many others.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
FULL = np.uint64((1 << 64) - 1)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


SEEDS = _finish(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Different hashes of a whole text's word shingles; of fewer words the whole sequence; none: empty."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    number = {w: xxhash.xxh64_intdigest(w, 0) for w in dict.fromkeys(ws)}
    return np.unique(grams(np.fromiter(map(number.__getitem__, ws), np.uint64, len(ws)), min(words, len(ws))))


def sketch(h: np.ndarray) -> np.ndarray:
    """T coordinates of a set that isn't empty: round in the upper eight bits, value below."""
    out = np.full(T, FULL)
    done = 0
    while done < T and (out == FULL).any():
        rounds = min(T - done, max(1, 4 * T // len(h)))
        x = _finish(h[None, :] ^ SEEDS[done : done + rounds, None])
        value = np.arange(done, done + rounds, dtype=np.uint64)[:, None] << np.uint64(56) | (x & np.uint64((1 << 57) - 1)) >> np.uint64(1)
        np.minimum.at(out, (x >> np.uint64(64 - T_BITS)).astype(np.int64).ravel(), value.ravel())
        done += rounds
    for j in np.flatnonzero(out == FULL).tolist():
        out[j] = np.uint64(T + j << 56) | _finish(h ^ SEEDS[T + j]).min() >> np.uint64(8)
    return out


def band_rows(similarity: float) -> int:
    """The most coordinates a band may have for a pair at the bound to share one."""
    return max([r for r in range(1, T + 1) if (1 - similarity**r) ** (T // r) <= MISS], default=1)


def least_agreements(similarity: float) -> int:
    """Agreeing coordinates that a pair at the bound falls short of with a chance of MISS at most."""
    below, k = 0.0, 0
    while k < T and below + (p := comb(T, k) * similarity**k * (1 - similarity) ** (T - k)) <= MISS:
        below, k = below + p, k + 1
    return k


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(id, k, node, n, sketch) of rows (id, k, text): node is a hash of the set, n its size, sketch a byte a coordinate
    and then the keys of the bands' coordinates; both are null for an empty set."""
    names = ["id", "k", "node", "n", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, own = [], [], []
            for text in b.column(2):
                h = shingles(text.as_py(), words)
                n.append(len(h))
                node.append(xxhash.xxh64_intdigest(h.tobytes(), 1) - (1 << 63) if len(h) else None)
                own.append(_finish(sketch(h)).astype("<u8").tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(own, pa.binary())], names=names)

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, k long, node long, n long, sketch binary")


def _bands(nodes: DataFrame, rows: int) -> DataFrame:
    """(key, band, node, ...): every set once a band, with the further columns but the sketch."""
    rest = [c for c in nodes.columns if c not in ("node", "sketch")]
    kinds = "".join(f", {c} {nodes.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            wide = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u8").reshape(-1, T)
            for band in range(T // rows):
                key = np.full(len(wide), SEEDS[band])
                for j in range(band * rows, (band + 1) * rows):
                    key = _finish(key ^ wide[:, j])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array([band] * len(wide), pa.int32()), b.column(0), *b.columns[2:]], names=["key", "band", "node", *rest])

    return nodes.select("node", "sketch", *rest).mapInArrow(run, f"key long, band int, node long{kinds}")


def _short(own: DataFrame) -> DataFrame:
    """A byte a coordinate in place of eight: enough to count agreements, a chance one in 256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, T, 8)
            rows = [r.tobytes() for r in np.ascontiguousarray(wide[:, :, 0])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["node", "short"])

    return own.select("node", "sketch").mapInArrow(run, "node long, short binary")


def _near(rows: pa.Table, least: int, per_band: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of one block, or of two blocks between them, of different roots and at least ``least`` agreements: a row with
    others.  A pair is seen in the first band that it shares only."""
    root, block = np.asarray(rows["root"]), np.asarray(rows["block"])
    across, earlier = bool(rows["across"][0].as_py()), rows["band"][0].as_py()
    _, group, size = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((group, size[group]))  # the largest component comes last and is never compared with itself
    block, group = block[order], group[order]
    wide = np.frombuffer(b"".join(rows["short"].to_pylist()), np.uint8).reshape(-1, T)[order]
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    lo = 0
    for hi in ends.tolist():
        for i in range(lo, hi):
            same = wide[hi:] == wide[i]
            near = same.sum(axis=1) >= least
            if across:
                near &= block[hi:] != block[i]
            j = np.flatnonzero(near)
            j = j[~same[j, : earlier * per_band].reshape(len(j), earlier, per_band).all(axis=2).any(axis=1)]
            if len(j):
                yield int(order[i]), order[j + hi]
        lo = hi


def _links(rows: pa.Table, least: int, per_band: int, similarity: int) -> list[tuple[int, int]]:
    """Links among the full sets of near rows that connect just the alike ones, no more than one a row."""
    node, parent = np.asarray(rows["node"]), np.unique(np.asarray(rows["root"]), return_inverse=True)[1]
    sets = [np.frombuffer(x, "<u8") for x in rows["hashes"].to_pylist()]
    sizes = np.array([len(x) for x in sets])
    numbers = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    has = np.zeros(int(sizes.sum()), bool)
    tree, out = list(range(len(node))), []

    def find(x: int) -> int:
        while tree[x] != x:
            tree[x] = x = tree[tree[x]]
        return x

    for i, others in _near(rows, least, per_band):
        own = find(parent[i])
        others = [j for j in others.tolist() if find(parent[j]) != own]
        has[numbers[i]] = True
        for j in others:
            a, b = find(parent[i]), find(parent[j])
            if a != b:
                both = int(np.count_nonzero(has[numbers[j]]))
                if 100 * both >= similarity * (sizes[i] + sizes[j] - both):
                    tree[max(a, b)] = min(a, b)
                    out.append((int(node[i]), int(node[j])))
        has[numbers[i]] = False
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in whole groups of the first column."""
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


def near_duplicates(docs: DataFrame, words: int = 3, similarity: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row per row of ``docs``.

    Two texts are linked if 100 times the shingles that they share are ``similarity`` times those of either or more;
    component_id is the smallest id reachable over links, kept says whether it is the row's own.  Texts without words, and
    null ones, have no shingles and are linked with nothing.  Rows that repeat stay, each with the same result.  Ids are
    whole numbers; a null id takes part, but is a component_id only where all ids of the component are null (it is kept
    there).  An empty table gives an empty result; a pair at the bound is missed with a chance of MISS for sharing no
    band, pairs further in with less.  Sets are told apart by 64-bit hashes.
    """
    bound = similarity / 100
    rows, least = band_rows(bound), least_agreements(bound)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = need(docs, id_col, text_col).toDF("id", "text").select("id", F.xxhash64("id", text).alias("k"), text.alias("text"))
    spent: list[DataFrame] = []  # written tables that the result doesn't read

    def step(df: DataFrame, name: str) -> DataFrame:
        spent.append(materialise(df, name))
        return spent[-1]

    own = materialise(sketches(keyed, words), "sketches")
    nodes = own.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id", "k")).alias("first"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    nodes = materialise(nodes, "nodes")
    short = step(_short(nodes), "short")

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that agree in enough coordinates."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, T) for i in (2, 3))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

        one = salted_join(pairs.withColumnRenamed("a", "node"), short, "node", F.col("b")).select(F.col("node").alias("a"), F.col("b").alias("node"), F.col("short").alias("x"))
        both = salted_join(one, short, "node", F.col("a")).select("a", F.col("node").alias("b"), "x", F.col("short").alias("y"))
        return both.mapInArrow(run, "a long, b long")

    def texts_of(asked: DataFrame) -> DataFrame:
        """(node, text) of rows (node)."""
        asked = step(asked.join(nodes.select("node", "first.k"), "node"), "asked")
        return join_counted(keyed.select("k", "text"), asked, ["k"]).groupBy("node").agg(F.first("text").alias("text"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, before, first = [], None, None
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x = x.as_py()
                if x != before:
                    before, first = x, shingles(x, words)
                second = shingles(y.as_py(), words)
                both = len(np.intersect1d(first, second, assume_unique=True))
                keep.append(100 * both >= similarity * (len(first) + len(second) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are alike."""
        texts = step(texts_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()), "texts")
        full = hot_join(pairs.withColumnRenamed("a", "node"), texts, "node", F.col("b")).select(F.col("node").alias("a"), F.col("b").alias("node"), F.col("text").alias("x"))
        full = hot_join(full, texts, "node", F.col("a"), counted=pairs.withColumnRenamed("b", "node")).select("a", F.col("node").alias("b"), "x", F.col("text").alias("y"))
        return step(full.mapInArrow(confirm, "a long, b long"), "links")

    # each set of a group with the smallest one of the group
    bands = _bands(nodes.select("node", "sketch"), rows)
    lead = bands.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").select("key", "a")
    stars = salted_join(bands, lead, "key", F.col("node")).where("a <> node").select("a", F.col("node").alias("b")).distinct()
    links = linked(step(near(step(stars, "stars")), "near"))
    # what shares a group and lies in different components yet: near ones first by sketch, then by the full sets
    roots = connected_components(links)
    grouped = step(nodes.join(roots, "node", "left").select("node", "n", "sketch", F.coalesce("root", "node").alias("root")), "grouped")
    bands = _bands(grouped, rows)
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    mixed = bands.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), blocks.alias("blocks")).where("lo < hi").select("key", "blocks")
    members = salted_join(bands, mixed, "key", F.col("node")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = salted_join(members, short, "node", F.col("key")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("task")
    members = members.select(task, "node", "root", "block", F.when(F.col("block") == F.col("other"), 0).otherwise(1).alias("across"), "band", "short")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            seen = np.zeros(group.num_rows, bool)
            for i, others in _near(group, least, rows):
                seen[i] = seen[others] = True
            yield from group.filter(pa.array(seen)).to_batches()

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            got = _links(group, least, rows, similarity)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], names=["a", "b"])

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words).tobytes() for t in b.column(1)], pa.binary())], names=["node", "hashes"])

    kinds = "task long, node long, root long, block int, across int, band int, short binary"
    close = step(members.repartition("task").sortWithinPartitions("task").mapInArrow(between, kinds), "close")
    if not close.isEmpty():
        sets = step(texts_of(close.select("node").distinct()).mapInArrow(whole_sets, "node long, hashes binary"), "sets")
        tied = close.join(sets, "node").select(*close.columns, "hashes").repartition("task").sortWithinPartitions("task")
        links = links.unionByName(step(tied.mapInArrow(inside, "a long, b long"), "tied"))
        roots = connected_components(links)
    roots = materialise(roots, "roots")
    discard(*spent)
    whole = nodes.join(roots, "node", "left").select("node", "first.id", F.coalesce("root", "node").alias("root"))
    component = whole.groupBy("root").agg(F.min("id").alias("component"))
    by_node = salted_join(whole.select("node", "root"), component, "root", F.col("node")).select("node", "component")
    full = own.where("node is not null").select("id", "node", "n")
    got = salted_join(full, by_node, "node", F.col("id")).select("id", "n", "component").unionByName(own.where("node is null").select("id", "n", F.col("id").alias("component")))
    return got.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
