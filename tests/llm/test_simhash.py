"""SimHash against a plain version, in ties, groups and odd rows."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import simhash


def plain(text, words):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").translate({9: " ", 10: " ", 12: " ", 13: " "}).split(" ")
    ws = [w for w in ws if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + words]) for i in range(len(ws) - words + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def shingle_set(text, words):
    ws = text.lower().split()
    return {tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set()


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_is_the_plain_one_and_sparks_hash():
    r = random.Random(1)
    for text in ["", " \n", "One", "a b c d", "É é ß Ünï x", *(" ".join(r.choices("ab Cd eF gh ij k".split(), k=n)) for n in (3, 4, 5, 40, 400))]:
        assert simhash.fingerprint(text, 4) == plain(text, 4)


def test_long_texts_cross_the_inner_blocks():
    text = " ".join(random.Random(2).choices([f"w{i}" for i in range(500)], k=70_000))
    assert simhash.fingerprint(text, 4) == plain(text, 4)


@pytest.mark.parametrize("group_rows", [200_000, 20])
def test_links_are_those_of_all_pairs(spark, monkeypatch, group_rows):
    """Also with groups so small that more leading bits divide them, and with variants taken in turns."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(simhash, "CHUNK", 4000 if group_rows == 20 else 1 << 21)
    r = random.Random(3)
    fps = []
    for _ in range(40):
        f = r.getrandbits(64)
        for _ in range(r.choice((1, 1, 3, 12))):
            for _ in range(r.randint(0, 5)):
                f ^= 1 << r.randrange(64)
            fps.append(f)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from sparkloom.operators.joins import connected_components

    got = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(simhash.ball_links(df)).collect()}
    want = components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    mine = components(len(fps), lambda i, j: got.get(fps[i], fps[i]) == got.get(fps[j], fps[j]))
    assert mine == want


def odd_rows(spark):
    text = "some plain words that make a text of fair length for this test to use here"
    rows = [(1, text, 9), (2, text.upper(), 9), (3, None, 9), (4, "", 9), (5, " \n", 9), (5, " \n", 9), (None, text, 9), (7, "x " * 50_000, 9), (8, "quite other words stand in this one and nothing else is like it", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("id", F.lit("clash")).withColumn("component_id", F.lit(0)).withColumn("node", F.lit(1))


def test_odd_rows(spark):
    got = simhash.near_duplicates(odd_rows(spark), words=4).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.component_id)
    assert len(got) == 9 and by[1] == by[2] == by[None] == [1] and by[3] == by[4] == [3] and by[5] == [3, 3] and by[7] == [7] and by[8] == [8]
    assert simhash.near_duplicates(odd_rows(spark).limit(0)).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark):
    r = random.Random(5)
    vocabulary = [f"word{i}" for i in range(3000)]
    base = [r.choices(vocabulary, k=200) for _ in range(60)]
    rows = [(i, " ".join(ws)) for i, ws in enumerate(base)]
    for i, ws in enumerate(base[:30]):  # three changed words of 200: similarity about 0.86
        near = list(ws)
        for at in (40, 100, 160):
            near[at] = "changed"
        rows.append((100 + i, " ".join(near)))
    for i, ws in enumerate(base[30:50]):  # a third of the words changed at random: similarity far below 0.8
        rows.append((200 + i, " ".join(w if r.random() < 0.67 else r.choice(vocabulary) for w in ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("hash", "root", "k", "kept", "repeats", "kept_", "node", "_hash_"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    assert {x.doc_id for x in got.collect()} == set(range(60)) | set(range(200, 220)) and {x._hash_ for x in got.collect()} == {"own _hash_"}


def test_deduplicate_odd_rows(spark):
    got = simhash.deduplicate(odd_rows(spark))
    ids = sorted((x.doc_id is None, x.doc_id or 0) for x in got.collect())
    assert ids == [(False, 3), (False, 7), (False, 8), (True, 0)]
    assert simhash.deduplicate(odd_rows(spark).limit(0)).count() == 0


def test_candidates_are_all_pairs_that_share_a_variant(spark, monkeypatch):
    """Also with groups divided by more leading bits, with pieces of a few rows, and in turns."""
    r = np.random.default_rng(1)
    wide = r.integers(0, 1 << 63, (120, simhash.WIDE_WORDS), dtype=np.uint64)
    for i in range(30, 120):  # thirty single ones, a family of sixty, thirty copies of one or two
        wide[i] = wide[0 if i < 90 else i % 7]
        for _ in range(r.integers(0, 60)):
            wide[i, r.integers(0, simhash.WIDE_WORDS)] ^= np.uint64(1 << int(r.integers(0, 63)))
    node = np.unique(r.integers(-(1 << 62), 1 << 62, 120))
    df = spark.createDataFrame([(int(n), [int(x) for x in w.view(np.int64)]) for n, w in zip(node, wide, strict=True)], "node long, wide array<long>")
    values = np.stack([wide[:, t // 2] >> np.uint64(32 * (t % 2)) & np.uint64(0xFFFFFFFF) for t in range(simhash.TABLES)], axis=1)
    want = set()
    for i in range(120):
        for j in range(i):
            if np.bitwise_count(values[i] ^ values[j]).min() <= simhash.TABLE_RADIUS and int(wide[i, -1] ^ wide[j, -1]).bit_count() <= simhash.CHECK_BITS:
                want.add((min(node[i], node[j]), max(node[i], node[j])))
    for rows, gather, chunk in ((100_000, 200_000, 1 << 21), (10, 50, 1 << 9)):
        monkeypatch.setattr(simhash, "TABLE_ROWS", rows)
        monkeypatch.setattr(simhash, "GATHER", gather)
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        own = df.withColumn("root", F.col("node"))
        assert {tuple(x) for x in simhash.wide_links(own).collect()} == want
        few = {tuple(x) for x in simhash.wide_links(df).collect()}
        assert len(want) > 1000 and few <= want and 100 < len(few) < 60 * simhash.STAR_TABLES * 2


@pytest.mark.parametrize("block", [512, 4])
def test_deduplicate_dense_clusters(spark, monkeypatch, block):
    """Clusters of texts of one base with up to five words changed each: the same rows stay as by brute force."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    for seed in (1,):
        r = random.Random(seed)
        vocabulary = [f"word{i}" for i in range(3000)]
        rows = []
        for _ in range(25):
            base = r.choices(vocabulary, k=200)
            for _ in range(10):
                ws = list(base)
                for at in r.sample(range(200), r.randint(0, 5)):
                    ws[at] = f"new{r.getrandbits(40)}"
                rows.append((len(rows), " ".join(ws)))
        sets = [shingle_set(t, 5) for _, t in rows]
        root = components(len(rows), lambda i, j: (both := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - both))
        got = {x.doc_id for x in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert set(root) <= got and len(got - set(root)) <= 1 and len(set(root)) < 120


def test_deduplicate_finds_pairs_by_similarity(spark):
    """Recall of pairs at and above the limit; none below it goes."""
    r = random.Random(21)
    vocabulary = [f"word{i}" for i in range(5000)]
    rows, pairs, n = [], [], 150
    for changes in (5, 6, 7, 8, 9, 10, 11, 13):  # of 400 words: similarity from 0.88 to 0.72
        for _ in range(n):
            base = r.choices(vocabulary, k=400)
            other = edited(base, r, changes)
            p, q = (shingle_set(" ".join(x), 5) for x in (base, other))
            pairs.append((len(rows), len(p & q) / len(p | q)))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    got = {x.doc_id for x in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = lambda lo, hi: [i + 1 not in got for i, s in pairs if lo <= s < hi]
    assert np.mean(gone(0.8, 0.82)) > 0.95 and np.mean(gone(0.82, 0.85)) > 0.98 and np.mean(gone(0.85, 1)) > 0.99 and not any(gone(0, 0.8))
    assert all(i in got for i, _ in pairs)


def edited(words, r, changes):
    """The words with so many of them changed, five or more apart, so that each change is five shingles."""
    out = list(words)
    for at in r.sample(range(2, len(words) // 5 - 1), changes):
        out[5 * at] = f"new{r.getrandbits(40)}"
    return out


def test_deduplicate_pairs_in_a_family_of_look_alikes(spark):
    """Each text is some 0.7 like all others (below the limit) and 0.85 like one."""
    r = random.Random(11)
    template = r.choices([f"word{i}" for i in range(3000)], k=500)
    base = [edited(template, r, 10) for _ in range(120)]
    rows = [(i, " ".join(ws)) for i, ws in enumerate(base)] + [(1000 + i, " ".join(edited(ws, r, 7))) for i, ws in enumerate(base)]
    sets = [shingle_set(t, 5) for _, t in rows]
    root = components(len(rows), lambda i, j: (both := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - both))
    want = {rows[i][0] for i in root}
    assert want == set(range(120))
    got = {x.doc_id for x in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got and len(got - want) <= 1  # a pair at 0.85 meets in a table with a chance of 99.7 %


def test_deduplicate_tries_further_pairs_of_two_groups(spark):
    """Two groups of close copies whose nearest pair by bits is below the limit, while others are above it."""
    vocabulary = [f"word{i}" for i in range(3000)]
    for seed in range(200):
        r = random.Random(seed)
        base = r.choices(vocabulary, k=500)
        texts = [[" ".join(edited(ws, r, r.randint(0, 2))) for _ in range(8)] for ws in (base, edited(base, r, 10))]
        sets = [[shingle_set(t, 5) for t in side] for side in texts]
        bits = [[simhash.wide_fingerprint(simhash.shingle_hashes(t, 5)) for t in side] for side in texts]
        pairs = []
        for p, v in zip(sets[0], bits[0], strict=True):
            for q, w in zip(sets[1], bits[1], strict=True):
                pairs.append((int(np.bitwise_count(v ^ w).sum()), len(p & q) / len(p | q)))
        held = [b for b, s in pairs if s >= 0.8]
        if 0 < len(held) < 12 and min(pairs)[1] < 0.8 and sum(b <= simhash.LOOSE - 30 for b in held) >= 2:
            break
    else:
        raise AssertionError("no such groups were made")
    docs = spark.createDataFrame(list(enumerate(texts[0] + texts[1])), "doc_id long, text string")
    assert [x.doc_id for x in simhash.deduplicate(docs).collect()] == [0]
