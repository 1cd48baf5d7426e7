"""Fast similarity sketches, fill-in-the-middle and the filter audit against plain versions and odd rows."""

import random
import re
from collections import Counter
from hashlib import sha256
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import audit, chat, fastsketch, fim, html_text


def clash(df):
    """Further columns whose names the operators use inside."""
    for c in ("id", "k", "node", "key", "_salt", "root", "part", "mask", "digest", "least", "label", "output", "first", "short", "task"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# --- fast similarity sketches


def plain_sets(text, words=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set()


def plain_components(rows, similarity=85):
    sets, root = [plain_sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= similarity * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    out = Counter()
    for i, (doc, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if find(j) == find(i) and d is not None]
        least = (min(ids) if ids else None) if sets[i] else doc
        out[doc, len(sets[i]), least, doc == least] += 1
    return out


def edited(r, ws, share):
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in ws)


@pytest.mark.parametrize("block", [2048, 5])
def test_components_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(fastsketch, "BLOCK", block)
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(6):  # edits of every size about the bound, and chains that only neighbours link
        base = r.choices(vocab, k=r.choice((8, 40, 150, 600)))
        rows += [edited(r, base, r.choice((0, 0.01, 0.02, 0.03, 0.05))) for _ in range(12)]
    chain = r.choices(vocab, k=300)
    for _ in range(8):
        chain = chain[12:] + r.choices(vocab, k=12)
        rows.append(" ".join(chain))
    rows = [(i * 3 % 1009, t) for i, t in enumerate(rows)]
    rows += [(2000, None), (2001, ""), (2001, ""), (2002, " \t "), (2003, "One"), (2004, "one"), (2005, "one two"), (None, rows[0][1]), (None, "only null"), (None, None), (2006, "ÀÉ x"), (2007, "àé x"), (0, rows[0][1])]
    got = fastsketch.near_duplicates(clash(spark.createDataFrame(rows, "doc_id long, text string")))
    want = plain_components(rows)
    got = Counter(map(tuple, got.collect()))
    assert {k[:3] for k in got} == {k[:3] for k in want} and sum(got.values()) == len(rows)
    assert all(k[3] == (k[0] == k[2]) for k in got)


def test_a_family_of_look_alikes_under_the_bound_is_not_united(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, edited(r, base, 0.05)) for i in range(120)] + [(1000 + i, " ".join(base)) for i in range(300)]
    got = fastsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == plain_components(rows)


def test_sketches_estimate_similarity_and_fill_every_coordinate():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 60, 3000):
        agree = []
        for _ in range(60):
            h = r.integers(0, 1 << 63, n * 3, dtype=np.int64).astype(np.uint64)
            a, b = fastsketch.sketch(h[: 2 * n]), fastsketch.sketch(h[n:])  # a third of the union in common
            assert (a != fastsketch.FULL).all()
            agree.append((a == b).mean())
        assert abs(np.mean(agree) - 1 / 3) < 0.05
    bound = 0.85
    rows = fastsketch.band_rows(bound)
    assert (1 - bound**rows) ** (fastsketch.T // rows) <= fastsketch.MISS and fastsketch.least_agreements(bound) > 0.6 * fastsketch.T


def test_recall_at_the_bound():
    r = np.random.default_rng(4)
    rows, least, found, passed = fastsketch.band_rows(0.85), fastsketch.least_agreements(0.85), 0, 0
    for _ in range(600):
        h = r.integers(0, 1 << 63, 400, dtype=np.int64).astype(np.uint64)
        a, b = fastsketch.sketch(h[:370]), fastsketch.sketch(h[30:])  # 340 of 400
        same = (a == b)[: 128 // rows * rows].reshape(-1, rows)
        found += same.all(axis=1).any()
        passed += (a == b).sum() >= least
    assert found == 600 and passed == 600


def test_no_documents_to_sketch(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fastsketch.near_duplicates(clash(empty)).count() == 0
    words = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, fastsketch.near_duplicates(words).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


# --- fill in the middle


def plain_units(text, unit):
    if unit == "codepoint":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return re.findall(r"\A[\x20\t-\r]*[^\x20\t-\r]*[\x20\t-\r]*|[^\x20\t-\r]+[\x20\t-\r]*", text) if text else []


def plain_fim(doc, text, unit):
    text = text or ""
    digits = sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = [u for u in plain_units(text, unit) if u]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc, len(units), "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["codepoint", "word", "line"])
def test_fill_in_middle_is_the_plain_one_and_turns_back(spark, unit):
    r = random.Random(3)
    pool = ["a", "Z", " ", "\n", "\t", "é", "漢", "😀", "<", ">", "P", "<P", "word", "\x0b", "\x00", " "]
    rows = [(i, "".join(r.choices(pool, k=r.choice((0, 1, 2, 7, 60, 400))))) for i in range(300)]
    rows += [(5, rows[5][1])] * 3 + [(400, None), (401, ""), (402, "x<S>y"), (None, "no id"), (403, "<P><M>"), (404, "long é " * 50_000)]
    got = fim.transform(clash(spark.createDataFrame(rows, "doc_id long, text string")), unit).withColumn("back", fim.restored()).collect()
    assert Counter(tuple(x)[:6] for x in got) == Counter(plain_fim(i, t, unit) for i, t in rows)
    assert Counter((x.doc_id, x.back) for x in got) == Counter((i, t or "") for i, t in rows)
    assert {"plain", "psm", "spm"} <= {x.form for x in got}


def test_select_finds_every_mark():
    r = random.Random(8)
    for _ in range(300):
        lanes = [r.random() < 0.4 for _ in range(r.randint(1, 200))]
        marks = int.from_bytes(bytes(lanes), "little")
        at = [i for i, x in enumerate(lanes) if x]
        assert [fim.select(marks, k + 1, len(lanes)) for k in range(len(at))] == at
    with pytest.raises(ValueError):
        fim.boundaries(b"x", "page")


def test_no_documents_to_cut(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- filter audit


def plain_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    rows = []
    for doc, lang, text in docs:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": doc is not None and any((t or "") == text and d is not None and d < doc for d, _, t in docs),
        }
        rows.append((lang or "", {f for f in fails if fails[f]}, doc is not None and doc in good, doc is not None and doc in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            own, gone = list(left), []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left, gone = [r for r in left if f not in r[1]], gone + removed
                shapley[part, f] += len(removed)
                out[part, order, step] = (len(left), len(removed), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed))
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("parts", [256, 1])
def test_audit_is_that_of_applying_the_filters(spark, monkeypatch, parts):
    monkeypatch.setattr(audit, "PARTS", parts)
    r = random.Random(6)
    docs = []
    for i in range(150):
        n = r.choice((0, 3, 99, 100, 130))
        text = " ".join(r.choices([f"w{k}" for k in range(r.choice((40, 5000)))], k=n)) + r.choice(("", "", " #", " é", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3))
        docs.append((i, r.choice(("en", "de", "", None)), text))
    docs += [(200 + i, r.choice(("en", "de")), docs[i % 7][2]) for i in range(40)] + [(3, "en", docs[3][2]), (300, "en", None), (301, "fr", ""), (None, "en", docs[3][2]), (None, None, "x"), (302, "en", "A B\x1c" * 50)]
    labels = [(i, r.choice((0, 1, None)), r.choice((0, 1))) for i in range(0, 240, 2)] + [(4, 1, 0), (None, 1, 1), (9999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    for c in ("id", "part", "own", "digest", "least", "label", "mask"):
        d = d.withColumn(c, F.lit("clash"))
    got = audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("label", F.lit(1)))
    assert Counter(map(tuple, got.collect())) == Counter(plain_audit(docs, labels))


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, lang string, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    one = audit.audit(spark.createDataFrame([(1, "en", "x")], docs.schema), labels)
    assert one.count() == 600 and one.where("filter_order = 'ABCDE' and step = 1").first().removed == 1


# --- names of elements, null conversations


def test_compound_names_mark_only_with_words_of_the_frame():
    for name in ("ad-astra", "search-results", "related-work", "share-price", "social_history", "notice-period article", "menu-of-the-day"):
        for a in ("class", "id"):
            assert html_text._aside(f' {a}="{name}"') == (False, False), name
            assert html_text.main_text(f'<body><div {a}="{name}"><p>These words are the text.</p></div></body>') == "These words are the text."
    for name in ("ad", "story ad", "related-posts", "comment-list", "site-footer", "main-nav", "ad-slot-3", "cookie_banner", "sidebar-left", "share buttons"):
        assert html_text._aside(f' class="{name}"')[0], name
        assert html_text.main_text(f'<body><article><p>These words are the text.</p><div class="{name}">Others are not.</div></article></body>') == "These words are the text."
    assert html_text._aside(' class="site-header"') == (False, True) and html_text._aside(' class="header-image-of-it"') == (False, False)


def test_null_conversations_are_not_cut(spark):
    rows = [(None, 1, "assistant", "one two three four"), (None, 2, "user", None), (7, 1, "assistant", "one two three four")]
    got = chat.cut_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = [(i, s, t, r, x if s == "chosen" or i is None else "one two") for i, t, r, x in rows for s in ("chosen", "rejected")]
    assert Counter(map(tuple, got)) == Counter(want)
    assert {r.pair_id for r in chat.format_preferences(chat.cut_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()} == {7}


def test_sketching_leaves_no_spent_tables(spark, sf):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:").replace("//", "/"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = set(shared.iterdir()) if shared.exists() else set()
    assert fastsketch.near_duplicates(docs).count() == docs.count()
    assert not {p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before} & {"short", "stars", "near", "texts", "sets", "close", "grouped", "asked"}
