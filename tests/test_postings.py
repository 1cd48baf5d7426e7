"""Compressed posting blocks: codec, skipping, size and plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import packed, postings, search, text_stats
from sparkloom.sources import tables


def test_integers_turn_back():
    r = random.Random(1)
    values = np.array([0, 1, 127, 128, 16383, 16384, (1 << 62) + 5] + [r.getrandbits(r.randint(1, 62)) for _ in range(500)])
    data, size = postings.pack_integers(values)
    assert (postings.unpack_integers(data) == values).all() and size[:6].tolist() == [1, 1, 1, 2, 2, 3]
    assert len(postings.unpack_integers(np.zeros(0, np.uint8))) == 0 and len(postings.pack_integers(values[:0])[0]) == 0


def test_blocks_turn_back(spark, monkeypatch):
    rows = [(t, d, 1 + d % 300) for t in ("a", "b") for d in range(0, 200_000, 7 if t == "a" else 991)] + [("c", 65_535, 5), ("c", 65_536, 1), ("d", 0, 1)]
    index = spark.createDataFrame(rows, "term string, doc_id long, tf long")
    blocks = postings.compress(index).cache()
    assert sorted(map(tuple, postings.decompress(blocks).collect())) == sorted(rows)
    assert blocks.agg(F.max("n")).first()[0] == postings.BLOCK_POSTINGS
    assert blocks.where("floor(first_doc / 65536) <> floor(last_doc / 65536)").count() == 0 and blocks.where("term = 'c'").count() == 2
    assert postings.compress(index.limit(0)).count() == 0 and postings.decompress(blocks.limit(0)).count() == 0


def test_only_blocks_that_can_meet_are_decoded(spark):
    """The frequent term has 800 blocks, the rare ones two postings each."""
    common = spark.range(100_000).select(F.lit("common").alias("term"), F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("tf"))
    rare = spark.createDataFrame([("rare", 5, 1), ("rare", 70_000, 2), ("other", 6, 1), ("other", 99_000, 1), ("late", 90_000, 1)], common.schema)
    blocks = postings.compress(common.unionByName(rare)).cache()
    decoded = lambda q: blocks.count() and postings.live_blocks(blocks, q).groupBy("term").count().rdd.collectAsMap()
    assert blocks.where("term = 'common'").count() >= 782
    assert decoded("common rare AND") == {"common": 2, "rare": 2}
    assert decoded("rare other AND") == {} and decoded("common nothing AND") == {} and decoded("rare late AND common OR")["common"] >= 782
    ids = lambda q: sorted(r.doc_id for r in postings.matches(blocks, q).collect())
    assert ids("common rare AND") == [5, 70_000] and ids("rare other OR late OR") == [5, 6, 70_000, 90_000, 99_000]
    assert ids("rare other AND") == [] and ids("nothing") == [] and ids("nothing late OR") == [90_000]


@pytest.mark.parametrize("seed", range(3))
def test_matches_are_those_of_the_plain_search(spark, monkeypatch, seed):
    monkeypatch.setattr(postings, "ZONE", 8)
    monkeypatch.setattr(postings, "BLOCK_POSTINGS", 3)
    r = random.Random(seed)
    docs = [(i, " ".join(w for w in "abcdef" if r.random() < {"a": 0.9, "b": 0.3, "c": 0.05}.get(w, 0.15) and (w != "f" or i > 150))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    blocks, index = postings.compress(search.index_long(df)).cache(), search.index_long(df).cache()
    for q in ("a b AND", "c d AND", "c d OR", "a c AND d f AND OR", "a b c AND AND", "f c AND b OR e AND"):
        want = sorted(x.doc_id for x in search.search(df, q, index).collect())
        assert sorted(x.doc_id for x in postings.matches(blocks, q).collect()) == want


def test_the_stored_index_is_smaller(spark, sf, tmp_path):
    docs = tables.load(spark, sf, "documents")
    postings.write_blocks(docs, str(tmp_path / "blocks"))
    tables.write_sorted(search.index_long(docs), str(tmp_path / "long"), "term")
    size = lambda d: sum(p.stat().st_size for p in (tmp_path / d).rglob("*.parquet"))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    data = blocks.agg(F.sum(F.octet_length("data"))).first()[0]
    assert data < 3 * blocks.agg(F.sum("n")).first()[0] and size("blocks") < 2 * size("long")


@pytest.mark.parametrize("query", [text_stats.bigram_relfreq_pairs, search.index_gaps])
def test_texts_are_cleaned_once(spark, sf, query):
    """Both sides of the join use one scan and one shuffle."""
    df = query(tables.load(spark, sf, "documents"))
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def odd_docs(spark):
    """Texts of odd letters and blanks, some null or empty, some under one number; numbers on both sides of ranges."""
    r = random.Random(3)
    docs = [(d, "".join(r.choice("abAé1 .\t\n\x0b'K-") for _ in range(r.randrange(80)))) for d in (r.choice((0, 65_530, 131_070)) + r.randrange(12) for _ in range(400))]
    return spark.createDataFrame([*docs, (7, None), (8, ""), (9, "end"), (65_535, "Start the"), (65_536, "the")], "doc_id long, text string").repartition(3)


def test_packed_postings_are_those_of_the_plain_index(spark, monkeypatch):
    """Pieces of the input are merged, also where a term and range come in many rows; the sizes are those of tiny pieces."""
    docs = odd_docs(spark)
    want = sorted(map(tuple, search.index_long(docs).collect()))
    for name, value in (("CHUNK", 64), ("PIECE", 200), ("MERGED", 5)):
        monkeypatch.setattr(packed, name, value)
    texts = docs.selectExpr("doc_id", "lower(text) as text").where("text is not null").toArrow().combine_chunks().to_batches()[0]
    bounds = np.frombuffer(texts.column(1).buffers()[1], np.int32)[: texts.num_rows + 1]
    data, size, of = packed.tokens_of(np.frombuffer(texts.column(1).buffers()[2], np.uint8), bounds[:-1].astype(np.int64))
    assert packed.packed(docs).count() > len(want) / 2  # most terms come in several rows
    got = np.split(data, np.cumsum(size)[:-1])
    assert sorted((texts.column(0)[i].as_py(), x.tobytes().decode()) for i, x in zip(of.tolist(), got, strict=True)) == sorted(map(tuple, docs.selectExpr("doc_id", "text").select("doc_id", F.explode(search.tokens("text"))).collect()))
    for deal in (packed.by_hash, packed.by_range):
        assert sorted(map(tuple, packed.long_rows(deal(packed.packed(docs))).collect())) == want
    lists = {(x.term, x.block): x for x in search.inverted_index(docs).collect()}
    assert sum(x.df for x in lists.values()) == len(want) and all(x.block == x.first_doc // 65_536 == x.last_doc // 65_536 for x in lists.values())
    assert sorted((t, *map(int, p.split(":"))) for (t, _), x in lists.items() for p in x.postings.split(",")) == want
    assert search.inverted_index(docs.limit(0)).count() == 0 and search.inverted_index(docs.where("text is null or text = ''")).count() == 0


@pytest.mark.parametrize("write", [postings.write_blocks, search.write_index])
def test_an_index_is_shuffled_packed(spark, tmp_path, write):
    """One shuffle of a row a term and piece of the input, not of a row a token or posting; files are sorted."""
    docs = spark.range(0, 4000, 1, 2).selectExpr("id as doc_id", "concat('the of and ', repeat('the ', 20), chr(97 + id % 3)) as text")
    assert packed.packed(docs).count() <= 2 * 6
    write(docs, str(tmp_path / "index"))
    got = spark.read.parquet(str(tmp_path / "index"))
    got = postings.decompress(got) if "data" in got.columns else got
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.index_long(docs).collect()))
