"""Lines by offset, positioned fetches, tables of cells."""

import gzip
import random
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import lines
from sparkloom.sources.keyed import KeyedTable


def _collection(folder):
    """{(file name, offset): line} of some files: long and empty lines, wide characters, carriage returns, no last break."""
    r, want = random.Random(4), {}
    folder.mkdir()
    for k, end in enumerate((b"\n", b"", b"\n\n", b"x")):
        at, parts = 0, []
        for _ in range(200):
            line = "".join(r.choices("ab é漢😀\t\r", k=r.choice((0, 1, 7, 79, 80, 81, 300)))).encode()
            want[f"f {k}.txt", at] = line
            parts.append(line)
            at += len(line) + 1
        if end == b"":
            if not parts[-1]:  # no bytes, no line
                del want[f"f {k}.txt", at - 1]
            (folder / f"f {k}.txt").write_bytes(b"\n".join(parts))
            continue
        (folder / f"f {k}.txt").write_bytes(b"\n".join(parts) + (b"\n" + end if end != b"\n" else b"\n"))
        if end == b"\n\n":
            want[f"f {k}.txt", at] = want[f"f {k}.txt", at + 1] = b""
        elif end == b"x":
            want[f"f {k}.txt", at] = b"x"
    return want


def _name(uri):
    return unquote(urlparse(uri).path).rsplit("/", 1)[1]


@pytest.mark.parametrize("split_bytes", ["128m", "700"])
def test_offsets_hold_under_split_reads(spark, tmp_path, split_bytes):
    want = _collection(tmp_path / "c")
    settings = {"spark.sql.files.maxPartitionBytes": split_bytes, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = lines.read_keyed_lines(spark, str(tmp_path / "c"))
        if split_bytes == "700":
            assert rows.rdd.getNumPartitions() > 20
        assert {(_name(r.file), r.offset): r.value.encode() for r in rows.collect()} == want and rows.count() == len(want)
        got = lines.fetch_lines(rows.where("offset % 3 = 0")).collect()
        short = {k: v.decode() for k, v in want.items()}
        assert {(_name(r.file), r.offset): r.snippet for r in got} == {k: v[:80] + "..." if len(v) > 80 else v for k, v in short.items() if k[1] % 3 == 0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_only_hit_ranges_are_read(spark, tmp_path):
    """A large file: three hits read three short ranges, and what lies between may be anything."""
    rows = [f"line {i} ".encode() * 20 for i in range(20_000)]
    path = tmp_path / "large.txt"
    path.write_bytes(b"\n".join(rows) + b"\n")
    at = [sum(len(r) + 1 for r in rows[:i]) for i in (0, 7_000, 19_999)]
    data = bytearray(b"?" * path.stat().st_size)
    for a in at:
        data[a : a + 400] = path.read_bytes()[a : a + 400]
    path.write_bytes(data)
    hits = spark.createDataFrame([(path.as_uri(), a) for a in at], "file string, offset long")
    got = lines.fetch_lines(hits).collect()
    assert sorted(r.snippet[:11] for r in got) == ["line 0 line", "line 19999 ", "line 7000 l"]
    assert sum(r.read for r in got) <= 3 * 4 * 81 < path.stat().st_size / 1000
    assert lines.fetch_lines(hits.limit(0)).count() == 0


def test_no_fetch_from_compressed_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.txt.gz", "wb") as f:
        f.write(b"one\ntwo\n")
    rows = lines.read_keyed_lines(spark, str(tmp_path / "a.txt.gz"))
    assert sorted((r.offset, r.value) for r in rows.collect()) == [(0, "one"), (4, "two")]
    with pytest.raises(Exception, match="compressed"):
        lines.fetch_lines(rows).collect()


def _scanned(df):
    """Rows that leave the scan: those of the row groups read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))


def test_puts_replace_cells_and_gets_read_little(spark, tmp_path):
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", buckets=4, row_group_bytes=4096)
    assert table.cells().count() == 0 and table.get("a").count() == 0
    rows = spark.range(20_000).select(F.format_string("key%06d", F.col("id") * 2).alias("key"), F.lit("c:n").alias("qualifier"), F.col("id").alias("value"))
    table.put(rows)
    clash = spark.createDataFrame([("key000004", "c:n", -1), ("key000004", "c:m", 5), ("new", "c:n", 1), ("new", "c:n", 7), (None, "c:n", 3)], "key string, qualifier string, value long")
    before = set(table._manifest()[1]["folders"].items())
    table.put(clash)
    got = {(r.key, r.qualifier): r.value for r in table.get("key000004", "new", "key000006", "none").collect()}
    assert got == {("key000004", "c:n"): -1, ("key000004", "c:m"): 5, ("new", "c:n"): 7, ("key000006", "c:n"): 3}
    assert table.cells().count() == 20_002
    touched = {r[0] for r in clash.where("key is not null").select(F.pmod(F.xxhash64("key"), F.lit(4))).distinct().collect()}
    assert len(before & set(table._manifest()[1]["folders"].items())) == 4 - len(touched)
    # one bucket of four is opened, one row group of it read; a key between others that isn't there reads none
    assert 0 < _scanned(table.get("key020000")) < 20_000 / 4 / 4
    assert _scanned(table.get("key020001")) == 0
    table.put(clash.limit(0))
    assert table._manifest()[0] == 2
    table.put(clash.limit(1))
    assert sorted(table.folder.names("manifests")) == ["000002.json", "000003.json"] and table.cells().count() == 20_002


def test_a_put_at_the_same_time_fails_whole(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    one, two = KeyedTable.create(spark, path, buckets=2), KeyedTable(spark, path)
    cells = spark.createDataFrame([("a", "q", 1)], "key string, qualifier string, value long")
    seen = two._manifest()
    one.put(cells)
    monkeypatch.setattr(two, "_manifest", lambda: seen)
    with pytest.raises(FileExistsError):
        two.put(cells.withColumn("value", F.lit(9)))
    assert [r.value for r in KeyedTable(spark, path).cells().collect()] == [1]
    assert KeyedTable.create(spark, path).cells().count() == 0
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "file").write_text("x")
    with pytest.raises(FileExistsError):
        KeyedTable.create(spark, f"file://{tmp_path}/own")
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, f"file://{tmp_path}/none").cells()
