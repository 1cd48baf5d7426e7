"""Lines of text files keyed by file and byte offset, and a fetch that reads only the ranges asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.sources.shared import materialise

#: Bytes of a file whose hits one task fetches, and bytes that the table of splits may take to be broadcast.
RANGE, BROADCAST_BYTES = 64 << 20, 64 << 20
# fixed values: suffixes of files whose bytes aren't those of the lines
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")


def read_keyed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, value): every line, without its line feed, with the byte of its file at which it starts.

    Files are read in splits as by any scan.  A first pass adds up the bytes of each split's lines; a line's offset is the
    sum of the splits before it in its file and of the lines before it in its split, which the task that reads the split
    keeps.  Lines end with a line feed; a carriage return before it belongs to the line.  Offsets of a compressed file are
    those of its content.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = lines.groupBy("file", "split").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    splits = materialise(splits.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")), "splits")
    names = ["file", "split", "within", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        at = 0
        for b in batches:
            file, split = b.column(0).dictionary_encode(), np.asarray(b.column(1))
            code = np.asarray(file.indices)
            size = np.asarray(pc.binary_length(b.column(2))).astype(np.int64) + 1
            within = np.zeros(b.num_rows, np.int64)
            cuts = np.flatnonzero((np.diff(split) != 0) | (np.diff(code) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                key = (file.dictionary[int(code[lo])].as_py(), int(split[lo]))
                at = at if key == held else 0
                held = key
                ends = np.cumsum(size[lo:hi])
                within[lo:hi] = at + ends - size[lo:hi]
                at += int(ends[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(within), b.column(2)], names=names)

    rows = lines.mapInArrow(run, "file string, split long, within long, value binary")
    small = splits.count() * 256 <= BROADCAST_BYTES
    rows = rows.join(F.broadcast(splits) if small else splits, ["file", "split"])
    return rows.select("file", (F.col("base") + F.col("within")).alias("offset"), F.col("value").cast("string").alias("value"))


def fetch_lines(hits: DataFrame, most: int = 80) -> DataFrame:
    """(file, offset, snippet, read): the line at each hit (file, offset), cut to ``most`` characters and marked if it is
    longer, and the bytes read for it.

    Hits are dealt by ranges of their files, so that a file of many hits is fetched by many tasks; each reads no more than
    can decide the snippet, and nothing twice.  Files are opened by their URI in the tasks; of a store that only Spark
    reads, join the lines instead.  Compressed files have no ranges and are an error.
    """
    reach = 4 * (most + 1)  # bytes of the longest characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, start, data = None, None, 0, b""
        for b in batches:
            out, read = [], []
            for file, offset in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if file != name:
                    if file.lower().endswith(COMPRESSED):
                        raise ValueError(f"no ranges in a compressed file: {file}")
                    if stream is not None:
                        stream.close()
                    store, where = pafs.FileSystem.from_uri(file)
                    name, stream, start, data = file, store.open_input_file(where), 0, b""
                if start <= offset <= start + len(data):
                    data, start = data[offset - start :], offset
                else:
                    data, start = b"", offset
                before = len(data)
                if b"\n" not in data and len(data) < reach:
                    stream.seek(start + len(data))
                    data += stream.read(reach - len(data))
                line = data.split(b"\n", 1)[0].decode("utf-8", "replace")
                out.append(line[:most] + "..." if len(line) > most else line)
                read.append(len(data) - before)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(read, pa.int64())], names=["file", "offset", "snippet", "read"])
        if stream is not None:
            stream.close()

    dealt = hits.select("file", F.col("offset").cast("long").alias("offset")).withColumn("range", F.floor(F.col("offset") / RANGE))
    dealt = dealt.repartition("file", "range").sortWithinPartitions("file", "offset").select("file", "offset")
    return dealt.mapInArrow(run, "file string, offset long, snippet string, read long")
