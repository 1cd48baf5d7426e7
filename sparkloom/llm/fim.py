"""Fill-in-the-middle by bit-parallel big integers.

A text is taken as its UTF-8 bytes.  ``bytes.translate`` turns it into class masks, whole numbers with one byte lane a
byte of text; shifted boolean operations mark the last byte of every unit; ``bit_count`` gives the number of units, and
halving the number again and again finds the byte of the k-th mark.  All of it is linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import need

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _lanes(members: set[int]) -> bytes:
    return bytes(b in members for b in range(256))


#: Class of each byte: goes on with a code point, is blank, ends a line.
CONTINUES, BLANK, BREAK = _lanes(set(range(0x80, 0xC0))), _lanes({32, *range(9, 14)}), _lanes({10})


def boundaries(data: bytes, unit: str = "codepoint") -> int:
    """A mark at the last byte of every unit, in byte lanes, the first byte lowest.

    Units are code points, words with the blanks after them (leading blanks belong to the first), or lines with their
    break; together they make up the whole text.
    """
    if not data:
        return 0
    ones = int.from_bytes(b"\x01" * len(data), "little")
    last = 1 << 8 * (len(data) - 1)
    if unit == "codepoint":
        return ones ^ int.from_bytes(data.translate(CONTINUES), "little") >> 8
    if unit == "word":
        blank = int.from_bytes(data.translate(BLANK), "little")
        starts = (ones ^ blank) & (blank << 8)  # the first byte of a word after a blank
        lead = starts & -starts if blank & 1 else 0  # the first word takes the leading blanks
        return (starts ^ lead) >> 8 | last
    if unit == "line":
        return int.from_bytes(data.translate(BREAK), "little") | last
    raise ValueError(f"unknown unit: {unit}")


def select(marks: int, rank: int, size: int) -> int:
    """The lane of the ``rank``-th mark (from 1) among ``size`` lanes, by halving."""
    at = 0
    while size > 1:
        half = size // 2
        low = marks & (1 << 8 * half) - 1
        n = low.bit_count()
        if rank <= n:
            marks, size = low, half
        else:
            marks, size, rank, at = marks >> 8 * half, size - half, rank - n, at + half
    return at


def split(data: bytes, unit: str, draw: tuple[int, int]) -> tuple[int, int, int, int, int]:
    """(units, prefix end, middle end in units, the same in bytes) by two draws modulo units + 1."""
    marks = boundaries(data, unit)
    n = marks.bit_count()
    lo, hi = sorted((draw[0] % (n + 1), draw[1] % (n + 1)))
    ends = [select(marks, k, len(data)) + 1 if k else 0 for k in (lo, hi)]
    return n, lo, hi, ends[0], ends[1]


def transform(docs: DataFrame, unit: str = "codepoint", seed: str = "1", plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n, form, prefix_units, middle_units, output): every row's whole text in fill-in-the-middle form.

    The first four groups of eight digits of sha256(``seed:id``) draw the two cuts and the form: ``plain`` (the text as
    it is) for empty texts, texts that hold a sentinel and draws from ``plain_from`` up, else ``spm`` (suffix, prefix,
    middle) for draws below ``spm_below``, else ``psm``.  Plain rows have no cuts (null).  Null texts are empty; a null id
    is written as nothing; repeated rows stay; an empty table gives an empty result; ids may be of any type with one text
    form.
    """
    sentinels = tuple(s.encode() for s in (PREFIX, SUFFIX, MIDDLE))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for key, text in zip(b.column(1), b.column(2), strict=True):
                data = (text.as_py() or "").encode()
                digits = sha256(f"{seed}:{key.as_py() or ''}".encode()).hexdigest()
                h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
                n, lo, hi, cut, end = split(data, unit, (h1, h2))
                if not data or any(s in data for s in sentinels) or h3 % 100 >= plain_from:
                    rows.append((n, "plain", None, None, data))
                    continue
                p, s, m = sentinels
                prefix, middle, suffix = data[:cut], data[cut:end], data[end:]
                form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < spm_below else ("psm", (p, prefix, s, suffix, m, middle))
                rows.append((n, form, lo, hi - lo, b"".join(parts)))
            n, forms, lo, mid, out = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(lo, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "form", "prefix_units", "middle_units", "output"])

    rows = need(docs, id_col, text_col).toDF("id", "text")
    got = rows.select("id", F.col("id").cast("string").alias("key"), "text").mapInArrow(run, f"id {kind}, n long, form string, prefix_units long, middle_units long, output string")
    return got.withColumnRenamed("id", id_col)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output and its form were made of."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(F.substring(output, len(PREFIX) + 1, 1 << 30), "|".join((PREFIX, SUFFIX, MIDDLE)))
    psm, spm = F.concat(parts[0], parts[2], parts[1]), F.concat(parts[1], parts[2], parts[0])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
