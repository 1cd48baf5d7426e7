"""Hierarchical multi-length packing.

Every task packs the documents that it reads, in blocks: each document gives whole long windows first; what is left of
it is routed to the shortest context tier that holds it.  The tiers are packed from long to short: a long window takes
the largest rest that fits, and a gap that no rest of its own tier fits is filled from the shorter tiers.  What is left
at the end of a task closes windows whose length is a power of two exactly, so no token of padding is needed.  Within a
tier, windows are dealt to step groups of equal token count, balanced by attention cost.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from sparkloom.llm.common import need

#: Text with any character but these (Latin letters and common signs whose lower case and normal form are plain), or
#: with the start of a special token, goes through the tokenizer itself; any other text is split by the pattern below.
BEYOND = re.compile(r"[^\x00-\x1b\x20-įı-ȹȻ-Ƚȿ-ɏ‐-‧‰-⁞₠-⃀]|<\|")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ʯ]+|[0-9²³¹¼½¾]|[^\s0-9a-zªµºß-öø-ʯ²³¹¼½¾]+")


class WordTokenizer:
    """Token ids of whole texts, equal to those of the tokenizer file without special tokens.

    The file's model splits texts into pieces, of which none holds white space, and merges bytes within a piece, so the
    ids of words and pieces can be kept; new pieces are merged by a byte-pair coder over the same merges, in which one byte that no UTF-8 text holds stands for the end
    of a word.  The number of kept pieces is bounded.  Texts beyond Latin letters and common signs, and files of any
    other make, go through the tokenizer unchanged.
    """

    KEPT = 250_000

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.coder = self._coder(path)

    def _coder(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or kinds != ["NFC", "Replace", "Lowercase"]:
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        end = b"\xff"
        ranks: dict[bytes, int] = {}
        vocab = model["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        for token, i in vocab.items():
            if token in special:
                continue
            word = token.removesuffix("</w>")
            ranks[bytes(chars[c] for c in word) + end * (word != token)] = i
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if any(vocab[a + b] - vocab[pairs[0][0] + pairs[0][1]] != n for n, (a, b) in enumerate(pairs)):
            return None  # ids don't follow the order of the merges
        # the end mark must be a token of its own for the coder; its id is never seen, as it merges with a byte first
        ranks[end] = max(vocab.values()) + 1
        return tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = array("I", self.coder.encode_single_piece(piece.encode() + b"\xff")).tobytes()
            if len(self.pieces) >= self.KEPT:
                self.pieces.clear()
            if len(piece) < 64:
                self.pieces[piece] = got
        return got

    def _word(self, word: str) -> bytes:
        got = b"".join([self._piece(p) for p in PIECES.findall(word)])
        if len(self.words) >= self.KEPT:
            self.words.clear()
        if len(word) < 64:
            self.words[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.coder is None or BEYOND.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        get, new = self.words.get, self._word
        return b"".join([get(w) or new(w) for w in text.lower().split()])


class Packer:
    """Packs the documents of one task; pieces are (document, start, length, sequence, offset)."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tuple(sorted(tiers))
        self.n = 0

    def windows(self, lengths: list[int]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(tier, pieces) of each window; a piece is (document, start, length).  Only the last ones may be short."""
        long = self.tiers[-1]
        rests: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}  # sorted (length, document, start)
        for d, n in enumerate(lengths):
            whole = n - n % long
            for s in range(0, whole, long):
                yield long, [(d, s, long)]
            if n > whole:
                rests[next(t for t in self.tiers if t >= n - whole)].append((n - whole, d, whole))
        for t in self.tiers:
            rests[t].sort()

        def take(room: int, most: int) -> tuple[int, int, int] | None:
            """The largest rest of at most ``room`` tokens in the tiers up to ``most``, longest tier first."""
            for t in reversed(self.tiers):
                if t <= most and (at := bisect_right(rests[t], (room, 1 << 62))):
                    return rests[t].pop(at - 1)
            return None

        for t in reversed(self.tiers):
            while rests[t]:
                n, d, s = rests[t].pop()
                pieces, room = [(d, s, n)], t - n
                while room and (got := take(room, t)):
                    pieces.append((got[1], got[2], got[0]))
                    room -= got[0]
                if room:  # no rest fits whole: cut the shortest longer one, so that the window is full
                    other = next((u for u in self.tiers if u <= t and rests[u]), None)
                    if other is not None:
                        n, d, s = rests[other].pop(0)
                        pieces.append((d, s, room))
                        back = n - room
                        insort(rests[next(u for u in self.tiers if u >= back)], (back, d, s + room))
                        room = 0
                if not room:
                    yield t, pieces
                else:
                    yield from self._close(pieces)

    @staticmethod
    def _close(pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """The last pieces, cut into windows of powers of two, longest first."""
        left = list(pieces)
        total = sum(p[2] for p in left)
        for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
            out, room = [], size
            while room:
                d, s, n = left.pop(0)
                out.append((d, s, min(n, room)))
                if n > room:
                    left.insert(0, (d, s + room, n - room))
                room -= min(n, room)
            yield size, out


def pack(
    docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = (256, 512, 1024, 2048), end_id: int = 1, step_tokens: int = 16_384, block_tokens: int = 1 << 20,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: (id_col, start, length, ids, doc_tokens, sequence_id, offset, tier, step_group).

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers; ``start`` counts the document's ids
    before it; sequences have ``tier`` tokens, all used.  ``step_group`` numbers sets of sequences with ``step_tokens``
    tokens each; the last of a block's groups may have fewer.  Each id of each document, and the end id after it, lies
    in exactly one piece.

    Ids are whole numbers.  Null and empty texts give the end id alone; rows that repeat are packed each; a null id stays null; an empty table
    gives no rows.  Sequence ids are those of the task that reads the rows and the place in it: a task that runs again
    on the same rows gives the same ids.  Memory: ``block_tokens`` and one document.
    """
    long = max(tiers)
    schema = pa.schema([
        ("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = WordTokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        task, packer = TaskContext.get().partitionId() << 40, Packer(tiers)
        sequence, group = task, task
        held: list[tuple[object, bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group, held, size
            windows = list(packer.windows([len(b) // 4 for _, b in held]))
            by_tier: dict[int, list[int]] = {}
            for i, (t, _) in enumerate(windows):
                by_tier.setdefault(t, []).append(i)
            groups: dict[int, int] = {}
            for t in sorted(by_tier, reverse=True):
                ranked = sorted(by_tier[t], key=lambda i: -sum(p[2] ** 2 for p in windows[i][1]))
                n = -(-len(ranked) * t // step_tokens)
                for place, i in enumerate(ranked):  # there and back, so that groups get like shares of costly windows
                    lap, at = divmod(place, n)
                    groups[i] = group + (at if lap % 2 == 0 else n - 1 - at)
                group += n
            cols: list[list] = [[] for _ in schema.names]
            for i, (t, pieces) in enumerate(windows):
                offset = 0
                for d, s, n in pieces:
                    for c, v in zip(cols, (held[d][0], s, n, held[d][1][4 * s : 4 * (s + n)], len(held[d][1]) // 4, sequence + i, offset, t, groups[i]), strict=True):
                        c.append(v)
                    offset += n
            sequence += len(windows)
            held, size = [], 0
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = tok.encode(t.as_py() or "") + end
                held.append((i, ids))
                size += len(ids) // 4
                if size >= block_tokens:
                    yield from flush()
        if held:
            yield from flush()

    assert step_tokens >= long
    out = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return need(docs, id_col, text_col).mapInArrow(run, out).withColumnRenamed("id", id_col)
