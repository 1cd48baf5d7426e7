"""Secret scans: three base patterns, and a character convolutional network over every other candidate.

A candidate is a run of key characters that doesn't read as plain words and numbers, whether it has a digit or not; of a
run that the base patterns took a part of, what is left to either side.  The network reads the candidate and the text around
it, a longer candidate in overlapping windows of which the largest score counts; it is trained here, by tasks, on all findings of the table, labelled by the base patterns, and on made-up keys and
look-alikes.  A held-out part calibrates its scores (Platt) and sets the threshold: the highest that keeps the asked
recall.  Its findings are added; the base patterns' findings stay as they are.
"""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import hash_bound, need
from sparkloom.sources.shared import discard, materialise

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[A-Za-z]")
RUN = re.compile(r"[A-Za-z0-9+/_=.@-]{10,}")
# words in lower case, capitalised or in upper case, and numbers, joined by any signs
PLAIN = re.compile(r"(?:[+/_=.@-]+|(?:[A-Z]?[a-z]{1,24}|[A-Z]{1,24}|[0-9]+)(?![A-Za-z0-9]))*+")
PART = re.compile(r"[^/=.]+")
KINDS = ("assign", "access", "hex", "learned")
#: Characters of a candidate; of one that reads as plain words and numbers, with both, LONG.
LEAST, LONG = 10, 16
LEFT, BODY, RIGHT = 24, 48, 16
WIDTH = LEFT + BODY + RIGHT
CLASSES = 20


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' findings, by start, then kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def key_like(s: str) -> bool:
    """Whether the network is asked: not plain words and numbers, or long with letters and digits."""
    return len(s) >= LEAST and (not PLAIN.fullmatch(s) or len(s) >= LONG and bool(DIGIT.search(s) and LETTER.search(s)))


def _trimmed(text: str, lo: int, hi: int) -> tuple[int, int]:
    """A run without the signs at its end, but for the padding of base64."""
    s = text[lo:hi]
    return lo, lo + len(s.rstrip(".=/-+")) + (2 if s.endswith("==") else 1 if s.endswith("=") else 0)


def candidates(text: str) -> list[tuple[int, int]]:
    """Whole runs of key characters that key_like() asks for; signs at the end don't count."""
    runs = (_trimmed(text, *m.span()) for m in RUN.finditer(text))
    return [(lo, hi) for lo, hi in runs if key_like(text[lo:hi])]


def untouched(text: str, found: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The candidates, and of those that base findings touch the parts outside them that are candidates by themselves."""
    out = []
    for (lo, hi), hits in zip(*_touched(found, base), strict=True):
        if not hits:
            out.append((lo, hi))
            continue
        at = lo
        for s, e, _ in [*hits, (hi, hi, "")]:  # by start
            if s - at >= LEAST:
                part = _trimmed(text, at, s)
                if key_like(text[part[0] : part[1]]):
                    out.append(part)
            at = max(at, e)
    return out


def _table() -> np.ndarray:
    """The class of each code point below 256: vowel, hex and other letters of either case, digit, the key signs, quotes, brackets, space, others."""
    t = np.full(256, CLASSES - 1, np.uint8)
    groups = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", "=", ".", "-", "@", ":", "\"'`", " ", "\t\n\r", "()[]{}<>", ",;!?"]
    for k, g in enumerate(groups):
        for c in g:
            t[ord(c)] = k + 1
    return t


TABLE = _table()


def window(text: str, lo: int, hi: int) -> np.ndarray:
    """Classes of the characters before, in and after a candidate; 0 where there are none."""
    out = np.zeros(WIDTH, np.uint8)

    def put(at: int, s: str) -> None:
        codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[at : at + len(codes)] = TABLE[np.minimum(codes, 255)]

    left = text[max(0, lo - LEFT) : lo]
    put(LEFT - len(left), left)
    put(LEFT, text[lo : min(hi, lo + BODY)])
    put(LEFT + BODY, text[hi : hi + RIGHT])
    return out


def views(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """The parts of a candidate that are scored each: the whole if the network can see it, else overlapping windows from
    end to end and what stands between slashes, equals signs and full stops."""
    if hi - lo <= BODY:
        return [(lo, hi)]
    out = {(at, at + BODY) for at in (*range(lo, hi - BODY, BODY // 2), hi - BODY)}
    for m in PART.finditer(text, lo, hi):
        s, e = m.span()
        if e - s >= LONG and not PLAIN.fullmatch(m[0]):
            out |= {(s, e)} if e - s <= BODY else {(s, s + BODY), (e - BODY, e)}
    return sorted(out)


@dataclass
class CharCnn:
    """One convolution over one-hot character classes, largest and mean response, one hidden layer."""

    params: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    FILTERS, TAPS, HIDDEN = 24, 5, 16

    @classmethod
    def new(cls, seed: int) -> CharCnn:
        r = np.random.default_rng(seed)
        f, k, h = cls.FILTERS, cls.TAPS * (CLASSES + 1), cls.HIDDEN
        wide = 3 * 2 * f
        return cls({"w": r.normal(0, 0.15, (k, f)), "b": np.zeros(f), "u": r.normal(0, (2 / wide) ** 0.5, (wide, h)), "c": np.zeros(h), "v": r.normal(0, 0.3, h), "d": np.zeros(1)})

    def _patches(self, x: np.ndarray) -> np.ndarray:
        hot = np.zeros((*x.shape, CLASSES + 1), np.float32)
        np.put_along_axis(hot, x[..., None].astype(np.int64), 1, axis=2)
        n = x.shape[1] - self.TAPS + 1
        return np.concatenate([hot[:, j : j + n] for j in range(self.TAPS)], axis=2)

    #: Pools: before, in and after the candidate.
    PARTS = (slice(0, LEFT - 4), slice(LEFT, LEFT + BODY - 4), slice(LEFT + BODY - 4, None))

    def _forward(self, x: np.ndarray):
        p = self.params
        patches = self._patches(x)
        conv = np.maximum(patches @ p["w"] + p["b"], 0)
        most = [conv[:, s].max(axis=1) for s in self.PARTS]
        mean = [conv[:, s].mean(axis=1) for s in self.PARTS]
        pooled = np.concatenate(most + mean, axis=1)
        hidden = np.maximum(pooled @ p["u"] + p["c"], 0)
        return patches, conv, pooled, hidden, hidden @ p["v"] + p["d"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.params, self.FILTERS
        patches, conv, pooled, hidden, z = self._forward(x)
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(x)
        dh = np.outer(dz, p["v"]) * (hidden > 0)
        dp = dh @ p["u"].T
        dconv = np.zeros_like(conv)
        for i, s in enumerate(self.PARTS):
            part = conv[:, s]
            at = part.argmax(axis=1)
            grad = np.zeros_like(part)
            np.put_along_axis(grad, at[:, None, :], dp[:, i * f : (i + 1) * f][:, None, :], axis=1)
            dconv[:, s] += grad + dp[:, (3 + i) * f : (4 + i) * f][:, None, :] / part.shape[1]
        dconv *= conv > 0
        return {
            "w": np.tensordot(patches, dconv, ([0, 1], [0, 1])), "b": dconv.sum(axis=(0, 1)), "u": pooled.T @ dh, "c": dh.sum(axis=0),
            "v": hidden.T @ dz, "d": np.array([dz.sum()]),
        }

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int, rate: float = 0.01) -> None:
        r, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 64):
                t += 1
                for k, g in self._gradients(x[order[i : i + 64]], y[order[i : i + 64]]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.params[k] = self.params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
        """Platt's scale and shift by ``n`` held-out rows of each logit and label, then the highest threshold that keeps the recall."""
        total, keys = n.sum(), n[y > 0].sum()
        goal = np.where(y > 0, (keys + 1) / (keys + 2), 1 / (total - keys + 2))
        a, b = 1.0, 0.0
        for _ in range(400):
            g = n * (1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - goal) / total
            a, b = a - 0.05 * float((g * z).sum()), b - 0.05 * float(g.sum())
        self.scale, self.shift = max(a, 1e-3), b
        own = np.argsort(z[y > 0], kind="stable")
        at = np.searchsorted(np.cumsum(n[y > 0][own]), int((1 - recall) * keys), side="right")
        self.threshold = float(1 / (1 + np.exp(-np.clip(self.scale * z[y > 0][own[at]] + self.shift, -30, 30)))) if keys else 1.0


# fixed values: prefixes that issuers put before keys
PREFIXES = ("", "", "", "", "sk_live_", "sk-", "ghp_", "xoxb-", "AIza", "glpat-", "npm_", "eyJ")
WORDS = "data user page item value index model table stage plan order line part count total first final north river stone green light paper glass".split()


def made_up(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): keys of several alphabets in several settings, and look-alikes."""
    r = random.Random(seed)
    mixed = string.ascii_letters
    pick = lambda chars, lo, hi: "".join(r.choices(chars, k=r.randint(lo, hi)))
    low = lambda: "".join(r.choice("bcdfghlmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    out = []
    for i in range(n):
        if i % 2:
            alphabet = r.choice((string.digits + "ABCDEF", string.digits + "abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits))
            form = r.randrange(4)
            body = (
                pick(mixed, 16, 48) if form == 0  # no digit
                else pick(r.choice((mixed + string.digits, mixed + string.digits + "+/_-")), 10, 19) if form == 1  # short
                else r.choice(PREFIXES) + pick(alphabet, 20, 56)
            )
            while not key_like(body[:1] + body[1:].rstrip(".=/-+")) or body[-1] in "/-+":
                body = body.rstrip("/-+") + r.choice(mixed) + str(r.randint(0, 9)) + r.choice(mixed)
            before = r.choice((low() + " ", 'key = "', "TOKEN!! =!! \"", "auth: ", "SECRET = '", "Bearer ", "export KEY=", low() + " " + low() + ": ", '"', "("))
            after = r.choice((" " + low(), '"', "'", '"!!', "\n", ".", ")", "", '"### ' + low()))
            label = 1
        else:
            kind = r.randrange(12)
            body = (
                f"{low()}{low()}.{r.randint(1, 999)}@mail{r.randint(0, 9)}.example.com" if kind == 0
                else f"{r.choice(WORDS)}_{r.choice(WORDS)}_{r.choice(WORDS)}_{r.randint(1, 99)}" if kind == 1
                else f"{r.choice(WORDS)}/{r.choice(WORDS)}-{r.randint(1, 99)}/{r.choice(WORDS)}.html" if kind == 2
                else f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}.{r.randint(0, 59):02}.00Z" if kind == 3
                else f"{r.randint(1, 99)}{low()}{low()}{low()}{low()}" if kind == 4
                else f"www.{low()}{low()}.example.org/{r.randint(1, 9999)}" if kind == 5
                else f"{r.randint(10**15, 10**16)}{r.choice(WORDS)}" if kind == 6
                else "".join(r.choice(WORDS).title() for _ in range(r.randint(3, 5))) if kind == 7
                else r.choice(WORDS) + "".join(r.choice(WORDS).title() for _ in range(r.randint(2, 4))) if kind == 8
                else "".join(low() for _ in range(r.randint(7, 9)))[: r.randint(26, 34)] if kind == 9
                else f"{r.choice(WORDS).upper()}-{r.randint(100, 9999)}{r.choice('ABC')}-{low().title()}{r.randint(1, 9)}" if kind == 10
                else f"{low()}-{low()}-{low()}-{low()}-v{r.randint(1, 9)}.{r.randint(0, 20)}"
            )
            before, after, label = r.choice((low() + " ", "see ", "(", "\n", ": ", '"')), r.choice((" " + low(), ".", ")", "\n", "###", "!!")), 0
        if not r.randrange(3):  # settings that tell nothing
            before = r.choice((f"{r.randint(0, 10**10)}:", ",", "(", ": ", low() + " ", "|", "<", "id " + low() + ":", "= "))
            after = r.choice((",", ";", " " + low(), "|", ")", ">", ":", "\n"))
        text = f"{low()} {low()} {before}{body}{after}"
        at = text.index(body)
        out.append((text, at, at + len(body), label))
    return out


def _unsure(s: str) -> bool:
    """A mixed run that no base pattern took: it may be a key, so it doesn't teach the network that it isn't one."""
    if "@" in s:
        return False
    kinds = [c.isdigit() + 2 * c.isupper() + 4 * c.islower() for c in s]
    n = Counter(s)
    return 3 * sum(map(ne, kinds, kinds[1:])) >= len(s) or len(s) >= 20 and -sum(k / len(s) * log2(k / len(s)) for k in n.values()) >= 3.0


#: Findings that one task trains on beside as many keys made up as MADE, passes over them, and steps of a logit that calibration tells apart.
BLOCK, MADE, EPOCHS, STEPS = 20_000, 6000, 6, 1024


def _block_rows(table: pa.Table, seed: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block, windows and labels to train on, and those held out, of a block's findings and of keys made up for it."""
    block = table.column("block")[0].as_py()
    rows = sorted((x, y) for x, y in zip(table.column("x").to_pylist(), table.column("y").to_pylist(), strict=True) if x is not None)
    made = made_up(MADE, seed + block)
    x = np.stack([np.frombuffer(r, np.uint8) for r, _ in rows] + [window(t, a, b) for t, a, b, _ in made])
    y = np.array([k for _, k in rows] + [m[3] for m in made], dtype=float)
    order = np.random.default_rng(seed + block).permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    return block, x[own], y[own], x[held], y[held]


def _trained(dealt: DataFrame, model: CharCnn, epochs: int, seed: int) -> dict[str, np.ndarray]:
    """The mean, over the blocks, of the parameters after some passes over each; as many numbers reach the driver as there are parameters."""

    def train(table: pa.Table) -> pa.Table:
        block, x, y, _, _ = _block_rows(table, seed)
        own = CharCnn(dict(model.params))
        own.train(x, y, epochs, seed + block)
        flat = np.concatenate([own.params[k].ravel() for k in sorted(own.params)])
        return pa.table({"k": pa.array(np.arange(len(flat)), pa.int32()), "v": flat})

    got = dealt.groupBy("block").applyInArrow(train, "k int, v double").groupBy("k").agg(F.avg("v").alias("v")).collect()
    flat, out, at = np.array([r.v for r in sorted(got)]), {}, 0
    for k in sorted(model.params):
        size = model.params[k].size
        out[k], at = flat[at : at + size].reshape(model.params[k].shape), at + size
    return out


def _held_logits(dealt: DataFrame, model: CharCnn, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of the rows held out in steps, rounded down, with labels and counts."""

    def count(table: pa.Table) -> pa.Table:
        _, _, _, x, y = _block_rows(table, seed)
        at = np.floor(np.clip(model.logits(x), -40, 40) * STEPS).astype(np.int64)
        found, n = np.unique(at * 2 + y.astype(np.int64), return_counts=True)
        return pa.table({"k": found, "n": n.astype(np.int64)})

    got = sorted(dealt.groupBy("block").applyInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect())
    k, n = np.array([r.k for r in got]), np.array([r.n for r in got])
    return (k >> 1) / STEPS, k & 1, n


def fit(docs: DataFrame, sample_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.995, seed: int = 7) -> CharCnn:
    """Train on all labelled findings of all rows, or, if ``sample_rows`` is given, of so many rows, those with the smallest
    hashes of id and text; null ids and texts count as any other.

    Findings are dealt to blocks by their hash, each with as many made-up keys, so that these keep their weight.  A task
    trains on one block; with more than one, the parameters are averaged after each pass.  Calibration and threshold take
    the held-out part of every block.
    """
    rows = need(docs, id_col, text_col)
    chosen = rows
    if sample_rows is not None:
        order = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
        chosen = rows.where(order <= hash_bound(rows.select(order.alias("k")), sample_rows))

    def findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                for (lo, hi), hits in zip(*_touched(candidates(text), base), strict=True):
                    label = bool(hits)
                    if label or not _unsure(text[lo:hi]):
                        # of a long run with a finding, the views that hold as much of it as they can
                        seen = [v for v in views(text, lo, hi) if not label or any(min(e, v[1]) - max(s, v[0]) >= min(e - s, LONG, hi - lo) for s, e, _ in hits)]
                        xs += [window(text, *v).tobytes() for v in seen]
                        ys += [int(label)] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.int32())], names=["x", "y"])

    labelled = materialise(chosen.mapInArrow(findings, "x binary, y int").distinct(), "findings")
    blocks = max(1, -(-labelled.count() // BLOCK))
    # a row a block without a finding, so that each is there even if no text has any
    every = docs.sparkSession.range(blocks).select(F.lit(None).cast("binary").alias("x"), F.lit(0).alias("y"), F.col("id").cast("int").alias("block"))
    dealt = labelled.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "x", "y"), F.lit(blocks)).cast("int")).unionByName(every)
    model, rounds = CharCnn.new(seed), EPOCHS if blocks > 1 else 1
    for k in range(rounds):
        model.params = _trained(dealt, model, EPOCHS // rounds, seed + k)
    model.calibrate(*_held_logits(dealt, model, seed), recall)
    discard(labelled)
    return model


def _touched(found: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int]], list[list[tuple[int, int, str]]]]:
    """Candidates, in order, and the base findings that each of them overlaps; one walk over both."""
    out, at = [], 0
    ends = np.maximum.accumulate([e for _, e, _ in base]).tolist() if base else []  # the furthest end so far
    for lo, hi in found:
        while at < len(base) and ends[at] <= lo:
            at += 1
        own, k = [], at
        while k < len(base) and base[k][0] < hi:
            if base[k][1] > lo:
                own.append(base[k])
            k += 1
        out.append(own)
    return found, out


def all_spans(text: str, model: CharCnn) -> list[tuple[int, int, str]]:
    """Base findings, and the network's where they don't overlap a base finding."""
    base = base_spans(text)
    more = untouched(text, candidates(text), base)
    if more:
        seen = [views(text, lo, hi) for lo, hi in more]
        scores = model.scores(np.stack([window(text, *v) for vs in seen for v in vs]))
        ok = np.maximum.reduceat(scores, np.cumsum([0] + [len(vs) for vs in seen[:-1]])) >= model.threshold
        base = sorted(base + [(lo, hi, "learned") for (lo, hi), k in zip(more, ok, strict=True) if k], key=lambda s: (s[0], KINDS.index(s[2])))
    return base


def scan(docs: DataFrame, model: CharCnn | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array<struct<kind, start, end>>): one row per row, findings in code points of the whole text.

    Null and empty texts have no findings; rows that repeat are scanned each; null ids stay; an empty table gives no
    rows (and a network trained on made-up findings alone).
    """
    model = model or fit(docs, id_col=id_col, text_col=text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            got = [[{"kind": k, "start": s, "end": e} for s, e, k in all_spans(t.as_py() or "", model)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, span)], names=["id", "spans"])

    out = need(docs, id_col, text_col).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, model: CharCnn | None = None, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with ``mark`` in place of each finding (overlapping findings: one mark).

    Null and empty texts stay as they are; rows that repeat are redacted each; an empty table gives no rows.
    """
    model = model or fit(docs, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text or not (spans := all_spans(text, model)):
            return text
        out, done = [], 0
        for s, e, _ in spans:
            if s >= done:
                out += [text[done:s], mark]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([clean(t.as_py()) for t in b.column(at)], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)
