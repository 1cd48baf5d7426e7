"""Quality and toxicity filter from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each row of a bounded labelled sample; the table of labels
is one more labeller.  Toxicity has three labellers of different evidence: a fixed list of insults, the table's marks, and a
lexicon of words and word beginnings that toxic rows of other folds show, so that a row's own mark has no part in its
vote.  Expectation maximisation estimates each labeller's accuracy and each row's posterior (Dawid and Skene, 1979).  The posteriors train
two linear scorers over hashed features (binned shape measures; words and word beginnings, apart
where several words share one), which then scores every row of
the corpus on its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import hash_bound, need

BUCKETS = 1 << 18
WORD = re.compile(r"[^\W\d_]+")
SIGNS = re.compile(r"[#$%&*!?~^=+@]{2,}(?=\s|$)")
ENDS = re.compile(r"[.!?](?=\s|$)")
# fixed values: insults that mark a text as toxic
INSULTS = frozenset("bastard bitch clown crap creep cretin disgusting dumb dumbass filthy freak garbage hate idiot idiotic imbecile jerk kill loser lousy moron moronic pathetic pig scum scumbag shit slut stupid trash ugly vermin vile worthless".split())
SHAPES = ("signs", "upper", "bars", "repeats", "variety", "ends", "length")
GOOD, BAD, NOTHING = 0, 1, 2


def shapes(text: str) -> tuple[int, list[float]]:
    """Words, and shares: sign-ended words, upper-case words, bars, words equal to the one before, distinct words, sentence ends; mean word length."""
    ws = text.split()
    n = len(ws)
    if not n:
        return 0, [0.0] * len(SHAPES)
    return n, [
        len(SIGNS.findall(text)) / n, sum(map(str.isupper, ws)) / n, text.count("|") / n, sum(map(eq, ws, ws[1:])) / n, len(set(ws)) / n, len(ENDS.findall(text)) / n, len(text) / n
    ]


def _plain(n: int, s: list[float]) -> bool:
    return s[0] < 0.03 and s[2] < 0.02 and (n < 5 or s[1] < 0.2 and s[3] < 0.06) and (n < 60 or 0.03 < s[5] < 0.3) and 2.5 < s[6] < 14


#: The heuristic labellers of quality, by name: (words, shares) -> vote.  Each knows one kind of junk and votes for nothing
#: on the rest; one votes good where no measure is out of the ordinary.
LABELLERS = {
    "signs": lambda n, s: BAD if s[0] > 0.15 else NOTHING,
    "upper": lambda n, s: BAD if s[1] > 0.5 and n >= 5 else NOTHING,
    "bars": lambda n, s: BAD if s[2] > 0.15 else NOTHING,
    "repeats": lambda n, s: BAD if s[3] > 0.2 and n >= 5 else NOTHING,
    "variety": lambda n, s: BAD if s[4] < 0.15 and n >= 50 else NOTHING,
    "sentences": lambda n, s: BAD if s[5] < 0.004 and n >= 60 else NOTHING,
    "lengths": lambda n, s: BAD if n and not 2.5 <= s[6] <= 30 else NOTHING,
    "plain": lambda n, s: GOOD if _plain(n, s) else NOTHING,
}


def units(word: str) -> list[int]:
    """Hashed features of a word: the whole, and its beginnings of 3 to 7 letters."""
    return [crc32(("w" + word).encode()) % BUCKETS] + [crc32((f"{k}" + word[:k]).encode()) % BUCKETS for k in (3, 4, 5, 6, 7) if len(word) > k]


def again(unit: int) -> int:
    """The feature of a text that has ``unit`` in more than one of its different words."""
    return (unit * 2654435761 + 97) % BUCKETS


def word_units(words: Iterable[str]) -> set[int]:
    """Hashed features of a text's different words; those of more than one word count apart."""
    once: set[int] = set()
    twice: set[int] = set()
    for w in words:
        for u in units(w):
            (twice if u in once else once).add(u)
    return once.union(map(again, twice))


def shape_units(n: int, s: list[float]) -> list[int]:
    """Hashed features of binned shape measures."""
    steps = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
    bins = [sum(v > x for x in steps) for v in s[:6]] + [min(int(s[6]), 40)]
    return [crc32(f"#{name}{b}".encode()) % BUCKETS for name, b in zip(SHAPES, bins, strict=True)] + [crc32(f"#n{min(n.bit_length(), 4)}".encode()) % BUCKETS]


def estimate(votes: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of BAD for each row, each labeller's accuracy and the prior of BAD, by expectation maximisation.

    ``votes``: rows x labellers of GOOD, BAD, NOTHING.  A vote is right with its labeller's accuracy whatever the truth,
    and no vote tells nothing: a labeller of one kind of junk says nothing about the other kinds.
    """
    sign = np.where(votes == BAD, 1.0, np.where(votes == GOOD, -1.0, 0.0))
    voted = np.abs(sign)
    accuracy, prior = np.full(votes.shape[1], 0.8), 0.1
    p = np.zeros(len(votes))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(sign @ np.log(accuracy / (1 - accuracy)) + np.log(prior / (1 - prior)), -50, 50)))
        right = (np.where(sign > 0, p[:, None], 1 - p[:, None]) * voted).sum(axis=0)
        accuracy = np.clip((right + 8) / (voted.sum(axis=0) + 10), 0.05, 0.999)
        prior = float(np.clip(p.mean(), 1e-3, 0.9)) if len(p) else prior
    return p, accuracy, prior


@dataclass
class Scorer:
    """A linear scorer over hashed features."""

    weights: np.ndarray
    bias: float
    threshold: float
    accuracies: dict[str, float]

    def probability(self, total: float) -> float:
        return float(1 / (1 + np.exp(-max(-50.0, min(50.0, total + self.bias)))))


@dataclass
class Model:
    junk: Scorer
    toxic: Scorer
    rows: int

    KEPT = 300_000

    def scores(self, text: str, memo: dict[str, tuple[int, ...]]) -> tuple[float, float]:
        """(junk, toxic) probabilities of a whole text; ``memo`` keeps words' features that carry a weight, boundedly."""
        junk, weights = float(self.junk.weights[shape_units(*shapes(text))].sum()), self.toxic.weights
        once: set[int] = set()
        twice: set[int] = set()
        for w in set(WORD.findall(text.lower())):
            got = memo.get(w)
            if got is None:
                if len(memo) >= self.KEPT:
                    memo.clear()
                got = memo[w] = tuple(u for u in units(w) if weights[u] or weights[again(u)])
            for u in got:
                (twice if u in once else once).add(u)
        return self.junk.probability(junk), self.toxic.probability(float(sum(weights[sorted(once.union(map(again, twice)))])))


def _train(rows: list[np.ndarray], goal: np.ndarray, held: np.ndarray, most_false: float, steps: int = 150) -> tuple[np.ndarray, float, float]:
    """Weights, bias and threshold: logistic regression on soft goals, over the features that tell the goals apart."""
    own = np.flatnonzero(~held)
    counts = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *rows])
    row_of = np.repeat(np.arange(len(rows), dtype=np.int32), counts)
    mine = ~held[row_of]
    bad = np.bincount(flat[mine], weights=goal[row_of[mine]], minlength=BUCKETS)
    both = np.bincount(flat[mine], minlength=BUCKETS)
    prior = float(np.clip(goal[own].mean() if len(own) else 0.1, 1e-3, 0.999))
    z = (bad - prior * both) / np.sqrt(np.maximum(both * prior * (1 - prior), 1e-9))
    telling = (both >= 3) & (np.abs(z) >= 4)
    use = mine & telling[flat]
    at, feature = row_of[use], flat[use]
    w, b = np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, steps + 1):
        total = np.bincount(at, weights=w[feature], minlength=len(rows))[own] + b
        g = np.zeros(len(rows))
        g[own] = (1 / (1 + np.exp(-np.clip(total, -50, 50))) - goal[own]) / max(len(own), 1)
        gw, gb = np.bincount(feature, weights=g[at], minlength=BUCKETS) + 2e-6 * w, float(g.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    w[~telling] = 0
    total = np.bincount(row_of, weights=w[flat], minlength=len(rows)) + b
    p = 1 / (1 + np.exp(-np.clip(total, -50, 50)))
    clean = np.sort(p[held & (goal < 0.5)])
    threshold = max(0.5, float(clean[min(len(clean) - 1, int((1 - most_false) * len(clean)))]) + 1e-6) if len(clean) else 0.5
    return w, b, min(threshold, 0.99)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, sample_words: int = 4_000, most_false: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on ``sample_rows`` labelled rows (all of them if there are fewer), those with the smallest hashes of id and text.

    ``labels``: (id_col, quality, toxic).  The driver holds the sample's hashed features, some 5 KB a row, of a row at
    most those of its first ``sample_words`` different words by hash.  Labels of
    rows that ``docs`` lacks are left out; null labels are votes for nothing; without labels, heuristics alone vote.
    """
    marks = need(labels, id_col, "quality", "toxic").groupBy(id_col).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # first by ids, so that few texts are joined; then, as an id may repeat, by id and text
    few = hash_bound(marks.select(F.xxhash64(F.col(f"`{id_col}`")).alias("k")), sample_rows)
    marks = marks.where(F.xxhash64(F.col(f"`{id_col}`")) <= few)
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    chosen = need(docs, id_col, text_col).where(F.xxhash64(F.col(f"`{id_col}`")) <= few).join(marks, id_col)
    chosen = chosen.where(key <= hash_bound(chosen.select(key.alias("k")), sample_rows))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_row(text or "", quality, toxic, sample_words) for text, quality, toxic in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            cols = list(zip(*out, strict=True)) or [[]] * len(ROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, ROW.values(), strict=True)], names=list(ROW))

    got = chosen.mapInArrow(features, "words binary, shape binary, votes binary, insult int, toxic int").collect()
    return _learn([tuple(r) for r in got], most_false)


ROW = {"words": pa.binary(), "shape": pa.binary(), "votes": pa.binary(), "insult": pa.int32(), "toxic": pa.int32()}


def _row(text: str, quality: int | None, toxic: int | None, sample_words: int) -> tuple[bytes, bytes, bytes, int, int]:
    """What the driver learns from a labelled row: hashed features of words and of shape, votes on quality and toxicity."""
    n, s = shapes(text)
    words = set(WORD.findall(text.lower()))
    own = word_units(words if len(words) <= sample_words else sorted(words, key=lambda w: crc32(w.encode()))[:sample_words])
    votes = [vote(n, s) for vote in LABELLERS.values()] + [NOTHING if quality is None else int(quality == 0)]
    return (
        np.array(sorted(own), "<u4").tobytes(), np.array(shape_units(n, s), "<u4").tobytes(), bytes(votes),
        BAD if words & INSULTS else NOTHING, NOTHING if toxic is None else int(toxic != 0),
    )


def _learn(got: list[tuple], most_false: float) -> Model:
    """Both scorers, from the sample's rows."""
    got = sorted(got, key=lambda r: (bytes(r[0]), bytes(r[1]), bytes(r[2]), r[4]))
    names = [*LABELLERS, "labels"]
    rows, forms = ([np.frombuffer(bytes(r[i]), "<u4") for r in got] for i in (0, 1))
    held = np.arange(len(rows)) * 2654435761 % 1000 < 200
    junk, accuracy, _ = estimate(np.array([list(bytes(r[2])) for r in got], dtype=np.int64).reshape(len(rows), len(names)))
    junk_scorer = Scorer(*_train(forms, junk, held, most_false), dict(zip(names, accuracy.round(4).tolist(), strict=True)))

    marked, insult = (np.array([r[i] for r in got], dtype=np.int64) for i in (4, 3))
    toxic, accuracy, _ = estimate(np.stack([insult, _lexicon_votes(rows, marked), marked], axis=1))
    toxic_scorer = Scorer(*_train(rows, toxic, held, most_false), dict(zip(("insults", "lexicon", "labels"), accuracy.round(4).tolist(), strict=True)))
    return Model(junk_scorer, toxic_scorer, len(rows))


def _lexicon_votes(rows: list[np.ndarray], marked: np.ndarray, folds: int = 5) -> np.ndarray:
    """A vote on each row by the features that the other folds' toxic rows show and their other rows hardly do: a row's own
    mark has no part in its vote, so the lexicon and the marks err apart."""
    fold = np.arange(len(rows)) * 40503 % 65536 % folds
    votes = np.full(len(rows), NOTHING)
    count = np.zeros((folds, 2, BUCKETS), np.int32)
    for r, t, k in zip(rows, marked, fold, strict=True):
        if t != NOTHING:
            count[k, t][r] += 1
    number = np.array([[((marked == t) & (fold == k)).sum() for t in (GOOD, BAD)] for k in range(folds)])
    for k in range(folds):
        good, bad = count.sum(axis=0) - count[k]
        n_good, n_bad = np.maximum(number.sum(axis=0) - number[k], 1)
        telling = (bad >= 3) & (bad / n_bad > 20 * (good + 0.5) / n_good)
        if telling.any():
            for i in np.flatnonzero(fold == k):
                votes[i] = BAD if telling[rows[i]].any() else GOOD
    return votes


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, quality, toxicity, keep): probabilities of a good and of a toxic text for every row, on its whole text.

    Null and empty texts are scored by their shape alone and kept unless the model rejects it; rows that repeat are
    scored each; null ids stay; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = sent.value, {}
        for b in batches:
            got = [m.scores(t.as_py() or "", memo) for t in b.column(1)]
            keep = [j < m.junk.threshold and t < m.toxic.threshold for j, t in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([1 - j for j, _ in got], pa.float64()), pa.array([t for _, t in got], pa.float64()), pa.array(keep, pa.bool_())], names=["id", "quality", "toxicity", "keep"])

    out = need(docs, id_col, text_col).mapInArrow(run, f"id {kind}, quality double, toxicity double, keep boolean")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject.

    Null and empty texts are judged by their shape alone; rows that repeat are judged each, alike; an empty table stays
    empty.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = sent.value, {}
        for b in batches:
            got = (m.scores(t.as_py() or "", memo) for t in b.column(at))
            yield b.filter(pa.array([j < m.junk.threshold and t < m.toxic.threshold for j, t in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
