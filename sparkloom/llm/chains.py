"""Fuzzy repeated passages by collinear chaining.

Texts are classes of equal documents.  Every text keeps the smallest hash of each window of k-mers, so any common run of
K + WINDOW - 1 words holds a seed that both sides kept, and kept seeds overlap.  Texts that share a seed are tied: each to
each if the seed stands in FEW texts at most, else to one of them; texts that share a run of a passage's length, too, are
tied to one that has the run.  Texts tied by two seeds in line some words apart, or by a run, are read: all seeds that the
two share are chained in order (the best chain that ends in a match is found with a Fenwick tree of prefix maxima, at a
linear cost for the gaps) and chains are aligned on the words of both, which gives the passages' bounds and their share of
equal words.

Seeds of more than FEW texts are then gone through again, two in line at a time: where the texts that hold both aren't all
linked, and covered there, by passages found so far, each is compared with each on the words around the two seeds, until a
verified passage connects them.  Those pairs are read like the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import connected_components, hot_join, join_counted, materialise, need, salted_join
from sparkloom.llm.winnow import grams, hashed, kept, mixed, rightmost, words

K, WINDOW = 5, 4
#: Texts that a seed may stand in to tie each to each.
FEW = 8
#: Words that two seeds in line must reach over, together, for two texts to be read.
REACH = 16
GAP_COST = 0.25
#: Words of texts kept in a task for further pairs.
KEPT_WORDS = 1 << 20
#: Texts of two seeds in line that meet in one task; beyond that, two such blocks do.
BLOCK = 2048
#: Places that are compared at once in a task.
PLACES = 1 << 20
#: Seeds whose keys a task makes at once.
ROWS = 20_000


class Fenwick:
    """Prefix maxima with the place they come from."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def add(self, i: int, value: float, place: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, place)
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """The largest value among places below ``i``."""
        out = (-1e18, -1)
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def chain(matches: list[tuple[int, int, int]], gap_cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains of matches (position in a, position in b, words), best first; positions grow in both along a chain.

    A chain's score is the words of its matches less ``gap_cost`` a word that it moves on in either text from the start
    of a match to the next, beyond the match's own words; a chain ends where going on would score below starting anew.
    """
    order = sorted(set(matches))
    ranks = {b: i for i, b in enumerate(sorted({b for _, b, _ in order}))}
    tree = Fenwick(len(ranks))
    score, before = [0.0] * len(order), [-1] * len(order)
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:  # matches at one place of a can't follow one another
            a, b, n = order[j]
            value, place = tree.upto(ranks[b])
            value -= gap_cost * (a + b)
            score[j], before[j] = (n + value, place) if place >= 0 and value > 0 else (float(n), -1)
            j += 1
        for m in range(i, j):
            a, b, n = order[m]
            tree.add(ranks[b], score[m] + gap_cost * (a + b + 2 * n), m)
        i = j
    used, out = [False] * len(order), []
    for end in sorted(range(len(order)), key=lambda m: (-score[m], m)):
        path, m = [], end
        while m >= 0 and not used[m]:
            used[m] = True
            path.append(order[m])
            m = before[m]
        if path:
            out.append(path[::-1])
    return out


def _extend(a: list[bytes], b: list[bytes], i: int, j: int, step: int, lo: tuple[int, int], hi: tuple[int, int]) -> tuple[int, int]:
    """(words gone on, equal ones) from (i, j) outward with an X-drop of 6: +1 for equal words, -2 for others."""
    best = at = same = kept_n = kept_same = 0
    while lo[0] <= i < hi[0] and lo[1] <= j < hi[1]:
        at += 1
        if a[i] == b[j]:
            same += 1
        value = same - 2 * (at - same)
        if value > best:
            best, kept_n, kept_same = value, at, same
        elif value < best - 6:
            break
        i, j = i + step, j + step
    return kept_n, kept_same


def _common(a: list[bytes], b: list[bytes]) -> int:
    """Equal words of the best alignment of two short runs (longest common subsequence by bits)."""
    if a == b:
        return len(a)
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        x = row & places.get(w, 0)
        row = ((row + x) | (row - x)) & full
    return len(a) - row.bit_count()


def _parts(a: list[bytes], b: list[bytes], path: list[tuple[int, int, int]]) -> list[list[int]]:
    """A chain's matches as [position in a, in b, words, equal words between it and the next, longest gap to the next];
    a match that overlaps the one before is cut or left out."""
    out: list[list[int]] = []
    for x, y, n in path:
        if out:
            at_a, at_b = out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]
            cut = max(at_a - x, at_b - y, 0)
            if cut >= n:
                continue
            x, y, n = x + cut, y + cut, n - cut
            out[-1][3:] = [_common(a[at_a:x], b[at_b:y]), max(x - at_a, y - at_b)]
        out.append([x, y, n, 0, 0])
    return out


def align(a: list[bytes], b: list[bytes], path: list[tuple[int, int, int]], least: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """(start, end) in a, (start, end) in b and equal words of the passages on a chain: the whole chain, extended at both
    ends, if it is alike enough; otherwise it is parted at the gap with the most unequal words, and so on."""
    parts, out = _parts(a, b, path), []
    todo = [(0, len(parts))]
    while todo:
        lo, hi = todo.pop()
        (i, j), (x, y, n, _, _) = parts[lo][:2], parts[hi - 1]
        left, left_same = _extend(a, b, i - 1, j - 1, -1, (0, 0), (len(a), len(b)))
        right, right_same = _extend(a, b, x + n, y + n, 1, (0, 0), (len(a), len(b)))
        got = i - left, x + n + right, j - left, y + n + right
        long = max(got[1] - got[0], got[3] - got[2])
        if long < least:
            continue
        same = left_same + right_same + sum(p[2] for p in parts[lo:hi]) + sum(p[3] for p in parts[lo : hi - 1])
        if same >= similarity * long:
            if min(got[1] - got[0], got[3] - got[2]) >= least:
                out.append((*got, same))
        elif hi - lo > 1:
            cut = max(range(lo, hi - 1), key=lambda m: parts[m][4] - parts[m][3]) + 1
            todo += [(lo, cut), (cut, hi)]
    return out


def common_runs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """Matches (position in a, position in b, words) of the seeds that two texts share; seeds that follow one another
    without a gap in both are one match.

    Each place in either text is matched with the first in the other, so texts that repeat themselves are covered whole
    without a match for every two places.
    """
    (sa, pa_), (sb, pb) = a, b
    both, first_a, first_b = np.intersect1d(sa, sb, return_indices=True)  # the first places: seeds are in order of place
    if not len(both):
        return []
    x, y = [pa_[first_a]], [pb[first_b]]
    for seeds, places, firsts, mine, other in ((sa, pa_, first_b, x, y), (sb, pb, first_a, y, x)):
        at = np.searchsorted(both, seeds)
        at[at == len(both)] = 0
        hit = np.flatnonzero(both[at] == seeds)
        mine.append(places[hit])
        other.append((pb if mine is x else pa_)[firsts[at[hit]]])
    x, y = np.concatenate(x), np.concatenate(y)
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    new = np.concatenate(([True], (np.diff(x - y) != 0) | (np.diff(x) > K)))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(x)) - 1
    return list(zip(x[starts].tolist(), y[starts].tolist(), (x[ends] - x[starts] + K).tolist(), strict=True))


def passages(a: list[bytes], b: list[bytes], paths: list[list[tuple[int, int, int]]], least: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """The passages of ``least`` words or more in both texts on chains, with ``similarity`` equal words; none from a chain
    within a passage that was found before."""
    out: list[tuple[int, int, int, int, int]] = []
    for path in paths:
        (i, j, _), (x, y, n) = path[0], path[-1]
        if not any(s <= i and x + n <= e and t <= j and y + n <= f for s, e, t, f, _ in out):
            out += align(a, b, path, least, similarity)
    return sorted(set(out))


def seeds_of(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Kept seeds and their places, in order; of a run of one repeated word, the start."""
    return _seeds(mixed(ws))[:2]


def _seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' hashes: kept seeds, their places, and which were kept more than once in a row."""
    g = grams(hashes, K)
    at = kept(g, WINDOW)
    often = np.zeros(len(at), bool)
    new = g[at][1:] != g[at][:-1]
    if not new.all():
        new = np.flatnonzero(np.concatenate(([True], new)))
        often, at = np.diff(np.append(new, len(at))) > 1, at[new]
    return g[at].view(np.int64), at.astype(np.int64), often


def seeds_of_texts(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_seeds() of texts of ``n`` words each, whose words' hashes follow one another, and the number of each seed's text."""
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    begin = np.cumsum(n) - n
    if n.min() < K + WINDOW:  # too few for a window
        got = [(*_seeds(hashes[b : b + size]), i) for i, (b, size) in enumerate(zip(begin.tolist(), n.tolist(), strict=True))]
        return *(np.concatenate([x[i] for x in got]) for i in range(3)), np.repeat([x[3] for x in got], [len(x[0]) for x in got])
    g = grams(hashes, K)
    windows = np.ones(len(g) - WINDOW + 1, bool)
    for b in range(1, K + WINDOW - 1):  # windows that reach into the next text
        windows[(begin - b)[1:]] = False
    text = np.repeat(np.arange(len(n)), n)[: len(windows)][windows]
    at = np.flatnonzero(windows) + rightmost(g, WINDOW)[windows]
    keep = np.concatenate(([True], at[1:] != at[:-1]))
    at, text = at[keep], text[keep]
    seed = g[at]
    new = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (text[1:] != text[:-1]))))
    often = np.diff(np.append(new, len(seed))) > 1
    at, text = at[new], text[new]
    return seed[new].view(np.int64), at - begin[text], often, text


def runs_of(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, of the words' hashes."""
    weight = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(x), 0x9E3779B97F4A7C15, np.uint64))))
    unweight = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(x), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * weight[:-1])))
    h = (sums[n:] - sums[:-n]) * unweight[: max(len(x) - n + 1, 0)]
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0xFF51AFD7ED558CCD)).view(np.int64)


def shared_runs(hashes: np.ndarray, places: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the runs of ``least`` words in which no seed is the text's own."""
    first = np.arange(max(len(hashes) - least + 1, 0))
    own = places[~shared]
    ok = np.searchsorted(own, first) == np.searchsorted(own, first + least - K, side="right")
    return np.unique(runs_of(hashes, least)[ok]) if ok.any() else np.zeros(0, np.int64)


def equal_runs(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Of the hashes of two texts' runs: (start, end) of the words of the first that lie in runs which the second has, and
    (start, end) of such a run in the second."""
    both, first = np.unique(b, return_index=True)
    at = np.searchsorted(both, a)
    at[at == len(both)] = 0
    hit = np.flatnonzero(both[at] == a) if len(both) else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], np.diff(hit) > 1))[: len(hit)])
    ends = np.append(starts[1:], len(hit)) - 1
    return [(int(hit[s]), int(hit[e]) + least, int(t), int(t) + least) for s, e, t in zip(starts, ends, first[at[hit[starts]]], strict=True)] if len(hit) else []


def in_line_keys(text: np.ndarray, seeds: np.ndarray, places: np.ndarray, many: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of shared seeds sorted by text and place: (key, place in the seeds, place of its last word's end, seed before, seed
    after) of each two in line, less than ``least`` words apart, that reach over REACH words, where one is of many texts.
    The last two are 0 where that seed is too far away: a key all of whose places agree on one of them tells nothing that
    the longer key doesn't."""
    out: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, np.int64) for _ in range(5))]
    x = seeds.view(np.uint64)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53)
    at = places + (text << 32)
    none, far = np.zeros(1, np.uint64), np.full(1, 1 << 60)
    left, right = np.concatenate((none, x[:-1])) | np.uint64(1), np.concatenate((x[1:], none)) | np.uint64(1)
    at_left, at_right = np.concatenate((-far, at[:-1])), np.concatenate((at[1:], far))
    for step in range(1, min(least, len(x))):
        apart = at[step:] - at[:-step]
        i = np.flatnonzero((apart >= REACH - K) & (apart < least) & (many[step:] | many[:-step]))
        j = i + step
        h = x[i] * np.uint64(0x9E3779B97F4A7C15) + x[j]
        h ^= h >> np.uint64(31)
        before = np.where(at[j] - at_left[i] < least, left[i], np.uint64(0))
        after = np.where(at_right[j] - at[i] < least, right[j], np.uint64(0))
        out.append((h.view(np.int64), i, places[j] + K, before.view(np.int64), after.view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def around(ws: np.ndarray, start: int, end: int, least: int) -> bytes:
    """Short hashes of ``least`` words before a place, nearest first, of as many after it, 0 beyond the text, and of the
    place's own words."""
    out = np.zeros(2 * least, np.uint16)
    left, right = ws[max(start - least, 0) : start][::-1], ws[end : end + least]
    out[: len(left)] = left
    out[least : least + len(right)] = right
    return out.tobytes() + ws[start:end].tobytes()


def _reached(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_extend() for rows of equal words: words gone on, equal ones."""
    same = np.cumsum(equal, axis=1, dtype=np.int32)
    n = np.arange(1, equal.shape[1] + 1, dtype=np.int32)
    value = np.concatenate((np.zeros((len(equal), 1), np.int32), 3 * same - 2 * n), axis=1)
    top = np.maximum.accumulate(value, axis=1)
    value[np.maximum.accumulate(value < top - 6, axis=1)] = -1
    at = value.argmax(axis=1)
    return at, np.where(at > 0, same[np.arange(len(equal)), at - 1], 0)


def linked(h: np.ndarray, root: np.ndarray, covered: np.ndarray, block: np.ndarray | None, near: list[bytes], least: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of the rows of one key whose passages around the key are alike: rows that hold it are connected by them, or
    by their roots where passages cover the key already, if any two of them are alike.

    With ``block``, only rows of different blocks are compared.
    """
    n, side = len(h), 2 * least
    words_at = [np.frombuffer(x, np.uint16) for x in near]
    sides = np.stack([x[:side] for x in words_at])
    reach = np.array([len(x) - side for x in words_at])
    _, tree = np.unique(root, return_inverse=True)
    up = list(range(n + int(tree.max()) + 1))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in np.flatnonzero(covered).tolist():
        up[i] = n + int(tree[i])
    out: list[tuple[int, int]] = []
    step, some = max(PLACES // (n * side), 1), max(PLACES // side, 1)
    for lo in range(0, n, step):
        part = np.array([find(i) for i in range(n)])
        mine = np.arange(lo, min(lo + step, n))
        ok = (part[mine][:, None] != part) & (h[mine][:, None] != h) & (mine[:, None] > np.arange(n))
        if block is not None:
            ok &= block[mine][:, None] != block
        x, y = np.nonzero(ok)
        x += lo
        for cut in range(0, len(x), some):
            i, j = x[cut : cut + some], y[cut : cut + some]
            equal = (sides[i] == sides[j]) & (sides[i] != 0)
            short = np.minimum(reach[i], reach[j])
            at = np.flatnonzero(short + 1.5 * equal.sum(axis=1) >= least)  # going on takes two equal words of three
            i, j, equal, short = i[at], j[at], equal[at], short[at]
            (left, left_same), (right, right_same) = _reached(equal[:, :least]), _reached(equal[:, least:])
            more, same = left + right, left_same + right_same
            need_same = similarity * (np.maximum(reach[i], reach[j]) + more) - same
            at = np.flatnonzero((short + more >= least) & (short >= need_same))
            for a, b, least_same in zip(i[at].tolist(), j[at].tolist(), need_same[at].tolist(), strict=True):
                if find(a) != find(b) and _common(words_at[a][side:].tolist(), words_at[b][side:].tolist()) >= least_same:
                    out.append((a, b))
                    for other in (b, n + int(tree[a]), n + int(tree[b])):
                        up[find(other)] = find(a)
    return out


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


class Groups:
    """Rows (key, h, place), sorted, that come in pieces: the texts of each key, tied."""

    def __init__(self):
        self.held = [np.zeros(0, np.int64)] * 3
        self.many: tuple[int, int, int] | None = None  # key, first h and its place, of a key that goes on

    def add(self, key: np.ndarray, h: np.ndarray, place: np.ndarray, last: bool = False) -> Iterator[tuple[str, tuple[np.ndarray, ...]]]:
        """("few", (key, h, place, other h, its place)) for each two texts of a key of FEW at most; ("many", the same with
        the key's first text) for each text of other keys but the first; ("held", (key, h, place, many)) for each text of
        a key that more than one text holds."""
        key, h, place = (np.concatenate(x) for x in zip(self.held, (key, h, place), strict=True))
        if len(key):
            new = np.concatenate(([True], (np.diff(key) != 0) | (np.diff(h) != 0)))  # copies of a text
            key, h, place = key[new], h[new], place[new]
        if self.many is not None and len(key):
            n = len(key) if key[-1] == self.many[0] else int(np.argmax(key != self.many[0]))
            own = h[:n] != self.many[1]
            rows = key[:n][own], h[:n][own], place[:n][own]
            yield "many", (*rows, np.full(int(own.sum()), self.many[1]), np.full(int(own.sum()), self.many[2]))
            yield "held", (*rows, np.ones(int(own.sum()), bool))
            key, h, place = key[n:], h[n:], place[n:]
            if len(key):
                self.many = None
        if not len(key):
            self.held = [key, h, place]
            return
        starts = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))
        size = np.diff(np.append(starts, len(key)))
        group = np.repeat(np.arange(len(starts)), size)
        done = np.ones(len(starts), bool)
        if not last:
            done[-1] = size[-1] > FEW
            if done[-1]:
                at = starts[-1]
                self.many = int(key[at]), int(h[at]), int(place[at])
        first, big = starts[group], (size > FEW)[group]
        rows = done[group] & (size > 1)[group]
        yield "held", (key[rows], h[rows], place[rows], big[rows])
        rows = np.flatnonzero(done[group] & big & (first != np.arange(len(key))))
        yield "many", (key[rows], h[rows], place[rows], h[first[rows]], place[first[rows]])
        small = done[group] & ~big
        for step in range(1, FEW):
            i = np.flatnonzero(small[step:] & (group[step:] == group[:-step])) if len(key) > step else np.zeros(0, np.int64)
            if not len(i):
                break
            yield "few", (key[i + step], h[i + step], place[i + step], h[i], place[i])
        self.held = [x[:0] if done[-1] else x[~done[group]] for x in (key, h, place)]


def _in_line(pair: np.ndarray, x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Of matches sorted by pair and place: the pairs that have two in line, less than ``least`` words apart, that reach
    over REACH words."""
    got, apart = [np.zeros(0, np.int64)], REACH - K
    for step in range(1, min(apart + 1, len(pair))):
        dx, dy = x[step:] - x[:-step], y[step:] - y[:-step]
        got.append(pair[step:][(pair[step:] == pair[:-step]) & (dx >= apart) & (dx < least) & (np.abs(dx - dy) <= 2 + dx // 4)])
    return np.unique(np.concatenate(got))


def _with_keys(text: np.ndarray, place: np.ndarray, many: np.ndarray, least: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of shared seeds sorted by text and place: which of ``n`` texts have two in line, one of them of many texts; and
    which may hold a run of ``least`` words, all of it shared and some of it by many.  A negative place marks a seed that
    its text repeats, perhaps at places that aren't told; one lets a text pass as both."""
    whole = np.bincount(text[place < 0], minlength=n) > 0
    ok = whole.copy()
    for step in range(1, min(least, len(text))):
        d = place[step:] - place[:-step]
        ok[text[step:][(text[step:] == text[:-step]) & (d >= REACH - K) & (d < least) & (many[step:] | many[:-step])]] = True
    first = np.flatnonzero(np.concatenate(([True], (np.diff(text) != 0) | (np.diff(place) > WINDOW)))[: len(text)])
    if len(first):
        last = np.append(first[1:], len(text)) - 1
        whole[text[first][(place[last] - place[first] >= least - K - 2 * (WINDOW - 1)) & (np.add.reduceat(many.astype(np.int64), first) > 0)]] = True
    return ok, whole & ok


def _union(spans: list[tuple]) -> list[tuple]:
    """Disjoint unions of (start, end, other): overlapping spans become one, with the smallest other."""
    out: list[list] = []
    for s, e, o in sorted(spans):
        if out and s < out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], e), min(out[-1][2], o)
        else:
            out.append([s, e, o])
    return [tuple(x) for x in out]


def repeated_passages(docs: DataFrame, least: int = 50, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start_word, end_word, n_words, other_id, group_id): a row for each passage of ``least`` words or more of a
    row that repeats, exactly or nearly, in another row; rows without such passages are left out.

    Ids are whole numbers.  Where a row is linked and covered already, no further partner is asked for, so the ends of a
    fuzzy passage are those of the partners read.  Positions count the text's words (letters, digits, anything beyond ASCII; A-Z lower-cased).  ``other_id`` is a row
    that has the passage too; ``group_id`` is the smallest id among the rows linked by passages, over any number of
    links.  Overlapping passages of a row are one row; equal texts of ``least`` words or more repeat as a whole.

    Null, empty and short texts have no passages; rows that repeat repeat as equal texts; rows with a null id can't be
    named and are left out; an empty table gives no rows.
    """
    rows = need(docs, id_col, text_col).where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keyed = rows.select("id", F.xxhash64("text").alias("h"), "text")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = np.asarray(b.column(0))
            for lo, hashes, n in hashed(b.column(1)):
                long = n >= least
                s, at, often, text = seeds_of_texts(hashes[np.repeat(long, n)], n[long])
                if not len(s):
                    continue
                order = np.lexsort((s, text))  # the first place of a text's seed stays first
                s, at, often, text = s[order], at[order], often[order], text[order]
                first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (text[1:] != text[:-1]))))
                times = np.add.reduceat(1 + often.astype(np.int64), first)
                at = np.where(times > 1, -1 - at[first], at[first])  # repeated ones are marked
                yield pa.RecordBatch.from_arrays([pa.array(s[first]), pa.array(hs[lo + np.flatnonzero(long)[text[first]]]), pa.array(at.astype(np.int32))], names=["seed", "h", "pos"])

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, none = Groups(), np.zeros(0, np.int64)
        for batch in _and_none(batches):
            cols = [none] * 3 if batch is None else [np.asarray(c).astype(np.int64) for c in batch.columns]
            for kind, (key, h, at, *rest) in groups.add(*cols, last=batch is None):
                n = len(key)
                if not n:
                    continue
                if kind == "held":  # a shared seed of a text
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.nulls(n, pa.int64()), pa.array(at.astype(np.int32)), pa.nulls(n, pa.int32()), pa.array(key), pa.array(rest[0])], names=names)
                    continue
                other, at, other_at = rest[0], np.where(at < 0, -1 - at, at), np.where(rest[1] < 0, -1 - rest[1], rest[1])
                swap = h < other
                ends = np.maximum(h, other), np.minimum(h, other), np.where(swap, other_at, at).astype(np.int32), np.where(swap, at, other_at).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*map(pa.array, ends), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names=names)

    names = ["a", "b", "at_a", "at_b", "seed", "heavy"]
    members = materialise(keyed.select("id", "h"), "members")
    classes = materialise(members.groupBy("h").agg(F.min("id").alias("least_id"), F.max("id").alias("most_id"), F.count(F.lit(1)).alias("copies")), "classes")
    found = keyed.select("h", "text").mapInArrow(seeds, "seed long, h long, pos int").repartition("seed").sortWithinPartitions("seed", "h")
    ties = materialise(found.mapInArrow(tied, "a long, b long, at_a int, at_b int, seed long, heavy boolean"), "ties")

    def in_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            pair = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
            flat = lists.flatten()
            x, y = np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(np.int64)
            order = np.lexsort((y, x, pair))
            yield b.select(["a", "b"]).take(pa.array(_in_line(pair[order], x[order], y[order], least)))

    # a row a seed that the two texts share: at most as many as the shorter text has
    lines = ties.where("b is not null").groupBy("a", "b").agg(F.collect_list(F.struct("at_a", "at_b")).alias("at")).where(F.size("at") >= 2)
    lines = lines.mapInArrow(in_line, "a long, b long")

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            text = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
            at, many, seed = (np.asarray(c) for c in lists.flatten().flatten())
            order = np.lexsort((at, text))
            text, at, many, seed = text[order], at[order], many[order], seed[order]
            ok, whole = _with_keys(text, at.astype(np.int64), many, least, b.num_rows)
            cuts = pa.array(np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32))
            cols = [b.column(0), *(pa.ListArray.from_arrays(cuts, pa.array(c)) for c in (seed, at, many)), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "seeds", "places", "many", "whole"]).filter(pa.array(ok))

    # the texts with two shared seeds in line, one of which many texts hold, or that repeat one: a row a seed of a text
    shared = ties.where("seed is not null").groupBy(F.col("a").alias("h")).agg(F.collect_list(F.struct("at_a", "heavy", "seed")).alias("seeds"))
    kinds = "h long, seeds array<long>, places array<int>, many array<boolean>"
    shared = materialise(shared.where(F.exists("seeds", lambda x: x["heavy"] | (x["at_a"] < 0))).mapInArrow(with_keys, f"{kinds}, whole boolean"), "shared")

    def texts_of(h: DataFrame) -> DataFrame:
        """(h, text) of the classes asked for."""
        asked = classes.join(h, "h", "left_semi").select("h", F.col("least_id").alias("id"))
        return join_counted(keyed, materialise(asked, "asked"), ["id", "h"]).groupBy("h").agg(F.first("text").alias("text"))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, hs = [], b.column(0).to_pylist()
            for lo, all_hashes, n in hashed(b.column(3)):
                all_s, all_at, _, text = seeds_of_texts(all_hashes, n)
                cuts, of = [0, *np.cumsum(n).tolist()], np.searchsorted(text, np.arange(len(n) + 1)).tolist()
                for i in range(len(n)):
                    hashes, s, at = all_hashes[cuts[i] : cuts[i + 1]], all_s[of[i] : of[i + 1]], all_at[of[i] : of[i + 1]]
                    seeds, many = np.asarray(b.column(1)[lo + i].values), np.asarray(b.column(2)[lo + i].values)
                    order = np.argsort(seeds)
                    seeds, many = seeds[order], many[order]
                    place = np.minimum(np.searchsorted(seeds, s), len(seeds) - 1)
                    got = seeds[place] == s
                    out.append((hs[lo + i], shared_runs(hashes, at, got, least), s[got], at[got].astype(np.int32), many[place[got]]))
            kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["h", "runs", "seeds", "places", "many"])

    # texts that repeat a seed, or may hold a run, are read again; of the others all shared seeds are told
    held = shared.where("whole").join(texts_of(shared.where("whole").select("h")), "h").select("h", "seeds", "many", "text")
    held = held.mapInArrow(hold, "h long, runs array<long>, seeds array<long>, places array<int>, many array<boolean>")
    held = materialise(held.unionByName(shared.where("not whole").select("h", F.lit(None).cast("array<long>").alias("runs"), "seeds", "places", "many")), "held")
    # a row a run of a text: all that have it are tied to one
    runs = held.select("h", F.explode("runs").alias("run")).withColumn("b", F.min("h").over(Window.partitionBy("run")))
    runs = runs.where("h <> b").select(F.col("h").alias("a"), "b")

    def read(pairs: DataFrame) -> DataFrame:
        """(a, b, s, e, t, f, na, nb): the passages, and the words of the texts, of the pairs (a, b, at), where ``at`` holds (start, end) in a, (start, end) in b of places to begin at, if any."""
        sides = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct()
        texts = materialise(texts_of(sides), "texts")
        full = hot_join(pairs.withColumnRenamed("a", "h"), texts, "h", F.col("b")).select(F.col("h").alias("a"), F.col("b").alias("h"), "at", F.col("text").alias("ta"))
        full = hot_join(full, texts, "h", F.col("a"), counted=pairs.withColumnRenamed("b", "h")).select("a", F.col("h").alias("b"), "ta", F.col("text").alias("tb"), "at")
        return materialise(full.mapInArrow(aligned, "a long, b long, s long, e long, t long, f long, na long, nb long"), "passages")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, tuple] = {}
        held = 0

        def kept_text(h: int, t: pa.Scalar) -> tuple:
            nonlocal held
            got = memo.get(h)
            if got is None:
                if held > KEPT_WORDS:
                    memo.clear()
                    held = 0
                ws = words(t.as_py())
                hashes = mixed(ws)
                s, at, often = _seeds(hashes)
                repeats = often.any() or len(np.unique(s)) < len(s)
                got = memo[h] = ws, (s, at), runs_of(hashes, least) if repeats else None
                held += len(ws)
            return got

        for batch in batches:
            out = []
            for a, b, ta, tb, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                (wa, sa, ra), (wb, sb, rb) = kept_text(a, ta), kept_text(b, tb)
                got = [x[:4] for x in passages(wa, wb, chain(common_runs(sa, sb)), least, similarity)]
                for i, j, k, n in zip(*[iter(at or ())] * 4, strict=True):
                    got += [x[:4] for x in align(wa, wb, [(i, k, K), (j - K, n - K, K)], least, similarity)]
                if ra is not None and rb is not None:  # seeds are matched with their first places only: all equal runs, too
                    got += equal_runs(ra, rb, least) + [(t, f, s, e) for s, e, t, f in equal_runs(rb, ra, least)]
                out += [(a, b, *x, len(wa), len(wb)) for x in sorted(set(got))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["a", "b", "s", "e", "t", "f", "na", "nb"])

    hits = read(materialise(lines.unionByName(runs).distinct().withColumn("at", F.lit(None).cast("array<int>")), "pairs"))
    roots = materialise(connected_components(hits.select("a", "b")).withColumnRenamed("node", "h"), "roots")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "h", "start", "end", "before", "after", "root", "covered"]
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths()).cumsum()
            cuts = [0, *(np.flatnonzero(np.diff(sizes // ROWS)) + 1).tolist(), batch.num_rows]
            for b in (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False)):
                h, root = np.asarray(b.column(0)), np.asarray(b.column(4))
                text = np.repeat(np.arange(b.num_rows), np.asarray(b.column(1).value_lengths()))
                seeds, places, many = (np.asarray(c.flatten()) for c in b.columns[1:4])
                places = places.astype(np.int64)
                key, i, end, before, after = in_line_keys(text, seeds, places, many, least)
                start, text = places[i], text[i]
                lo, hi = [-1], [-1]
                for n, spans in enumerate(b.column(5).to_pylist()):
                    for s, e, _ in _union([(x["start"], x["end"] + 1, 0) for x in spans or ()]):  # spans that meet are one
                        lo.append((n << 32) + s)
                        hi.append((n << 32) + e - 1)
                covered = end + (text << 32) <= np.array(hi)[np.searchsorted(np.array(lo), start + (text << 32), side="right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, h[text], start.astype(np.int32), end.astype(np.int32), before, after, root[text], covered)], names=names)

    # a row a key of a text: the keys whose texts aren't all linked and covered there, but for those within a longer one
    mine = hits.select(F.col("a").alias("h"), F.col("s").alias("start"), F.col("e").alias("end"))
    mine = mine.unionByName(hits.select(F.col("b").alias("h"), F.col("t").alias("start"), F.col("f").alias("end")))
    mine = mine.groupBy("h", "start").agg(F.max("end").alias("end")).groupBy("h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    of_key = held.join(roots, "h", "left").join(mine, "h", "left").select("h", "seeds", "places", "many", F.coalesce("root", "h").alias("root"), "spans")
    of_key = of_key.mapInArrow(keys, "key long, h long, start int, end int, before long, after long, root long, covered boolean")
    w = Window.partitionBy("key")
    same = lambda c: (F.min(c).over(w) == F.max(c).over(w)) & (F.min(c).over(w) != 0)
    of_key = of_key.select("*", F.count(F.lit(1)).over(w).alias("n"), (same("before") | same("after")).alias("inner"), ((F.min("root").over(w) != F.max("root").over(w)) | ~F.min("covered").over(w)).alias("open"), (F.min("h").over(w) != F.max("h").over(w)).alias("several"))
    of_key = materialise(of_key.where("open and several and not inner").select("key", "h", "start", "end", "root", "covered", "n"), "open")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for h, places, t in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                ws = mixed(words(t.as_py()))
                ws = (ws >> np.uint64(40)).astype(np.uint16) | np.uint16(1)
                for x in places.as_py():
                    rows.append((x["key"], h, x["start"], x["end"], x["root"], x["covered"], x["n"], around(ws, x["start"], x["end"], least)))
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), near_kinds, strict=True)], names=near_names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), near_kinds, strict=True)], names=near_names)

    near_names = ["key", "h", "start", "end", "root", "covered", "n", "near"]
    near_kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()
    places = of_key.groupBy("h").agg(F.collect_list(F.struct("key", "start", "end", "root", "covered", "n")).alias("places"))
    near = places.join(texts_of(of_key.select("h").distinct()), "h").select("h", "places", "text")
    near = near.mapInArrow(windows, "key long, h long, start int, end int, root long, covered boolean, n long, near binary")
    # blocks of a key's texts, each with each
    near = near.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = near.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "h", "start", "end", "root", "covered", "block", "near")
    near = near.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def linked_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in _and_none(batches):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            key, lo, hi, h, start, end, root = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "h", "start", "end", "root"))
            covered, block = table.column("covered").to_numpy(), table.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1).tolist()]
            rest = table.slice(cuts[-1])
            if batch is None:
                cuts.append(table.num_rows)
            bits, out = table.column("near").to_pylist(), []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j - i < 2:
                    continue
                for x, y in linked(h[i:j], root[i:j], covered[i:j], block[i:j] if lo[i] != hi[i] else None, bits[i:j], least, similarity):
                    x, y = (x + i, y + i) if h[x + i] > h[y + i] else (y + i, x + i)
                    out.append((h[x], h[y], [start[x], end[x], start[y], end[y]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["a", "b", "at"])

    further = near.mapInArrow(linked_near, "a long, b long, at array<int>")
    further = materialise(further.groupBy("a", "b").agg(F.flatten(F.collect_set("at")).alias("at")), "further")
    if further.count():
        found_now = read(further)
        hits = hits.unionByName(found_now)
        edges = roots.select(F.col("h").alias("a"), F.col("root").alias("b")).unionByName(found_now.select("a", "b"))
        roots = materialise(connected_components(edges).withColumnRenamed("node", "h"), "roots")
    ids = classes.select("h", "least_id")
    # each text's passages with an id that has them too
    mine = hits.select(F.col("a").alias("h"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("b").alias("other"), F.col("na").alias("n"))
    theirs = hits.select(F.col("b").alias("h"), F.col("t").alias("start"), F.col("f").alias("end"), F.col("a").alias("other"), F.col("nb").alias("n"))
    # one row a start and text: at most as many as it has words
    found_at = mine.unionByName(theirs).join(ids.withColumnsRenamed({"h": "other", "least_id": "other_id"}), "other")
    found_at = found_at.groupBy("h", "start").agg(F.max("end").alias("end"), F.min("other_id").alias("other_id"), F.first("n").alias("n"))
    # equal texts: the whole text, with its first copy (the first copy: with its last)
    whole = texts_of(classes.where("copies > 1").select("h")).select("h", F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long").alias("n")).where(F.col("n") >= least)
    whole = whole.select("h", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.lit(None).cast("long").alias("other_id"), "n")
    per_class = found_at.unionByName(whole).groupBy("h").agg(F.collect_set(F.struct("start", "end", "other_id")).alias("spans"), F.first("n").alias("n"))
    grouped = classes.join(roots, "h", "left").select("h", "least_id", "most_id", F.coalesce("root", "h").alias("root"))
    least_of = grouped.groupBy("root").agg(F.min("least_id").alias("group_id"))
    per_text = per_class.join(salted_join(grouped, least_of, "root", F.col("h")), "h").select("h", "n", "spans", "least_id", "most_id", "group_id")
    named = salted_join(members, per_text, "h", F.col("id"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start_word", "end_word", "n_words", "other_id", "group_id"]
        for b in batches:
            out = []
            for i, n, spans, lo, hi, group in zip(*(c.to_pylist() for c in b.columns), strict=True):
                copy = hi if i == lo else lo
                for s, e, o in _union([(x["start"], x["end"], copy if x["other_id"] is None else x["other_id"]) for x in spans]):
                    out.append((i, s, e, n, o, group))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    got = named.select("id", "n", "spans", "least_id", "most_id", "group_id").mapInArrow(merged, "id long, start_word long, end_word long, n_words long, other_id long, group_id long")
    return got.withColumnRenamed("id", id_col)
