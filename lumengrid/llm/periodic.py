"""Periodic runs in the words of a text, by longest common extensions in suffix trees.

A run is a stretch with smallest period q, at least twice q long, that no neighbouring word extends. Each run
holds its root's Lyndon rotation: for the words' order or the reverse one, the longest Lyndon word that begins
at some word of the run is as long as its period. So each word gives two candidates, found by the next smaller
suffix. A candidate is extended to both sides by two extensions in constant time: the depth of the lowest common
ancestor of two leaves, in Ukkonen's tree of the words for the right side and in that of the reversed words for
the left, by range minima over Euler tours.

`runs` only has those of at least max(LEAST, TIMES * q) words. In such a run every three words from the second
period on have been seen one period before. A stretch of the text where that can't be so, for any period that the
stretch has room for, can't be part of one; trees are built over each of the remaining stretches, with the
neighbours that a run there can have, and over the whole text where all of it is periodic. Nothing is lost by
that.

Rows: a null text has no words; texts may be of any length (memory grows with the longest periodic stretch of a
text); rows that repeat are judged alike; an empty table gives an empty result. A carried column that has a
result's name is left out.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumengrid.llm.common import map_text

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 6, 4
#: White space that parts words, and what it is read as.
_SPACES = bytes.maketrans(bytes([9, 10, 11, 12, 13]), b" " * 5)


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: runs of anything but space and the ASCII controls 9 to 13."""
    return [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ") if w]


class SuffixTree:
    """Ukkonen's tree of a list of numbers from 1, ended by 0, with leaves in order and constant-time ancestors."""

    def __init__(self, numbers: list[int]):
        self.text = [*numbers, 0]
        self._build()
        self._tour()

    def _build(self) -> None:
        text, n = self.text, len(self.text)
        self.wide = wide = max(text) + 1
        self.start, self.end, link, self.child = array("q", [0]), array("q", [0]), array("q", [0]), {}
        start, end, child = self.start, self.end, self.child
        node = edge = length = waiting = 0
        for i in range(n):
            symbol, waiting, last = text[i], waiting + 1, 0
            while waiting:
                if not length:
                    edge = i
                at = node * wide + text[edge]
                below = child.get(at)
                if below is None:
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    child[at] = len(start) - 1
                    if last:
                        link[last] = node
                    last = node
                else:
                    span = min(end[below], i + 1) - start[below]
                    if length >= span:
                        edge, length, node = edge + span, length - span, below
                        continue
                    if text[start[below] + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    middle = len(start)
                    start.append(start[below])
                    end.append(start[below] + length)
                    link.append(0)
                    child[at] = middle
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    child[middle * wide + symbol] = middle + 1
                    start[below] += length
                    child[middle * wide + text[start[below]]] = below
                    if last:
                        link[last] = middle
                    last = middle
                waiting -= 1
                if not node and length:
                    length, edge = length - 1, i - waiting + 1
                elif node:
                    node = link[node]

    def _tour(self) -> None:
        """Leaves in order, and for each the depth of the lowest ancestor that it shares with the next one."""
        n, wide = len(self.text), self.wide
        below: dict[int, list[int]] = {}
        for at in sorted(self.child):
            below.setdefault(at // wide, []).append(self.child[at])
        self.below, self.depth = below, [0] * len(self.start)
        tour, first, order = [], [0] * n, []
        stack = [(0, 0)]
        while stack:
            node, k = stack.pop()
            tour.append(self.depth[node])
            mine = below.get(node)
            if mine is None:
                first[n - self.depth[node]] = len(tour) - 1
                order.append(n - self.depth[node])
            elif k < len(mine):
                stack.append((node, k + 1))
                child = mine[k]
                self.depth[child] = self.depth[node] + self.end[child] - self.start[child]
                stack.append((child, 0))
        self.first, self.order = np.array(first), order
        self.minima = [np.array(tour)]
        while len(self.minima[-1]) > 1 << len(self.minima) - 1:
            row, step = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(row[:-step], row[step:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the texts from i and from j (not equal) go alike."""
        a, b = np.minimum(self.first[i], self.first[j]), np.maximum(self.first[i], self.first[j]) + 1
        level = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.minima[k][a[at]], self.minima[k][b[at] - (1 << k)])
        return out

    def ranks(self, reverse: bool = False) -> list[int]:
        """The place of each suffix in order, a suffix before those that it begins; or by the reverse order of numbers."""
        rank = [0] * len(self.text)
        if not reverse:
            for k, i in enumerate(self.order):
                rank[i] = k
            return rank
        stack, k, n = [0], 0, len(self.text)
        while stack:
            node = stack.pop()
            mine = self.below.get(node)
            if mine is None:
                rank[n - self.depth[node]] = k
                k += 1
            elif self.text[self.start[mine[0]]] == 0:
                stack += [*mine[1:], mine[0]]
            else:
                stack += mine
        return rank


def lyndon_lengths(ranks: list[int]) -> np.ndarray:
    """For each place, how long the longest Lyndon word from it is: up to the next smaller suffix."""
    n = len(ranks) - 1
    out, waiting = np.empty(n, np.int64), [n]
    for i in range(n - 1, -1, -1):
        while ranks[waiting[-1]] > ranks[i]:
            waiting.pop()
        out[i] = waiting[-1] - i
        waiting.append(i)
    return out


def runs_of(numbers: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(least, times * period) numbers, times being 2 or more."""
    n = len(numbers)
    ranked = {x: k for k, x in enumerate(sorted(set(numbers)), 1)}
    numbers = [ranked[x] for x in numbers]
    ahead, behind = SuffixTree(numbers), SuffixTree(numbers[::-1])
    place = np.arange(n)
    found: set[tuple[int, int, int]] = set()
    for reverse in (False, True):
        period = lyndon_lengths(ahead.ranks(reverse))
        i, q = place[(fits := place + period < n)], period[fits]
        right = ahead.common(i, i + q)
        left = np.zeros(len(i), np.int64)
        inner = i > 0
        left[inner] = behind.common(n - i[inner], n - i[inner] - q[inner])
        length = left + q + right
        good = length >= np.maximum(least, times * q)
        found.update(zip((i - left)[good].tolist(), length[good].tolist(), q[good].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(numbers: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches outside of which no run of at least max(least, times * period) words can lie, times being 3 or more.

    From the second period on a run repeats, one period q back, each of its threes of words: (times - 1) * q - 2 in a
    row or more, none seen last farther back than q. So a row of such threes has room for periods up to a third of
    its length, and those seen last farther back than that can't belong to it.
    """
    n = len(numbers)
    if n < least:
        return []
    wide = int(numbers.max()) + 1
    pairs = np.unique(numbers[:-1] * wide + numbers[1:], return_inverse=True)[1]
    threes = pairs[:-1] * wide + numbers[2:]
    order = np.argsort(threes, kind="stable")
    back = np.full(n - 2, n, np.int64)
    again = threes[order[1:]] == threes[order[:-1]]
    back[order[1:][again]] = (order[1:] - order[:-1])[again]
    kept = back < n
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate(([False], kept, [False]))))
        first, last = edges[::2], edges[1::2]
        room = (last - first + 2) // (times - 1)
        limit = np.zeros(n - 2, np.int64)
        limit[kept] = np.repeat(room, last - first)
        if not (drop := kept & (back > limit)).any():
            break
        kept &= ~drop
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(np.maximum(first - room, 0).tolist(), np.minimum(last + 2, n).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least max(LEAST, TIMES * period) words, by start, then period."""
    known: dict = {}
    numbers = [known.setdefault(w, len(known)) for w in words]
    found = []
    for a, b in stretches(np.array(numbers, np.int64)):
        found += [(a + start, length, q) for start, length, q in runs_of(numbers[a:b])]
    return found


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return [w for w, gone in zip(words, (np.cumsum(change[:-1]) > 0).tolist(), strict=True) if not gone]


def _greatest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | tuple[None, None, None]:
    """The run of greatest length / period; of equal ones that with the smallest start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best or (None, None, None)


def detect(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Runs of each text: what is carried, runs (arrays of start, length, period), the greatest, and the text without repeats.

    `collapsed` joins the words that stay by one space.
    """
    longs = T.ArrayType(T.LongType())
    outputs = [("n_runs", T.LongType()), ("runs", T.ArrayType(longs)), *((c, T.LongType()) for c in ("start", "length", "period", "exponent_milli")), ("collapsed", T.StringType())]

    def make() -> Callable[[list], list]:
        def judge(texts: list) -> list:
            rows = []
            for body in texts:
                words = words_of(body)
                found = runs(words)
                start, length, q = _greatest(found)
                kept = b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass")
                rows.append((len(found), [list(r) for r in found], start, length, q, None if q is None else 1000 * length // q, kept))
            return [list(c) for c in zip(*rows, strict=True)]

        return judge

    return map_text(df, text, make, outputs, [c for c in carry if c not in {n for n, _ in outputs}])
