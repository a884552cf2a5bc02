"""Periodic runs of words by longest common extensions from suffix trees.

A run is a stretch of words with smallest period q, at least ``max(LEAST, TIMES * q)`` words long, that no neighbouring word
extends with that period.  Each document is numbered word by word and searched thus:

* Ukkonen's algorithm builds the suffix trees of the words and of their reversal, each in one pass;
* a walk around each tree keeps the depth of every turning point between neighbouring leaves (the Euler tour without its
  way down and up), and a sparse table of minima over these gives the depth of the lowest common ancestor of any two leaves,
  which is the longest common extension of two places, in constant time;
* the order of the leaves is the order of the suffixes.  The next smaller suffix of each place, in the order of the words
  and in the reverse order, ends its longest Lyndon word; every run holds such a word as root of its period;
* each root is extended to both sides by one extension forward and one backward; long enough ones are runs.

A word inside a run occurs ``TIMES`` times or more in it.  So words that occur less often in a stretch cannot be part of
a run there; stretches are cut at such words until none is left, which loses no run, and trees are built of what remains.

Work and memory of a document grow with its own length only (the tables by a logarithm); no document meets another, nothing
is shuffled, and a lost executor repeats its own rows.

Defined cases: null, empty and blank texts have no words and no runs, and collapse to the empty text; each row is taken by
itself, so repeated rows and null ids get the same results as any other; ties among the longest runs go to the smallest
start, then period; an empty table gives no rows; all other columns pass through, and those named like the result are
replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import text_of

#: A run has this many words, and this many times its period, at least.
LEAST = 6
TIMES = 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


class SuffixTree:
    """Suffix tree of numbers from 1 on, closed by a 0 that occurs nowhere else; node 0 is the root."""

    def __init__(self, symbols: list[int]):
        self.text = text = [*symbols, 0]
        self.size = size = len(text)
        width = max(text) + 1
        begin, end, link, parent = [0], [0], [0], [0]
        self.leaves = leaves = []  # the leaf of each suffix: leaves arise in the order of their suffixes
        child_of: dict[int, int] = {}
        node = edge = length = open_suffixes = 0
        for i, symbol in enumerate(text):
            open_suffixes += 1
            unlinked = 0
            while open_suffixes:
                if not length:
                    edge = i
                key = node * width + text[edge]
                child = child_of.get(key)
                if child is not None:
                    first = begin[child]
                    span = (end[child] if end[child] <= i else i + 1) - first
                    if length >= span:
                        edge, length, node = edge + span, length - span, child
                        continue
                    if text[first + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    inner = len(begin)
                    begin += (first, i)
                    end += (first + length, size)
                    link += (0, 0)
                    parent += (node, inner)
                    child_of[key] = inner
                    begin[child], parent[child] = first + length, inner
                    child_of[inner * width + text[first + length]] = child
                    child_of[inner * width + symbol] = inner + 1
                    leaves.append(inner + 1)
                    if unlinked:
                        link[unlinked] = inner
                    unlinked = inner
                else:
                    child_of[key] = len(begin)
                    leaves.append(len(begin))
                    begin.append(i)
                    end.append(size)
                    link.append(0)
                    parent.append(node)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                open_suffixes -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - open_suffixes + 1
        self.begin, self.end, self.parent = begin, end, parent

    def tour(self, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(rank of each suffix, depth of the turning point before each leaf), in the order of the symbols or its reverse.

        The closing 0 is least in both orders, so a prefix comes before what it begins.
        """
        begin, end, parent = self.begin, self.end, self.parent
        nodes = np.arange(1, len(begin))
        above = np.asarray(parent)[1:]
        first = np.asarray(self.text)[np.asarray(begin)[1:]]
        if reverse:
            first = np.where(first == 0, 0, first.max() + 1 - first)
        order = nodes[np.lexsort((-first, above))]  # greatest first: the walk takes them from the end of a stack
        cuts = np.searchsorted(above[order - 1], np.arange(len(begin) + 1))
        eldest = np.zeros(len(begin), dtype=bool)
        inner = np.flatnonzero(cuts[1:] > cuts[:-1])
        eldest[order[cuts[inner + 1] - 1]] = True
        order, cuts, eldest = order.tolist(), cuts.tolist(), eldest.tolist()
        depth = [0] * len(begin)
        seen, turns, turn, stack = [], [], 0, [0]
        while stack:
            node = stack.pop()
            if not eldest[node]:
                turn = depth[parent[node]]
            a, b = cuts[node], cuts[node + 1]
            if a == b:
                seen.append(node)
                turns.append(turn)
            else:
                depth[node] = depth[parent[node]] + end[node] - begin[node]
                stack += order[a:b]
        rank = np.empty(len(begin), dtype=np.int64)
        rank[seen] = np.arange(len(seen))
        return rank[self.leaves], np.asarray(turns, dtype=np.int32)


class Extensions:
    """Longest common extensions of pairs of places, by minima over the turning points of a tour."""

    def __init__(self, rank: np.ndarray, turns: np.ndarray):
        self.rank = rank
        self.tables = [turns]
        while (1 << len(self.tables)) <= len(turns):
            last, half = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For different places."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.tables[k]
            found[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return found


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word of each place ends: the next smaller suffix.  The closing suffix, the smallest, is left out."""
    ends = [0] * (len(rank) - 1)
    ranks, waiting = rank.tolist(), []
    for i, r in enumerate(ranks):
        while waiting and ranks[waiting[-1]] > r:
            ends[waiting.pop()] = i
        waiting.append(i)
    return np.asarray(ends, dtype=np.int64)


def runs_of(symbols: list[int], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of numbers from 1 on, by start, then period."""
    n = len(symbols)
    tree = SuffixTree(symbols)
    rank, turns = tree.tour()
    forward = Extensions(rank, turns)
    backward = Extensions(*SuffixTree(symbols[::-1]).tour())
    found = []
    for ranks in (rank, tree.tour(reverse=True)[0]):
        end = lyndon_ends(ranks)
        start = np.arange(n)
        period = end - start
        right = forward(start, end)
        left = np.zeros(n, dtype=np.int64)
        # Word i has place n - 1 - i in the reversal; the first word has nothing before it.
        left[1:] = backward(n - start[1:], n - end[1:])
        length = left + period + right
        long_enough = length >= np.maximum(least, times * period)
        found.append(np.stack([start - left, length, period], axis=1)[long_enough])
    every = np.unique(np.concatenate(found), axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def stretches(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """(start, end) of the stretches that can hold runs: each of their words occurs ``times`` times in them."""
    settled, open_ = [], [(0, len(words))]
    run = re.compile(rb"\x01{%d,}" % least)
    while open_:
        a, b = open_.pop()
        counts = Counter(words[a:b])
        often = {w for w, n in counts.items() if n >= times}
        if len(often) == len(counts):
            if b - a >= least:
                settled.append((a, b))
        elif often:
            flags = bytes(map(often.__contains__, words[a:b]))
            open_ += [(a + m.start(), a + m.end()) for m in run.finditer(flags)]
    return sorted(settled)


def find_runs(words: list, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of words, by start, then period."""
    found = [np.empty((0, 3), dtype=np.int64)]
    for a, b in stretches(words, least, times):
        numbers: dict = {}
        found.append(runs_of([numbers.setdefault(w, len(numbers) + 1) for w in words[a:b]], least, times) + [a, 0, 0])
    return np.concatenate(found)


def collapse(words: list, runs: np.ndarray) -> list:
    """The words less those that a run holds after its first period."""
    if not len(runs):
        return words
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


def detector(least: int = LEAST, times: int = TIMES):
    """Column function: text to (runs, collapsed text)."""

    @F.arrow_udf(FOUND)
    def detect(texts: pa.Array) -> pa.Array:
        per_row, collapsed = [], []
        for text in texts:
            # bytes.split parts at the same characters as the definition of words.
            words = text.as_buffer().to_pybytes().split()
            runs = find_runs(words, least, times)
            per_row.append(runs)
            collapsed.append(b" ".join(collapse(words, runs)).decode())
        every = np.concatenate([np.empty((0, 3), dtype=np.int64), *per_row])
        offsets = np.cumsum([0, *map(len, per_row)])
        runs = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], fields=list(RUN))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)
        return pa.StructArray.from_arrays([lists, pa.array(collapsed, pa.string())], names=["runs", "collapsed"])

    return detect


def with_runs(docs: DataFrame, text: Column | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """All rows and columns with ``runs`` (array of start, length, period) and ``collapsed`` (the text of the words kept)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in {"runs", "collapsed"}]
    given = text_of("text") if text is None else text
    return docs.select(*kept, detector(least, times)(given).alias("__found")).select(*kept, "__found.runs", "__found.collapsed")


def longest(runs: Column) -> Column:
    """The run with the greatest length, then the smallest start and period; null of no run."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
