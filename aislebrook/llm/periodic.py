"""Runs of periodic words, found by a suffix automaton with link-cut access.

Words are appended one by one to a suffix automaton. The tree of its suffix links holds,
for every state, where its strings ended last: states that ended last at one place form
a path segment, and a link-cut tree keeps each segment as one splay tree with one colour.
Appending word i walks from the new state to the root (the access), segment by segment:
a segment of colour e whose deepest state on the walk has length L says that the longest
string to end at both e and i has L words. Where i - e = L, two equal strings of i - e
words lie side by side, and the words before them differ: this square is where the run
of period i - e begins, and each run begins there once. It is extended to the right word
by word. The walk then recolours itself as one segment of colour i, in amortised
logarithmic time.

A run of 2g words or more, and of two periods, repeats every one of its windows of g
words at the distance of its period. So words that no repeated window covers are in no
run, and the automaton reads the stretches between them, one by one; windows are compared by hash,
and a collision only leaves a word in.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, field, forget, utf8

# Least number of words in a run.
LEAST = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)
RUN = T.StructType([field("start", T.LongType()), field("length", T.LongType()), field("period", T.LongType())])


def squares(ids: list[int]) -> list[tuple[int, int]]:
    """(start, period) of the first square of every run of at least two periods in ids,
    whatever its length; the period is the smallest."""
    # State 0 is none, state 1 the root of the automaton.
    size, link, step = [0, 0], [0, 0], [{}, {}]
    # Splay trees: left, right and parent inside a segment; above the segment; its colour.
    left, right, parent, above, colour = [0, 0], [0, 0], [0, 0], [0, 0], [-1, -1]

    def up(x, p):
        g = parent[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            parent[b] = p
        parent[p] = x
        parent[x] = g
        if not g:
            above[x] = above[p]
            colour[x] = colour[p]
        elif left[g] == p:
            left[g] = x
        else:
            right[g] = x

    def splay(x):
        p = parent[x]
        while p:
            g = parent[p]
            if g:
                if (left[g] == p) == (left[p] == x):
                    up(p, g)
                else:
                    up(x, p)
                    p = g
            up(x, p)
            p = parent[x]

    def state(n, steps):
        size.append(n)
        link.append(0)
        step.append(steps)
        left.append(0)
        right.append(0)
        parent.append(0)
        above.append(0)
        colour.append(-1)
        return len(size) - 1

    found = []
    tail = 1
    for i, c in enumerate(ids):
        new, p = state(i + 1, {}), tail
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        x = 1
        if p:
            x = q = step[p][c]
            if size[p] + 1 != size[q]:
                # The split state joins the segment of q, right above it.
                x = state(size[p] + 1, step[q].copy())
                link[x] = link[q]
                while p and step[p].get(c) == q:
                    step[p][c] = x
                    p = link[p]
                splay(q)
                b = left[x] = left[q]
                if b:
                    parent[b] = x
                left[q] = x
                parent[x] = q
                link[q] = x
        link[new] = x
        walked = new
        above[new] = x
        while x:
            if parent[x]:
                splay(x)
            e = colour[x]
            if size[x] == i - e:
                found.append((i + 1 - 2 * size[x], size[x]))
            b = right[x]
            if b:  # what lies deeper off the walk stays as it was
                parent[b] = 0
                above[b] = x
                colour[b] = e
            right[x] = walked
            parent[walked] = x
            walked = x
            x = above[x]
        colour[walked] = i
        splay(new)
        tail = new
    return found


def stretches(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(begin, end) of the parts of ids outside of which no run of `least` ids can lie."""
    window = max(1, least // 2)
    todo, done = [(0, len(ids))], []
    while todo:
        a, b = todo.pop()
        n = b - a - window + 1
        if b - a < max(2, least) or n < 2:
            continue
        some = ids[a:b].astype(np.uint64)
        h = some[:n].copy()
        for k in range(1, window):
            h *= _ODD
            h += some[k : k + n]
        ordered = np.sort(h)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            continue
        at = np.flatnonzero(np.isin(h, twice))
        cover = np.zeros(b - a + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
        edge = np.flatnonzero(np.diff(np.cumsum(cover) > 0, prepend=False, append=False))
        parts = [(a + int(x), a + int(y)) for x, y in zip(edge[::2], edge[1::2])]
        if parts == [(a, b)]:
            done.append((a, b))
        else:
            todo += parts
    return sorted(done)


def runs_of(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` words and two periods, by
    start, then period."""
    if len(words) < max(2, least):
        return []
    number = defaultdict(itertools.count().__next__)
    ids = np.fromiter((number[w] for w in words), np.int64, len(words))
    found = []
    for a, b in stretches(ids, least):
        part = ids[a:b].tolist()
        n = b - a
        for start, period in squares(part):
            end = start + 2 * period
            while end < n and part[end] == part[end - period]:
                end += 1
            if end - start >= least:
                found.append((a + start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_of(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one blank."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = list(itertools.compress(words, keep.tolist()))
    return b" ".join(words)


def find_runs(df: DataFrame, text: str = "text", least: int = LEAST, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with n_words (long), runs (array of start, length, period:
    long, by start, then period) and collapsed (the text with one period of each run left).

    Words are what lies between blanks, tabs and line breaks, of the whole text. A run is
    as long as it can be, holds at least `least` words and two periods, and its period is
    the smallest; runs may overlap. Null and empty texts have no words, no runs and an
    empty collapsed text. Rows are judged each on their own, repeated ones alike; an empty
    table stays empty; columns of df with the new names are replaced."""

    def compute(texts):
        forget()
        counts, cuts, rows, rest = [], [0], [], []
        for x in utf8(texts):
            words = x.split()
            runs = runs_of(words, least)
            counts.append(len(words))
            rows += runs
            cuts.append(len(rows))
            rest.append(collapsed_of(words, runs))
        columns = np.array(rows, np.int64).reshape(-1, 3)
        made = pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(3)], names=RUN.names)
        return [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), made), pa.array(rest, pa.binary()).cast(pa.string())]

    new = [field("n_words", T.LongType()), field("runs", T.ArrayType(RUN)), field("collapsed", T.StringType())]
    return annotate(df, [text], new, compute, keep)


def longest(runs: Column) -> Column:
    """Of an array of runs that with the greatest length, ties to the smallest start, then
    period; null if there is none."""
    key = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(key)


def listing(runs: Column) -> Column:
    """`start,length,period` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
