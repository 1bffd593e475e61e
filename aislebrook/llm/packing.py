"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids, with an end id, are cut into whole windows and a rest. Rests stay whole
but for one document in some, whose rest is cut into pieces that level the windows: each
is half of what is left, within limits, so that some are large and few, and some small.
The pieces of a group of documents are then set against each other: every piece begins as a partial partition with one filled window; the two
partial partitions with the largest imbalance merge, the fullest window of one onto the
emptiest of the other, until one partition is left. Its windows are near-equal. Where
the fullest exceeds the capacity, the number of windows rises and the group is set anew.

A group is what one task gathers until its rests hold group_tokens ids, so a task's
memory is bounded, no key decides where a row goes, and nothing is shuffled.
"""

from __future__ import annotations

import heapq
from bisect import insort
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SLICE_BYTES, field, give_back, named, slices
from .wordtokens import encoder

GROUP_TOKENS = 1 << 19
# One document in this many gives its rest as pieces, of MOST_FILL ids down to LEAST_FILL.
FILL_EVERY = 8
MOST_FILL = 64
LEAST_FILL = 4
# Sequences a task may number, and so the share of an id that tells the task.
PER_TASK = 40

_total = itemgetter(0)


def _merged(a: list, b: list, windows: int) -> list:
    """Two partial partitions, windows in ascending order and empty ones left out: the
    fullest of one lies on the emptiest of the other."""
    if len(a) < len(b):
        a, b = b, a
    over = len(a) + len(b) - windows
    if over <= 0:
        if len(b) == 1:
            insort(a, b[0], key=_total)
            return a
        return sorted(a + b, key=_total)
    # The `over` smallest of a meet the largest of b that find no empty window.
    both = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[:over], reversed(b[:over]))]
    return sorted(both + a[over:] + b[over:], key=_total)


def difference(sizes: list[int], windows: int) -> list[tuple[int, tuple]]:
    """(total, tree of indexes) of each filled window after differencing `sizes`."""
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, _, b = heap[0]
        made = _merged(a, b, windows)
        imbalance = made[-1][0] - (made[0][0] if len(made) == windows else 0)
        heapq.heapreplace(heap, (-imbalance, i, made))
    return heap[0][2] if heap else []


def members(tree) -> list[int]:
    """The indexes in a window, ascending."""
    found, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo.extend(x)
        else:
            found.append(x)
    return sorted(found)


def partition(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes by window; no window exceeds the capacity, nor may any size."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        made = difference(sizes, windows)
        over = sum(max(0, total - capacity) for total, _ in made)
        if not over:
            return [members(tree) for _, tree in made]
        windows += max(1, over // capacity)


def halves(n: int, most: int, least: int) -> list[int]:
    """Lengths that add up to n: each is half of what is left, rounded down, but `most`
    at most and `least` at least; the last one is what is left."""
    made = []
    while n > 0:
        step = min(n, max(least, min(most, n // 2)))
        made.append(step)
        n -= step
    return made


def cuts(n: int, capacity: int, whole: bool, most: int = MOST_FILL, least: int = LEAST_FILL) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of the full windows of a document of n ids, and of its rest, in one
    piece if `whole`, else in pieces of `most` ids down to `least`."""
    windows, rest = divmod(n, capacity)
    pieces, start = [], windows * capacity
    for m in [rest] if whole and rest else halves(rest, most, least):
        pieces.append((start, m))
        start += m
    return [(i * capacity, capacity) for i in range(windows)], pieces


def pack(
    df: DataFrame,
    path: str,
    text: str = "text",
    key: str = "doc_id",
    capacity: int = 2048,
    end_id: int = 1,
    fill_every: int = FILL_EVERY,
    most_fill: int = MOST_FILL,
    least_fill: int = LEAST_FILL,
    group_tokens: int = GROUP_TOKENS,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per piece: the key column, start (ids of its document before it), length,
    token_ids (binary: little-endian unsigned 32-bit ids), doc_tokens (with the end id),
    sequence_id and offset in the sequence (gapless from 0), all longs but the ids.

    Every row's whole text is packed: a null or empty text is the end id alone, repeated
    rows are packed each, a null key stays null, an empty table gives no rows, other
    columns of df are ignored, whatever their names. Equal sizes keep the order in which
    the task read them, so a task that runs again gives the same sequences. slice_bytes of
    rows are encoded at a time: fewer take less memory and more time, and pack alike."""
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType)]
        + [field(n, T.BinaryType() if n == "token_ids" else T.LongType()) for n in ("start", "length", "token_ids", "doc_tokens", "sequence_id", "offset")]
    )
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode = encoder(path).encode
        sequence = TaskContext.get().partitionId() << PER_TASK
        whole: list[tuple] = []  # key, start, length, ids, doc_tokens, sequence, offset
        rests: list[tuple] = []  # key, start, length, ids, doc_tokens
        waiting = documents = 0

        def batch_of(rows):
            columns = list(zip(*rows))
            kinds = [key_type[0], pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

        def packed():
            nonlocal sequence
            rows = []
            for window in partition([r[2] for r in rests], capacity):
                offset = 0
                for i in window:
                    rows.append((*rests[i], sequence, offset))
                    offset += rests[i][2]
                sequence += 1
            rests.clear()
            return batch_of(rows)

        key_type = [None]
        for batch in batches:
            key_type[0] = batch.column(0).type
            for part in slices(batch, slice_bytes):
                give_back()  # what the slice before took is much of a worker's memory
                for k, ids in zip(part.column(0).to_pylist(), encode(part.column(1)).texts()):
                    ids += end
                    n = len(ids) // 4
                    windows, pieces = cuts(n, capacity, documents % fill_every > 0, most_fill, least_fill)
                    documents += bool(pieces)
                    for a, m in windows:
                        whole.append((k, a, m, ids[4 * a : 4 * (a + m)], n, sequence, 0))
                        sequence += 1
                    for a, m in pieces:
                        rests.append((k, a, m, ids[4 * a : 4 * (a + m)], n))
                        waiting += m
                    if waiting >= group_tokens:
                        yield packed()
                        waiting = documents = 0
                    if len(whole) >= 256:
                        yield batch_of(whole)
                        whole.clear()
        if rests:
            yield packed()
        if whole:
            yield batch_of(whole)

    return df.select(named(key), named(text)).mapInArrow(run, schema)
