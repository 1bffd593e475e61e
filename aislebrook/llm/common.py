"""What the operators share: column handling, Arrow passes over texts, fixed folds."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 8 << 20
# Texts whose ids are put together at a time.
TEXTS_AT_ONCE = 256

_REMEMBERED: dict[tuple, Any] = {}


def remembered(key: tuple, build: Callable[[], Any]):
    """The one vocabulary that a worker process remembers over batches and tasks;
    another one takes its place."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        gc.collect()
        give_back()
        _REMEMBERED[key] = build()
    return _REMEMBERED[key]


def forget() -> None:
    """Give back what a worker remembers of a stage that is over."""
    if _REMEMBERED:
        _REMEMBERED.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory to the system; the allocators keep what Python and Arrow free."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def named(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names) -> DataFrame:
    """df less the columns that have one of these names, in upper or lower case."""
    gone = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in gone]
    return df if len(kept) == len(df.columns) else df.select(*[named(c) for c in kept])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about `most` bytes, one row at least."""
    n = batch.num_rows
    step = max(1, min(n, int(n * most / max(1, batch.nbytes))))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def annotate(
    df: DataFrame, inputs: list[str], fields: list[T.StructField], compute: Callable | None, keep: list[str] | None = None, most: int = SLICE_BYTES, pieces: Callable | None = None
) -> DataFrame:
    """df (or its columns `keep`) with `fields` appended, which compute(*arrays of the
    input columns) returns as Arrow arrays, for about `most` bytes of rows at a time. Rows stay in their
    partition. A column of df with the name of a new field gives way to it, unless it
    is an input: then it is read first. pieces(batches, number of the first input's
    column) may cut the rows otherwise; it yields rows and the compute for them."""
    held = [f"in_{i}" for i in range(len(inputs))]
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in fields}]
    source = df.select(*[named(c) for c in carried], *[named(c).alias(h) for c, h in zip(inputs, held, strict=True)])
    schema = T.StructType([df.schema[c] for c in carried] + fields)
    n = len(carried)
    names = [f.name for f in schema]

    def run(batches):
        cut = ((part, compute) for batch in batches for part in slices(batch, most)) if pieces is None else pieces(batches, n)
        for part, computed in cut:
            made = computed(*[part.column(n + i) for i in range(len(held))])
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + made, names=names)

    return source.mapInArrow(run, schema)


def field(name: str, kind: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, kind, nullable)


def utf8(values: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, nulls as empty texts."""
    return [b"" if x is None else x for x in values.cast(pa.binary()).to_pylist()]


class Ragged:
    """Packed ids of many texts whose parts come from a table of known parts: the parts
    of all texts as codes, the ids of each code as bytes."""

    def __init__(self, codes: np.ndarray, edges: np.ndarray, ids: list[bytes]):
        """codes[edges[i]:edges[i+1]] are the parts of text i."""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        each = size[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        self.edges = ends[edges]
        self._made = (codes, edges, each, ends, size, ids)

    def counts(self) -> np.ndarray:
        return np.diff(self.edges)

    def texts(self) -> list[bytes]:
        codes, edges, each, ends, size, ids = self._made
        flat = np.frombuffer(b"".join(ids), "<u4")
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        made: list[bytes] = []
        for i in range(0, len(edges) - 1, TEXTS_AT_ONCE):
            part = edges[i : i + TEXTS_AT_ONCE + 1]
            some = slice(part[0], part[-1])
            at = np.repeat(first[codes[some]] - ends[some], each[some])
            at += np.arange(ends[part[0]], ends[part[-1]])
            whole = flat[at].tobytes()
            bounds = (4 * (ends[part] - ends[part[0]])).tolist()
            made += [whole[a:b] for a, b in zip(bounds, bounds[1:])]
        return made


def fold(key: Column, parts: int) -> Column:
    """crc32 of a key's text, modulo parts: a split that no partitioning changes."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % parts
