"""Byte-level BPE, encoding and decoding, with a rank queue on a hierarchical bitmap.

Ranks come from a public rank file, whose path is a parameter. A text is cut by the
pattern; every match is encoded on its own, as the file's own library does: a match
that is itself in the vocabulary is one id, any other one starts as bytes, and the
pair of neighbours with the lowest rank, leftmost first, merges until no pair is known.

The queue has one bucket of positions for each rank that is waiting, and three levels
of 64-bit words that tell which buckets hold something; find-first-set on each level
gives the next rank. Tokens are a linked list over byte positions. A merge changes the
ranks of the two pairs around it; their old entries stay in their buckets and are
skipped when they come up. One queue works on all new matches of a batch together, so
a match of a million bytes costs per byte what a short one does.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Ragged, annotate, field, remembered

# Matches that a worker remembers before it begins anew.
REMEMBERED = 600_000
# Pairs of tokens that it remembers.
PAIRS = 500_000
# White space of any kind beside a blank or line end.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOUCHING = rf"{_WHITE}[ \n]|[ \n]{_WHITE}"
# Letters that every edition of Unicode has, and marks: after a blank, a match each.
LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
MARKS = ".,;:!?"
# Bytes of texts worked on at a time.
SLICE = 4 << 20
# A longer one is encoded whenever it comes up, and not remembered.
LONGEST_REMEMBERED = 64


class RankQueue:
    """Waiting (rank, position) entries; the lowest rank first."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int] | None] = [None] * ranks
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        held = self.buckets[rank]
        if held is not None:
            held.append(position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def first(self) -> int:
        """The lowest rank that waits, -1 if none."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        return b << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        held, self.buckets[rank] = self.buckets[rank], None
        low, mid = rank >> 6, rank >> 12
        self.low[low] &= ~(1 << (rank & 63))
        if not self.low[low]:
            self.mid[mid] &= ~(1 << (low & 63))
            if not self.mid[mid]:
                self.top &= ~(1 << mid)
        return held


class Codec:
    """Encoder and decoder for one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        # Fixed value: the pattern whose matches hold a blank at their beginning only.
        self.blanks = pattern == r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.words = {r: w for w, r in self.ranks.items()}
        self.joined: dict[int, int] = {}
        self.ones = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.twos = np.full(1 << 16, -1, np.int64)
        for w, r in self.ranks.items():
            if len(w) == 2:
                self.twos[w[0] << 8 | w[1]] = r
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.pieces: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece. Pieces lie in one buffer with a gap between them."""
        queue, buckets = self.queue, self.queue.buckets
        push = queue.push
        data = b"\0".join(pieces) + b"\0"
        size = len(data)
        after = list(range(1, size + 2))
        before = list(range(-1, size))
        ends = np.cumsum([len(x) + 1 for x in pieces]) - 1
        place = np.frombuffer(data, np.uint8).astype(np.int64)
        token = self.ones[place]
        token[ends] = -1
        token = token.tolist()
        start = np.append(self.twos[place[:-1] << 8 | place[1:]], [-1, -1])
        start[ends] = -1
        start[ends - 1] = -1  # a piece's last byte; pieces are not empty
        pair = start.tolist()
        for end in ends.tolist():
            before[end + 1] = -1
        order = np.argsort(start, kind="stable")
        order = order[np.searchsorted(start[order], 0) :]
        cuts = np.flatnonzero(np.diff(start[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            held = group.tolist()
            push(pair[held[0]], held[0])
            buckets[pair[held[0]]] += held[1:]
        joined, join = self.joined, self._join
        while (rank := queue.first()) >= 0:
            waiting = queue.take(rank)
            if len(waiting) > 1:
                waiting.sort()
            k = 0
            for i in waiting:
                k += 1
                if pair[i] != rank:
                    continue
                gone = after[i]
                end = after[i] = after[gone]
                before[end] = i
                token[i] = rank
                token[gone] = -2
                pair[gone] = -1
                new = -1
                right = token[end]
                if right >= 0:
                    key = rank << 20 | right
                    new = joined[key] if key in joined else join(key)
                    if new >= 0:
                        if (held := buckets[new]) is None:
                            push(new, i)
                        else:
                            held.append(i)
                pair[i] = new
                lower = 0 <= new < rank
                left = before[i]
                if left >= 0:
                    key = token[left] << 20 | rank
                    new = joined[key] if key in joined else join(key)
                    pair[left] = new
                    if new >= 0:
                        if (held := buckets[new]) is None:
                            push(new, left)
                        else:
                            held.append(left)
                        lower = lower or new < rank
                if lower:
                    for j in waiting[k:]:
                        push(rank, j)
                    break
        if len(joined) > PAIRS:
            joined.clear()
        ids = np.array(token[:size], np.int64)
        keep = ids != -2
        ids = ids[keep]
        edges = np.flatnonzero(ids == -1)
        packed = ids.astype("<u4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip([0, *(edges[:-1] + 1).tolist()], edges.tolist())]

    def _join(self, key: int) -> int:
        """The rank of two neighbours, -1 if their bytes are no token; remembered."""
        rank = self.joined[key] = self.ranks.get(self.words[key >> 20] + self.words[key & 0xFFFFF], -1)
        return rank

    def _packed(self, pieces: list[str]) -> dict[str, bytes]:
        """The packed ids of matches of the pattern."""
        memory = self.pieces
        ids = dict(zip(pieces, map(memory.get, pieces)))
        rest = []
        for p in [p for p, x in ids.items() if x is None]:
            b = p.encode()
            r = self.ranks.get(b)
            if r is None:
                rest.append((p, b))
            else:
                ids[p] = r.to_bytes(4, "little")
        if rest:
            made = dict(zip([p for p, _ in rest], self.merge([b for _, b in rest]), strict=True))
            if len(memory) + len(made) > REMEMBERED:
                memory.clear()
            memory.update((p, x) for p, x in made.items() if len(p) <= LONGEST_REMEMBERED)
            ids.update(made)
        return ids

    def encode(self, texts: pa.Array) -> Ragged:
        """Ids of each text of a string column as little-endian unsigned 32-bit integers;
        a null text has none.

        Where every blank and line end of a text stands between other characters, a match
        may begin with a blank but never reaches over one, and a line end is a match: both
        begin a part of their own. A text where they touch other white space is one part."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, TOUCHING) if self.blanks else pa.array([True] * len(texts))
        apart = pc.replace_substring(pc.if_else(whole, "", texts), "\n", " \n")
        parts = pc.split_pattern(apart, " ")
        coded = pc.dictionary_encode(parts.flatten())
        edges = parts.offsets.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        codes = coded.indices.to_numpy().astype(np.int64)
        # No blank precedes the first part of a text.
        alone = whole.to_numpy(zero_copy_only=False)
        first = coded.dictionary.take(pa.array(codes[edges[:-1]])).to_pylist()
        first = [texts[i].as_py() if alone[i] else first[i] for i in range(len(first))]
        codes[edges[:-1]] = len(coded.dictionary) + np.arange(len(first))
        return Ragged(codes, edges, self._units(coded.dictionary) + self._cut(first))

    def _units(self, units: pa.Array) -> list[bytes]:
        """The packed ids of parts that a blank precedes, or that begin with a line end.
        Most are a word and closing marks, which are two matches."""
        line = pc.starts_with(units, "\n")
        shown = pc.utf8_slice_codeunits(units, 1)
        shown = pc.if_else(line, shown, units)
        bare = pc.utf8_rtrim(shown, MARKS)
        simple = pc.match_substring_regex(bare, LATIN)
        out = np.empty(len(units), object)
        rest = pa.array(np.flatnonzero(~simple.to_numpy(zero_copy_only=False)))
        real = pc.binary_join_element_wise(pc.if_else(line, "", " "), units, "")
        out[rest.to_numpy()] = self._cut(real.take(rest).to_pylist())
        at = np.flatnonzero(simple.to_numpy(zero_copy_only=False))
        if not len(at):
            return out.tolist()
        word = pc.dictionary_encode(pc.binary_join_element_wise(pc.if_else(line, "", " "), bare, "").filter(simple))
        words = word.dictionary.to_numpy(zero_copy_only=False)
        ids = np.empty(len(words), object)
        packed = self._packed(words.tolist())
        ids[:] = [packed[w] for w in words]
        out[at] = ids[word.indices.to_numpy()]
        begins = np.flatnonzero(pc.and_(line, simple).to_numpy(zero_copy_only=False))
        end = self._cut(["\n"])[0]
        out[begins] = [end + x for x in out[begins].tolist()]
        size = pc.subtract(pc.utf8_length(shown), pc.utf8_length(bare)).to_numpy()
        marked = at[size[at] > 0]
        marks = [u[-n:] for u, n in zip(units.take(pa.array(marked)).to_pylist(), size[marked].tolist())]
        known = self._packed(list(set(marks)))
        out[marked] = [x + known[m] for x, m in zip(out[marked].tolist(), marks)]
        return out.tolist()

    def _cut(self, texts: list[str]) -> list[bytes]:
        """The packed ids of texts, cut by the pattern."""
        cut = [self.split(t) for t in texts]
        packed = self._packed(list(set().union(*cut))).__getitem__
        return [b"".join(map(packed, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    """The codec of a worker process; its memory lasts over batches and tasks."""
    return remembered((path, pattern), lambda: Codec(path, pattern))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, back: bool = False) -> DataFrame:
    """df (or its columns `keep`) with `token_ids` (binary: little-endian unsigned 32-bit
    ids) and `n_tokens` (long) of every whole text, and with `back` also `decoded`, as
    decode() gives it, without sending the ids to a second worker. A null text counts as
    empty and has no ids; repeated rows each get theirs; an empty table stays empty.
    Columns of these names in df are replaced, all others are kept."""

    def compute(texts):
        made = codec(path, pattern).encode(texts)
        ids = made.texts()
        columns = [pa.array(ids, pa.binary()), pa.array(made.counts(), pa.int64())]
        return columns + ([pa.array(map(codec(path, pattern).decode, ids), pa.binary())] if back else [])

    new = [field("token_ids", T.BinaryType()), field("n_tokens", T.LongType())] + ([field("decoded", T.BinaryType())] if back else [])
    return annotate(df, [text], new, compute, keep, SLICE)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """df with `decoded` (binary): the bytes that the ids stand for. Null ids give null;
    an id that the rank file lacks fails."""

    def compute(packed):
        c = codec(path, pattern)
        return [pa.array([None if x is None else c.decode(x) for x in packed.to_pylist()], pa.binary())]

    return annotate(df, [ids], [field("decoded", T.BinaryType())], compute)
