"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters with one blank for every run of anything else. Character
n-grams of the order are counted per language over all training texts, and none is left
out. Lower orders use continuation counts, the highest one its own; counts of counts,
context totals and interpolated probabilities are Spark tables in the shared folder. The
probabilities, one column per language, reach the workers in parts of bounded size,
sorted by n-gram hash. The driver holds one part at a time. A worker keeps a model that
fits its allowance; of a larger one it gathers texts until what they need fills the
allowance, reads every part once for all of them, and keeps that. An n-gram that no
language has falls to the next order.

A text's language has the lowest cross-entropy per character. A share of the training
texts is not counted but calibrates: it gives each language the centre and spread of the
cross-entropy of its own texts, and the temperature that turns differences of
log-likelihood into a probability. Centre and spread are quantiles, read off histograms
over all calibration texts, so junk among them moves neither as long as it is less than a
fifth of a language's texts. Languages with few texts share one spread. A text is rejected
when its best cross-entropy lies too many deviations above what its language's texts have,
or when it has no letter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislebrook.sources.scratch import materialize

from .common import SLICE_BYTES, annotate, field, forget, named, slices, without

ORDER = 4  # four points of 16 bits are one 64-bit key
# Bytes of n-grams and costs in one part of a table, and in what a worker keeps of all
# tables; bytes of texts that one reading of the parts serves at most.
PART_BYTES = 32 << 20
HELD_BYTES = 128 << 20
GATHER_BYTES = 64 << 20
# Deviations above the median cross-entropy of a language's own texts.
MOST_DEVIATIONS = 8.0
# The deviation is read off at this share of the texts, which is so many normal deviations
# above the median.
UPPER_SHARE, UPPER_NORMAL = 0.8, 0.8416
# Languages with fewer calibration texts share the spread of all such languages.
LEAST_TEXTS = 30
# N-grams of all languages together that a task counts before it passes them on.
COUNTED = 1 << 21
# Steps of the histograms to the bit.
_STEPS = 64
UNKNOWN = "und"
_TEMPERATURES = np.round(np.geomspace(1e-3, 1.0, 25), 6)
_EDGE = 1
# Bytes of text worked on at a time.
_SLICE = 2 << 20


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point its lower-case letter in 16 bits, or a blank for what is no
    letter. Letters beyond 16 bits share the 6,400 private points."""
    points = np.full(0x110000, 32, np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            at = ord(low) if len(low) == 1 else i
            points[i] = at if at < 0x10000 else 0xE000 + at % 6400
    return points


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other as lower-case letters, other runs as one blank, a blank
    at either end of each: (points, begins, ends), where points[begins[i] : ends[i] + 1]
    is text i, and begins[i] == ends[i] - 1 means that it has no letter. Two texts meet
    in two blanks, which no n-gram of a single text has."""
    joined = "\0" + "\0".join(texts) + "\0"
    points = _folded()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points[np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])] = _EDGE
    blank = points == 32
    again = blank[1:] & (blank[:-1] | (points[:-1] == _EDGE))
    points = points[np.concatenate([[True], ~again])]
    last = (points[:-1] == 32) & (points[1:] == _EDGE)
    points = points[np.concatenate([~last, [True]])]
    edges = np.flatnonzero(points == _EDGE)
    points = np.repeat(points, 1 + (points == _EDGE))
    points[points == _EDGE] = 32
    count = np.arange(len(edges))
    return points, (edges + count + 1)[:-1], (edges + count)[1:]


def _keys(points: np.ndarray, at: np.ndarray | None, order: int) -> np.ndarray:
    """The last `order` points up to position at (or everywhere), 16 bits each."""
    if at is None:
        n = len(points) - order + 1
        key = np.zeros(max(0, n), np.uint64)
        for i in range(order if n > 0 else 0):
            key = key << np.uint64(16) | points[i : i + n]
        return key
    key = np.zeros(len(at), np.uint64)
    for i in range(order - 1, -1, -1):
        key = key << np.uint64(16) | points[at - i]
    return key


def _hash(key: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit keys."""
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(31))


def _counted(texts: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) over all rows of texts (lang, text); gram is the packed key."""

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang, keys, n):
            if lang in held:
                keys, back = np.unique(np.concatenate([held[lang][0], keys]), return_inverse=True)
                n = np.bincount(back, np.concatenate([held[lang][1], n])).astype(np.int64)
            held[lang] = (keys, n)

        def out(lang):
            keys, n = held.pop(lang)
            for i in range(0, len(keys), 1 << 16):
                some = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some.view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["lang", "gram", "n"]
                )

        forget()
        total = 0
        for batch in batches:
            for part in slices(batch, _SLICE):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by_lang.setdefault(lang, []).append(text)
                for lang, some in by_lang.items():
                    points, begins, ends = stream(some)
                    keys = _keys(points, None, order)
                    # The n-grams that begin and end in one text.
                    steps = np.zeros(len(points) + 1, np.int64)
                    np.add.at(steps, begins, 1)
                    np.add.at(steps, np.maximum(begins, ends - order + 2), -1)
                    keys = keys[(np.cumsum(steps) > 0)[: len(keys)]]
                    if len(keys):
                        total -= len(held[lang][0]) if lang in held else 0
                        add(lang, *np.unique(keys, return_counts=True))
                        total += len(held[lang][0])
                        while total > COUNTED:
                            most = max(held, key=lambda x: len(held[x][0]))
                            total -= len(held[most][0])
                            yield from out(most)
        for lang in list(held):
            yield from out(lang)

    made = texts.mapInArrow(run, "lang string, gram bigint, n bigint")
    return made.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """One order: hashes in ascending order and, for each, the bits of its last character
    by language. `start` tells for leading bits where to begin in the hashes."""

    hashes: np.ndarray
    costs: np.ndarray
    shift: int
    start: np.ndarray
    longest: int

    @classmethod
    def of(cls, keys: np.ndarray, costs: np.ndarray) -> Table:
        hashes = _hash(keys)
        by = np.argsort(hashes)
        hashes = hashes[by]
        bits = max(8, int(len(hashes)).bit_length() + 1)
        lead = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        start = np.searchsorted(lead, np.arange((1 << bits) + 1)).astype(np.int32)
        return cls(hashes, costs[by], 64 - bits, start, int(np.diff(start).max(initial=0)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, -1 where it is not."""
        wanted = _hash(keys)
        at = self.start[wanted >> np.uint64(self.shift)]
        last = len(self.hashes) - 1
        place = np.full(len(keys), -1, np.int32)
        rest = np.arange(len(keys)) if last >= 0 else np.empty(0, np.int64)
        for _ in range(self.longest):
            here = np.minimum(at, last)
            hit = self.hashes[here] == wanted
            place[rest[hit]] = here[hit]
            go = ~hit
            rest, wanted, at = rest[go], wanted[go], at[go] + 1
        return place


@dataclass
class Own:
    """A table of this worker, read as a shared one is."""

    value: Table


@dataclass
class Parts:
    """A table of any size, dealt by n-gram modulo the number of parts, each shared on its
    own. `held` tells whether a worker keeps its parts or gives each back when it is read."""

    shared: list[Broadcast | Own]
    langs: int
    held: bool

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys it has, the costs of those)."""
        hit = np.zeros(len(keys), bool)
        costs = np.zeros((len(keys), self.langs), np.float32)
        of = keys.view(np.int64) % len(self.shared)
        for i, part in enumerate(self.shared):
            at = np.flatnonzero(of == i)
            if not len(at):
                continue
            table = part.value
            place = table.find(keys[at])
            found = place >= 0
            hit[at[found]] = True
            costs[at[found]] = table.costs[place[found]]
            if not self.held:
                del table
                part.__dict__.pop("_value", None)
        return hit, costs[hit]


@dataclass
class Model:
    order: int
    langs: list[str]
    tables: list[Parts]  # by order, from 1
    contexts: list[Parts]  # by order: bits of the weight that a context gives the next order
    floor: np.ndarray  # bits of a character that no text has
    center: np.ndarray  # median of a language's own cross-entropies
    spread: np.ndarray  # squared deviations: between texts, and per character
    temperature: float = 1.0

    def cost(self, points: np.ndarray) -> np.ndarray:
        """Bits by language of every character but the first, each predicted from up to
        order - 1 before it."""
        n = len(points)
        out = np.zeros((n - 1, len(self.langs)), np.float32)
        todo = np.arange(1, n)
        for order in range(self.order, 0, -1):
            able = todo >= order - 1
            at = todo if able.all() else todo[able]
            hit, costs = self.tables[order - 1].look(_keys(points, None if len(at) == n - order + 1 else at, order))
            out[at[hit] - 1] += costs
            missed = at[~hit]
            if order > 1:
                # What the context leaves to shorter ones.
                seen, costs = self.contexts[order - 1].look(_keys(points, missed - 1, order - 1))
                out[missed[seen] - 1] += costs
            todo = missed if able.all() else np.sort(np.concatenate([todo[~able], missed]))
            if not len(todo):
                break
        out[todo - 1] += self.floor
        return out

    @property
    def held(self) -> bool:
        """Whether a worker keeps all of the model."""
        return all(p.held for p in (*self.tables, *self.contexts) if p)

    def excerpt(self, grams: np.ndarray) -> Model:
        """The same model for texts whose n-grams of the order are `grams`, texts' ends
        included: what they need of each part, which is read once."""
        tables: list = [None] * self.order
        contexts: list = [None] * self.order

        def own(parts: Parts, keys: np.ndarray) -> tuple[np.ndarray, Parts]:
            hit, costs = parts.look(keys)
            return hit, Parts([Own(Table.of(keys[hit], costs))], parts.langs, True)

        keys = grams
        for k in range(self.order, 0, -1):
            hit, tables[k - 1] = own(self.tables[k - 1], keys)
            if k > 1:
                missed = keys[~hit]
                _, contexts[k - 1] = own(self.contexts[k - 1], np.unique(missed >> np.uint64(16)))
                keys = np.unique(missed & np.uint64((1 << (16 * (k - 1))) - 1))
        return replace(self, tables=tables, contexts=contexts)

    def needed(self, texts: list[str]) -> np.ndarray:
        """The n-grams of the order in texts, each once. Blanks before the first text
        stand for what a text in front of it would end in."""
        points, _, _ = stream(texts)
        lead = np.full(self.order - 1, 32, np.uint16)
        return np.unique(_keys(np.concatenate([lead, points]), None, self.order))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, bits per character by language) of texts; 0 characters: no letter."""
        points, begins, ends = stream(texts)
        size = np.where(ends - begins > 1, ends - begins, 0)
        bits = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(size)
        if len(full) and self.langs:
            cost = self.cost(points)
            cuts = np.stack([begins[full], ends[full]], axis=1).ravel()
            bits[full] = np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)[::2] / size[full, None]
        return size, bits


def readings(model: Model, batches: Iterable[pa.RecordBatch], column: int, most: int = _SLICE) -> Iterator[tuple[pa.RecordBatch, Model]]:
    """Pieces of the batches, of about `most` bytes, and the model to score the texts in
    `column` by: the model itself where a worker keeps it, else an excerpt that serves
    all pieces gathered until their needs fill HELD_BYTES or they hold GATHER_BYTES."""
    waiting: list[pa.RecordBatch] = []
    need, size = np.empty(0, np.uint64), 0
    for batch in batches:
        for part in slices(batch, most):
            if model.held:
                yield part, model
                continue
            waiting.append(part)
            size += part.nbytes
            for texts in shares([x or "" for x in part.column(column).to_pylist()], _SLICE):
                need = np.union1d(need, model.needed(texts))
            if size >= GATHER_BYTES or len(need) * (8 + 4 * len(model.langs)) >= HELD_BYTES:
                some = model.excerpt(need)
                yield from ((part, some) for part in waiting)
                waiting, need, size = [], np.empty(0, np.uint64), 0
    if waiting:
        some = model.excerpt(need)
        yield from ((part, some) for part in waiting)


def _each(langs: list[str], value: Callable[[int], Column]) -> Column:
    return F.array(*[value(i) for i in range(len(langs))])


def _parts_of(rows: int, most: int) -> int:
    """A number of parts of at most about `most` rows that deals packed n-grams evenly: 1
    or a prime that does not divide 2^16 - 1."""
    n = -(-rows // most)
    if n <= 1:
        return 1
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)) or 65535 % n == 0:
        n += 1
    return n


def _dealt(table: DataFrame, langs: int, room: int, part_bytes: int) -> tuple[Parts, int]:
    """A written table (gram, costs array<float>) in shared parts, and its bytes."""
    rows, width = table.count(), 8 + 4 * langs
    n = _parts_of(rows, max(1, part_bytes // width))
    shared = []
    for i in range(n):
        part = table if n == 1 else table.where(F.pmod("gram", F.lit(n)) == i)
        found = part.select("gram", "costs").toArrow().combine_chunks()
        keys = found["gram"].to_numpy().view(np.uint64)
        costs = found["costs"].combine_chunks()
        flat = costs.flatten() if found.num_rows else pa.array([], pa.float32())
        shared.append(table.sparkSession.sparkContext.broadcast(Table.of(keys, flat.to_numpy().reshape(-1, langs))))
    return Parts(shared, langs, rows * width <= room), rows * width


def estimate(counted: DataFrame, order: int, part_bytes: int = PART_BYTES, held_bytes: int = HELD_BYTES) -> Model:
    """Interpolated Kneser-Ney from counts (lang, gram, n) of the highest order, gram a
    packed key. Each order has one discount, n1 / (n1 + 2 n2)."""
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    if not langs:
        return Model(order, [], [], [], np.empty(0), np.empty(0), np.empty((2, 0)))
    n = F.col("n")
    wide = counted.groupBy("gram").agg(_each(langs, lambda i: F.sum(F.when(F.col("lang") == langs[i], n).otherwise(0))).alias("n"))
    levels = {order: materialize(wide, "grams")}
    for k in range(order - 1, 0, -1):
        ends = levels[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1)).alias("gram"))
        levels[k] = materialize(ends.agg(_each(langs, lambda i: F.sum((n[i] > 0).cast("long"))).alias("n")), "grams")
    tables, weights, below, room = [], [], None, held_bytes
    for k in range(1, order + 1):
        once, twice = levels[k].agg(_each(langs, lambda i: F.sum((n[i] == 1).cast("long"))), _each(langs, lambda i: F.sum((n[i] == 2).cast("long")))).first()
        once, twice = np.array(once), np.array(twice)
        discount = np.clip(np.where(once > 0, once / np.maximum(1, once + 2 * twice), 0.5), 0.1, 0.9).tolist()
        sums = [_each(langs, lambda i: F.sum(n[i])).alias("total"), _each(langs, lambda i: F.sum((n[i] > 0).cast("long"))).alias("kinds")]
        total, kinds, base = F.col("total"), F.col("kinds"), F.col("base")
        if k == 1:
            # One context, the empty one, as constants.
            rows, *whole = levels[1].agg(F.count(F.lit(1)), *sums).first()
            given = levels[1].select("*", *[F.lit(x).alias(c) for c, x in zip(("total", "kinds"), whole)], F.array_repeat(F.lit(1 / (rows + 1)), len(langs)).alias("base"))
            left = [d * b / a if a else 1.0 for d, a, b in zip(discount, *whole)]
            floor = -np.log2(np.array(left) / (rows + 1)).astype(np.float32)
            weights.append(None)
        else:
            before = F.shiftrightunsigned("gram", 16)
            contexts = materialize(levels[k].groupBy(before.alias("context")).agg(*sums), "contexts")
            given = levels[k].withColumn("context", before).withColumn("end", F.col("gram").bitwiseAND(F.lit((1 << (16 * (k - 1))) - 1)))
            given = given.join(contexts, "context").join(below.select(F.col("gram").alias("end"), F.col("p").alias("base")), "end")
            cost = _each(langs, lambda i: F.when(total[i] > 0, -F.log2(discount[i] * kinds[i] / total[i])).otherwise(0.0)).cast("array<float>")
            made, size = _dealt(materialize(contexts.select(F.col("context").alias("gram"), cost.alias("costs")), "weights"), len(langs), room, part_bytes)
            weights.append(made)
            room -= size if made.held else 0
        p = _each(langs, lambda i: F.when(total[i] > 0, (F.greatest(n[i] - discount[i], F.lit(0.0)) + discount[i] * kinds[i] * base[i]) / total[i]).otherwise(base[i]))
        below = materialize(given.select("gram", p.alias("p")), "shares")
        made, size = _dealt(below.select("gram", F.transform("p", lambda x: -F.log2(x)).cast("array<float>").alias("costs")), len(langs), room, part_bytes)
        tables.append(made)
        room -= size if made.held else 0
    return Model(order, langs, tables, weights, floor, np.zeros(len(langs)), np.ones((2, len(langs))))


def shares(texts: list[str], most: int) -> Iterator[list[str]]:
    """Texts in runs of about `most` characters, one text at least."""
    begin, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield texts[begin:i]
            begin, size = i, 0
        size += len(x)
    yield texts[begin:]


def train(df: DataFrame, text: str = "text", lang: str = "lang", calibration: Column | None = None, order: int = ORDER, least_texts: int = LEAST_TEXTS) -> Model:
    """A model from all rows of df that have a text and a language. Rows where
    `calibration` holds calibrate it, the others are counted; without it, a quarter by
    the text's hash. The model has every n-gram of the rows that are counted. Languages
    with fewer calibration texts than `least_texts` share a spread, see calibrate()."""
    rows = df.where(named(text).isNotNull() & named(lang).isNotNull()).select(
        named(lang).cast("string").alias("lang"),
        named(text).alias("text"),
        (F.pmod(F.xxhash64(named(text)), F.lit(4)) == 0 if calibration is None else F.coalesce(calibration, F.lit(False))).alias("aside"),
    )
    counted = materialize(_counted(rows.where("not aside").select("lang", "text"), order), "counts")
    model = estimate(counted, order)
    if not model.langs:
        return model
    return calibrate(model, rows.where("aside").select("lang", "text"), least_texts)


def _quantile(bins: dict[int, int], share: float) -> float:
    """The middle of the step up to which the share of the counts lies."""
    left = share * sum(bins.values())
    for x in sorted(bins):
        left -= bins[x]
        if left <= 0:
            break
    return (x + 0.5) / _STEPS


def _spread(bins: dict[int, int], center: float, rate: float) -> tuple[float, float]:
    """Squared deviations of a histogram, whose texts have 1 / size of `rate` on average:
    between texts, and per character. Half of the variance is laid on the length: short
    texts spread more."""
    var = max(((_quantile(bins, UPPER_SHARE) - center) / UPPER_NORMAL) ** 2, 1e-4)
    return var, max(var / (2 * rate), 1.0)


def calibrate(model: Model, rows: DataFrame, least_texts: int = LEAST_TEXTS) -> Model:
    """Centres and spreads by language, and the temperature with the least loss, from
    histograms and sums over all rows (lang, text). Languages with fewer than `least_texts`
    texts share the spread of their texts around each one's own median, or where these
    are too few as well, that of all languages; one without any text has their highest
    centre. Only a table without any calibration text rejects nothing but texts without
    letters."""

    def run(batches):
        forget()
        code = {x: i for i, x in enumerate(model.langs)}
        held: dict[tuple[int, int], list[float]] = {}
        loss = np.zeros(len(_TEMPERATURES))
        for part, scorer in readings(model, batches, 1):
            known = [(code[a], t) for a, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if a in code]
            size, bits = scorer.entropies([t for _, t in known])
            for (a, _), n, row in zip(known, size.tolist(), bits):
                if n:
                    sums = held.setdefault((a, int(row[a] * _STEPS)), [0, 0.0])
                    sums[0] += 1
                    sums[1] += 1 / n
                    for i, t in enumerate(_TEMPERATURES):
                        z = -t * n * (row - row.min())
                        loss[i] += np.log(np.exp(z).sum()) - z[a]
        # Temperatures have code -1.
        found = [(a, x, n, r) for (a, x), (n, r) in held.items()] + [(-1, i, 0, x) for i, x in enumerate(loss.tolist())]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["lang", "bin", "n", "x"])

    # A language has as many steps as its cross-entropies reach, which rows don't add to.
    made = rows.mapInArrow(run, "lang int, bin int, n bigint, x double")
    bins: list[dict[int, int]] = [{} for _ in model.langs]
    rates, loss = np.zeros(len(model.langs)), {}
    for r in made.groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        if r["lang"] < 0:
            loss[r["bin"]] = r["x"]
        else:
            bins[r["lang"]][r["bin"]] = r["n"]
            rates[r["lang"]] += r["x"]
    texts = np.array([sum(b.values()) for b in bins])
    centers = [_quantile(b, 0.5) if b else None for b in bins]

    def pooled(langs: list[int]) -> tuple[float, float]:
        away: dict[int, int] = {}
        for i in langs:
            for x, n in bins[i].items():
                at = x - int(centers[i] * _STEPS)
                away[at] = away.get(at, 0) + n
        return _spread(away, _quantile(away, 0.5), rates[langs].sum() / texts[langs].sum())

    some = np.flatnonzero(texts).tolist()
    small = [i for i in some if texts[i] < least_texts]
    if some:
        shared = pooled(small if texts[small].sum() >= least_texts else some)
        spread = [_spread(bins[i], centers[i], rates[i] / texts[i]) if texts[i] >= least_texts else shared for i in range(len(bins))]
        highest = max(centers[i] for i in some)
        model.center = np.array([highest if c is None else c for c in centers])
        model.spread = np.array(spread).T
    else:
        model.center = np.full(len(bins), np.inf)
    model.temperature = float(_TEMPERATURES[min(loss, key=lambda i: (loss[i], i))]) if loss else 1.0
    return model


def identify(df: DataFrame, model: Model, text: str = "text", most_deviations: float = MOST_DEVIATIONS, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with lang_pred (a language of the model; `und` for a null text or one without
    letters, or if the model has no language), score (0 to 1: the calibrated probability
    of lang_pred; 0 for `und`), cross_entropy (bits per character, null for `und`) and
    rejected. Equal cross-entropies go to the language that comes first by name. Nothing
    but the text is looked at; columns of df with the new names are replaced."""

    def pieces(batches, column):
        forget()
        return ((part, partial(compute, scorer)) for part, scorer in readings(model, batches, column, SLICE_BYTES))

    def compute(scorer, texts):
        made = [scorer.entropies(x) for x in shares([x or "" for x in texts.to_pylist()], _SLICE)]
        size, bits = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
        some = size > 0 if model.langs else np.zeros(len(size), bool)
        if not model.langs:
            bits, best = np.zeros((len(size), 1)), np.zeros(len(size), np.int64)
            low, odds, limit = np.zeros(len(size)), np.ones(len(size)), np.zeros(len(size))
        else:
            best = bits.argmin(axis=1)
            low = bits[np.arange(len(bits)), best]
            odds = 1 / np.exp(np.maximum(-model.temperature * size[:, None] * (bits - low[:, None]), -700)).sum(axis=1)
            limit = model.center[best] + most_deviations * np.sqrt(model.spread[0][best] + model.spread[1][best] / np.maximum(size, 1))
        names = [model.langs[i] if ok else UNKNOWN for i, ok in zip(best, some)]
        return [
            pa.array(names, pa.string()),
            pa.array(np.where(some, odds, 0.0), pa.float64()),
            pa.array(low, pa.float64(), mask=~some),
            pa.array(~some | (low > limit), pa.bool_()),
        ]

    new = [field("lang_pred", T.StringType()), field("score", T.DoubleType()), field("cross_entropy", T.DoubleType()), field("rejected", T.BooleanType())]
    return annotate(df, [text], new, None, keep, pieces=pieces)


def keep_identified(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df without the rows that identify() rejects, and with its own columns only."""
    held = [f"c{i}" for i in range(len(df.columns))]
    own = df.toDF(*held)
    made = identify(own, model, held[df.columns.index(text)])
    return without(made.where("not rejected"), ["lang_pred", "score", "cross_entropy", "rejected"]).toDF(*df.columns)
