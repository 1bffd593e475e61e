"""Quality classifier without gold labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Votes are
counted by pattern, and expectation-maximisation over the pattern counts estimates each
labeller's accuracies and the share of good documents: every document takes part, and
what the driver holds is bounded by the number of patterns, two to the power of the
labellers. A document's posterior follows from its pattern. All documents then train a
linear scorer on hashed words with the posteriors as soft labels, so that the scorer
generalises beyond what the rules see: votes and hash buckets are written once, every
gradient step is one pass over them, and a task returns one vector. One text in some, by
its hash, is held out of the steps: these texts' posteriors decide from which score on a
document is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize
from .common import annotate, field, forget, named, slices, utf8, without

# One distinct text in this many is not fitted on, but decides on the threshold.
HELD_OUT = 5
# Steps of a log-odds unit by which scores are counted for the threshold.
STEPS = 1 << 10
# Copies of a text that count at most.
MOST_COPIES = 4
# Hash buckets of the scorer.
BUCKETS = 1 << 15
PASSES = 60
# A good document that is lost costs as much as so many bad ones that are kept.
GOOD_COST = 2.0
GOOD, BAD, NONE = 1, 0, 2

# Detectors: what they measure, above which value they vote bad; else they don't vote.
DETECTORS = [
    ("symbols per character", 0.05),
    ("share of words that are a mark alone", 0.15),
    ("share of words in capitals", 0.50),
    ("share of words equal to the one before", 0.20),
    ("share of words that repeat", 0.95),
    ("exclamation and question marks per word", 0.40),
    ("share of characters that are digits", 0.30),
    ("share of lines that repeat", 0.40),
]
# Vouchers: the measures, by place above, that must all lie below a limit for a good vote.
VOUCHERS = [
    ("few marks", {0: 0.02, 1: 0.05, 5: 0.10, 6: 0.10}),
    ("lower-case prose", {0: 0.02, 2: 0.20, 5: 0.20}),
    ("little repetition", {3: 0.05, 7: 0.25}),
]
LABELLERS = len(DETECTORS) + len(VOUCHERS)
_ENDS = b".,;:!?#*$%&|<>=@^~_\\{}[]+"
_MARKS = b"#*$%&|<>=@^~_\\{}[]+"


def measures(text: bytes) -> list[float]:
    """What the labellers look at, in their order; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(DETECTORS)
    size = sum(map(len, words))
    distinct = set(words)
    capitals = sum(w.isupper() and len(w) > 1 for w in words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    alone = sum(1 for w in words if len(w) <= 2 and not w.translate(None, _MARKS))
    return [
        (size - len(text.translate(None, _MARKS).translate(None, b" \t\n\x0b\x0c\r"))) / size,
        alone / n,
        capitals / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(distinct) / n,
        (text.count(b"!") + text.count(b"?")) / n,
        (len(text) - len(text.translate(None, b"0123456789"))) / size,
        1 - len(set(lines)) / len(lines),
    ]


def votes_of(text: bytes, found: list[float] | None = None) -> str:
    """One character per labeller: 1 good, 0 bad, 2 no vote. A text without words gets
    none. `found` are its measures, if they are known."""
    if not text.strip():
        return str(NONE) * LABELLERS
    found = found or measures(text)
    votes = [BAD if x >= high else NONE for x, (_, high) in zip(found, DETECTORS)]
    votes += [GOOD if all(found[i] < low for i, low in limits.items()) else NONE for _, limits in VOUCHERS]
    return "".join(map(str, votes))


def features_of(text: bytes, found: list[float] | None = None) -> np.ndarray:
    """Hash buckets of a text: first one for each measure, in steps that widen, then its
    distinct words and its distinct shapes of words (what ends a word, and its case).
    `found` are its measures, if they are known."""
    first = [b"m%d.%d" % (i, int(4 * np.log2(1 + 64 * x))) for i, x in enumerate(found or measures(text))]
    bares, shapes = set(), set()
    for w in set(text.split()):
        bare = w.rstrip(_ENDS)
        bares.add(bare.lower())
        shapes.add((w[len(bare) :], bare.isupper() and len(bare) > 1))
    rest = {xxhash.xxh3_64_intdigest(b"w" + x) % BUCKETS for x in bares}
    rest.update(xxhash.xxh3_64_intdigest(b"e" + x + (b"U" if upper else b"a")) % BUCKETS for x, upper in shapes)
    rest = np.sort(np.fromiter(rest, np.int64, len(rest)))
    return np.concatenate([[xxhash.xxh3_64_intdigest(f) % BUCKETS for f in first], rest])


def _scales(n: int) -> np.ndarray:
    """Measures weigh 1 each, all words and shapes together like one vector of length 1."""
    scale = np.full(n, 1 / np.sqrt(max(1, n - len(DETECTORS))))
    scale[: len(DETECTORS)] = 1.0
    return scale


@dataclass
class LabelModel:
    prior: float  # share of good documents
    given: np.ndarray  # labeller x (bad, good) x vote: probability of the vote

    def posterior(self, pattern: str) -> float:
        """Probability that a document with these votes is good."""
        odds = np.log([1 - self.prior, self.prior])
        for table, v in zip(self.given, pattern):
            odds = odds + np.log(table[:, int(v)])
        odds = np.exp(odds - odds.max())
        return float(odds[1] / odds.sum())


def _belief() -> np.ndarray:
    """What is believed of the labellers beforehand, by (bad, good) and vote: a detector
    finds one bad document in five and errs on one in a hundred, a voucher vouches for
    nine good ones in ten and for half of the bad ones."""
    table = np.empty((LABELLERS, 2, 3))
    table[: len(DETECTORS), :, GOOD] = table[len(DETECTORS) :, :, BAD] = 1e-4
    table[: len(DETECTORS), :, BAD] = 0.2, 0.01
    table[len(DETECTORS) :, :, GOOD] = 0.5, 0.9
    table[:, :, NONE] = 1 - table[:, :, :2].sum(axis=2)
    return table


def expectation_maximisation(patterns: dict[str, int], rounds: int = 200) -> LabelModel:
    """Accuracies of the labellers from pattern counts; not voting is an outcome as well.
    Ten documents' worth of prior belief keeps every probability away from 0."""
    belief = _belief()
    model = LabelModel(0.8, belief)
    if not patterns:
        return model
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    votes = np.array([[int(v) for v in k] for k in keys])
    for _ in range(rounds):
        good = np.array([model.posterior(k) for k in keys])
        new = np.empty_like(belief)
        for j in range(LABELLERS):
            for c, weight in enumerate((n * (1 - good), n * good)):
                cast = np.array([weight[votes[:, j] == v].sum() for v in (BAD, GOOD, NONE)])
                new[j, c] = (cast + 10 * belief[j, c]) / (cast.sum() + 10)
        share = float((n * good).sum() / n.sum())
        before, model = model, LabelModel(min(max(share, 0.01), 0.99), new)
        if abs(before.prior - model.prior) < 1e-9 and np.abs(before.given - model.given).max() < 1e-9:
            break
    return model


@dataclass
class Scorer:
    """A document is kept if its score is at least `threshold`. A scorer that nothing was
    fitted for has no weights: the posterior decides in its place."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.5
    fitted: bool = True

    def score(self, buckets: np.ndarray) -> float:
        z = self.bias + float(self.weights[buckets] @ _scales(len(buckets)))
        return 1 / (1 + float(np.exp(-min(max(z, -50), 50))))


@dataclass
class Packed:
    """Buckets of all rows of `examples` in one array, measures first in each row."""

    flat: np.ndarray
    start: np.ndarray  # of each row
    size: np.ndarray
    first: np.ndarray  # row x measure
    scale: np.ndarray  # of what follows the measures

    @classmethod
    def of(cls, part: pa.RecordBatch) -> Packed:
        column = part.column("buckets").cast(pa.large_binary())
        edges = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) // 2
        flat = np.frombuffer(column.buffers()[2], "<u2")[edges[0] : edges[-1]].astype(np.intp)
        start, size = edges[:-1] - edges[0], np.diff(edges)
        first = flat[start[:, None] + np.arange(len(DETECTORS))]
        return cls(flat, start, size, first, 1 / np.sqrt(np.maximum(1, size - len(DETECTORS))))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The scaled sum of its weights, of each row."""
        measured = weights[self.first].sum(axis=1)
        return measured + self.scale * (np.add.reduceat(weights[self.flat], self.start) - measured)

    def slope(self, error: np.ndarray) -> np.ndarray:
        """By bucket, the scaled sum of the errors of the rows that have it."""
        least = error * self.scale
        more = np.bincount(self.first.ravel(), np.repeat(error - least, len(DETECTORS)), BUCKETS)
        return np.bincount(self.flat, np.repeat(least, self.size), BUCKETS) + more


def _targets(part: pa.RecordBatch, posterior: dict[str, float]) -> np.ndarray:
    votes = part.column("votes").dictionary_encode()
    known = np.array([posterior[v] for v in votes.dictionary.to_pylist()], float)
    return known[votes.indices.to_numpy()]


def examples(df: DataFrame, text: str = "text") -> DataFrame:
    """Written once: h (hash of the text, null for a null text), votes and buckets
    (binary: little-endian unsigned 16-bit numbers) of every row of df."""
    hashed = df.select(named(text).alias("text"), F.xxhash64(named(text)).alias("hash"))
    hashed = hashed.select("text", F.when(F.col("text").isNotNull(), F.col("hash")).alias("h"))

    def compute(texts):
        votes, buckets = [], []
        for t in utf8(texts):
            found = measures(t)
            votes.append(votes_of(t, found))
            buckets.append(features_of(t, found).astype("<u2").tobytes())
        return [pa.array(votes, pa.string()), pa.array(buckets, pa.binary())]

    made = annotate(hashed, ["text"], [field("votes", T.StringType()), field("buckets", T.BinaryType())], compute, keep=["h"])
    return materialize(made, "examples")


def weighted(rows: DataFrame, sample: int | None = None) -> DataFrame:
    """Rows of `examples` that have a text, with weight: the copies of a text weigh
    MOST_COPIES rows together at most. With `sample` one row of each of that many texts,
    those with the smallest hash."""
    rows = rows.where("h IS NOT NULL")
    if sample is not None:
        texts = rows.groupBy("h").agg(F.first("votes").alias("votes"), F.first("buckets").alias("buckets"), F.count(F.lit(1)).alias("n"))
        weight = F.least(F.col("n"), F.lit(MOST_COPIES)).cast("double")
        return materialize(texts.orderBy("h").limit(sample).select("h", "votes", "buckets", weight.alias("weight")), "weighted")
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_COPIES)
    often = materialize(often.select("h", (F.lit(float(MOST_COPIES)) / F.col("n")).alias("weight")), "copies")
    found = rows.join(often, "h", "left")
    return materialize(found.select("h", "votes", "buckets", F.coalesce("weight", F.lit(1.0)).alias("weight")), "weighted")


def fit(rows: DataFrame, model: LabelModel, passes: int = PASSES, rate: float = 0.5, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by full gradient steps with per-weight rates, on
    all `weighted` rows. A step is one pass over them: each task adds up the slope of its
    rows, and the driver holds the sums."""
    weights, bias = np.zeros(BUCKETS), 0.0
    counts = {r["votes"]: r["n"] for r in rows.groupBy("votes").agg(F.sum("weight").alias("n")).collect()}
    if not counts:
        return Scorer(weights, bias, fitted=False)
    posterior = {v: model.posterior(v) for v in counts}
    # Both classes weigh the same, so that a rare class is learnt.
    good = max(sum(n * posterior[v] for v, n in counts.items()), 1e-9)
    bad = max(sum(n * (1 - posterior[v]) for v, n in counts.items()), 1e-9)
    total = sum(n * (posterior[v] / good + (1 - posterior[v]) / bad) for v, n in counts.items())
    sc = rows.sparkSession.sparkContext
    squares, square = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(passes):
        shared = sc.broadcast((weights, bias))

        def slope_of(batches):
            forget()
            weights, bias = shared.value
            slope, step = np.zeros(BUCKETS), 0.0
            for batch in batches:
                for part in slices(batch):
                    packed = Packed.of(part)
                    target = _targets(part, posterior)
                    importance = part.column("weight").to_numpy() * (target / good + (1 - target) / bad) / total
                    z = bias + packed.sums(weights)
                    error = importance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
                    slope += packed.slope(error)
                    step += float(error.sum())
            yield pa.RecordBatch.from_arrays([pa.array([slope.tobytes()], pa.binary()), pa.array([step])], names=["slope", "step"])

        slope, step = decay * weights, 0.0
        for r in rows.select("votes", "buckets", "weight").mapInArrow(slope_of, "slope binary, step double").collect():
            slope = slope + np.frombuffer(r["slope"], float)
            step += r["step"]
        shared.destroy()
        squares += slope * slope
        weights = weights - rate * slope / np.sqrt(squares)
        square += step * step
        bias -= rate * step / np.sqrt(square)
    return Scorer(weights, bias)


def threshold_of(scores: np.ndarray, posterior: np.ndarray, weight: np.ndarray, good_cost: float = GOOD_COST, tops: np.ndarray | None = None) -> float:
    """The score with the least expected loss by the posteriors: a document below it is
    lost, one at or above it kept. In the middle of the gap between the two scores next
    to it; 0.5 where there is nothing to tell it from. Where an entry stands for several
    documents, `scores` are the least scores of each and `tops` the largest."""
    if not len(scores):
        return 0.5
    by = np.argsort(scores, kind="stable")
    s, lost, kept = scores[by], good_cost * (weight * posterior)[by], (weight * (1 - posterior))[by]
    # Loss if the i lowest go.
    loss = np.concatenate([[0.0], np.cumsum(lost)]) + kept.sum() - np.concatenate([[0.0], np.cumsum(kept)])
    edge = np.concatenate([[True], s[1:] > s[:-1], [True]])
    best = int(np.flatnonzero(edge)[np.argmin(loss[edge])])
    low = (s if tops is None else tops[by])[best - 1] if best else 0.0
    high = s[best] if best < len(s) else 1.0
    return float((low + high) / 2)


def threshold(rows: DataFrame, model: LabelModel, scorer: Scorer, good_cost: float = GOOD_COST) -> float:
    """threshold_of the `weighted` rows, whose scores are counted in steps of 1 / STEPS of
    the log-odds, 100 units in all: what the driver holds is bounded by these."""
    shared = rows.sparkSession.sparkContext.broadcast(scorer)

    def scored(batches):
        scorer, seen = shared.value, {}
        for batch in batches:
            for part in slices(batch):
                z = np.clip(scorer.bias + Packed.of(part).sums(scorer.weights), -50, 50)
                for v in part.column("votes").unique().to_pylist():
                    seen.setdefault(v, model.posterior(v))
                good = part.column("weight").to_numpy() * _targets(part, seen)
                made = [np.floor(z * STEPS).astype(np.int64), 1 / (1 + np.exp(-z)), good]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made] + [part.column("weight")], names=["step", "score", "good", "weight"])

    found = rows.select("votes", "buckets", "weight").mapInArrow(scored, "step bigint, score double, good double, weight double")
    sums = [F.min("score").alias("least"), F.max("score").alias("most"), F.sum("good").alias("good"), F.sum("weight").alias("weight")]
    least, most, good, weight = (c.to_numpy() for c in found.groupBy("step").agg(*sums).select("least", "most", "good", "weight").toArrow().columns)
    return threshold_of(least, good / weight if len(weight) else good, weight, good_cost, most)


def label(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `votes`, one character per labeller, of every whole text."""
    return annotate(df, [text], [field("votes", T.StringType())], lambda x: [pa.array([votes_of(t) for t in utf8(x)], pa.string())])


def train(df: DataFrame, text: str = "text", sample: int | None = None, good_cost: float = GOOD_COST) -> tuple[LabelModel, Scorer]:
    """The label model from the votes on all rows of df, and the scorer and its threshold
    from all rows that have a text; with `sample` from that many distinct texts only. A
    text's copies weigh MOST_COPIES rows at most, so no text decides alone, and lie on the
    same side of the held-out split."""
    made = examples(df, text)
    patterns = {r["votes"]: r["n"] for r in made.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = expectation_maximisation(patterns)
    rows = weighted(made, sample)
    aside = F.pmod(F.col("h"), F.lit(HELD_OUT)) == HELD_OUT - 1
    scorer = fit(rows.where(~aside), model)
    if scorer.fitted:
        scorer.threshold = threshold(rows.where(aside), model, scorer, good_cost)
    return model, scorer


def classify(df: DataFrame, model: LabelModel, scorer: Scorer, text: str = "text", threshold: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with posterior (of the label model), score (of the
    scorer; both 0 to 1) and kept (score at least the threshold, by default the scorer's
    own; with a scorer that nothing was fitted for, posterior at least one half). A null
    text or one without words has posterior null, score 0 and is not kept. Repeated rows
    score alike; an empty table stays empty; columns of df with the new names are
    replaced."""
    shared = df.sparkSession.sparkContext.broadcast((model, scorer))
    least = scorer.threshold if threshold is None else threshold

    def compute(texts):
        forget()
        model, scorer = shared.value
        seen: dict[str, float] = {}
        posterior, score, kept = [], [], []
        for x in utf8(texts):
            if not x.strip():
                posterior.append(None)
                score.append(0.0)
                kept.append(False)
                continue
            found = measures(x)
            votes = votes_of(x, found)
            if votes not in seen:
                seen[votes] = model.posterior(votes)
            posterior.append(seen[votes])
            score.append(scorer.score(features_of(x, found)))
            kept.append(score[-1] >= least if scorer.fitted else posterior[-1] >= 0.5)
        return [pa.array(posterior, pa.float64()), pa.array(score, pa.float64()), pa.array(kept, pa.bool_())]

    new = [field("posterior", T.DoubleType()), field("score", T.DoubleType()), field("kept", T.BooleanType())]
    return annotate(df, [text], new, compute, keep)


def keep_good(df: DataFrame, model: LabelModel, scorer: Scorer, text: str = "text", threshold: float | None = None) -> DataFrame:
    """df without the rows that classify() does not keep, and with its own columns only."""
    own = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    made = classify(own, model, scorer, f"c{df.columns.index(text)}", threshold)
    return without(made.where("kept"), ["posterior", "score", "kept"]).toDF(*df.columns)
