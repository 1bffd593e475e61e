"""Quality rules: base rules on a text's statistics, then robust multivariate outliers.

Statistics of the rows that pass the base rules are transformed to nearly symmetric
numbers. For every language and source, the minimum-covariance-determinant estimate
finds the half of the rows whose covariance has the least determinant, so that nearly half
of a group may be bad: from several deterministic starts, rows are ordered by their
Mahalanobis distance, the nearest half gives the next mean and covariance, and so on until
the determinant settles. The best start's estimate is reweighted once, and rows further
away than a chi-square quantile are rejected.

All rows take part. Statistics are written once; each step sums moments per group and
narrow bin of distance map-side, and of the bin in which the half ends the part that is
missing counts, so the half has its exact weight and a group that holds a third of all
rows is a few rows of sums in every shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from aislebrook.sources.scratch import materialize

from .common import annotate, field, named, utf8

# Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Share of a group that the estimate rests on; the rest may be bad.
SHARE = 0.5
# Chance that a row of a normal group is rejected.
TAIL = 1e-4
# Concentration goes on until the logarithm of the determinant moves less than this, in
# most cases for some ten steps; a start that has not settled after STEPS counts as it is.
SETTLED = 1e-5
STEPS = 60
# Groups with fewer rows count among their language's other sources, and such languages
# among each other: ten rows to a dimension.
LEAST_ROWS = 50
# Least standard deviation by dimension, in the transformed units; an estimate above it
# stays as it is. By the texts' resolution: in a text that hardly passes the base rules,
# one symbol, one line of eight words that comes twice, or the chance that lies in the
# mean length of 100 words is no reason for a rejection.
FLOORS = [0.05, 0.035, 0.07, 0.11, 0.05]
DIMENSIONS = len(FLOORS)
_LINE_BLANKS = b" \t\n\x0b\x0c\r"


def statistics_of(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text in UTF-8."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0
    bare = text.translate(None, _LINE_BLANKS)
    points = len(bare.decode())
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            once, more = set(), set()
            for w in windows:
                (more if w in once else once).add(w)
            covered = bytearray(n)
            for i, w in enumerate(windows):
                if w in more:
                    covered[i : i + 3] = b"\1\1\1"
            repeated = sum(covered)
    return n, points, symbols, dup, repeated


def statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with the five statistics of every whole text, all long.
    Words are runs of anything but ASCII white space; a null text has none."""

    def compute(texts):
        rows = [statistics_of(x) for x in utf8(texts)]
        return [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)]

    return annotate(df, [text], [field(s, T.LongType()) for s in STATISTICS], compute, keep)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def transformed() -> list[Column]:
    """The statistics on nearly symmetric scales: characters per word and words as
    logarithms, shares as square roots."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
        F.log(n),
    ]


def _gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while abs(term) > abs(total) * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_share(d / 2, mid / 2) < p else (low, mid)
    return low


def _consistency(share: float) -> float:
    """Factor that makes the covariance of a normal sample's nearest share unbiased."""
    q = chi_square_quantile(share, DIMENSIONS)
    return share / _gamma_share(DIMENSIONS / 2 + 1, q / 2)


# What every concentration step evaluates is kept as text: it is parsed in one call, where
# building it operator by operator took the driver longer than the step itself.
_PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
_TERMS = [f"inverse[{k}] * (x[{i}] - center[{i}]) * (x[{j}] - center[{j}]) * {1 if i == j else 2}" for k, (i, j) in enumerate(_PAIRS)]
# Squared Mahalanobis distance; inverse holds the upper triangle, row by row.
_DISTANCE = f"greatest({' + '.join(['0.0D', *_TERMS])}, 0.0D)"
# Sixty-four bins to the octave.
_BIN = f"cast(floor(64 * log2(greatest({_DISTANCE}, 1e-9D))) AS int)"
_SUMS = {f"s{i}": f"x[{i}]" for i in range(DIMENSIONS)} | {f"q{i}{j}": f"x[{i}] * x[{j}]" for i, j in _PAIRS}


def _distance() -> Column:
    return F.expr(_DISTANCE)


def _x() -> list[Column]:
    return [F.col("x")[i] for i in range(DIMENSIONS)]


_FIT = "g_lang string, g_source string, start int, center array<double>, inverse array<double>, logdet double"


def _moments() -> list[Column]:
    return [F.expr("count(1) AS n"), *[F.expr(f"sum({value}) AS {c}") for c, value in _SUMS.items()]]


def _fits(sums: DataFrame, factor: float) -> DataFrame:
    """Mean and inverse covariance of each group and start from its sums."""
    floor = np.array(FLOORS)
    columns = ["g_lang", "g_source", "start", "n"] + [f"s{i}" for i in range(DIMENSIONS)] + [f"q{i}{j}" for i, j in _PAIRS]

    def run(batches):
        for b in batches:
            c = [b.column(i).to_pylist() for i in range(len(columns))]
            centers, inverses, dets = [], [], []
            for r in zip(*c[3:]):
                n, mean = r[0], np.array(r[1 : 1 + DIMENSIONS]) / r[0]
                cov = np.empty((DIMENSIONS, DIMENSIONS))
                for (i, j), q in zip(_PAIRS, r[1 + DIMENSIONS :]):
                    cov[i, j] = cov[j, i] = q / n - mean[i] * mean[j]
                # Only directions in which the group hardly varies, measured in floors, are widened.
                values, axes = np.linalg.eigh(factor * cov / np.outer(floor, floor))
                cov = (axes * np.maximum(values, 1.0)) @ axes.T * np.outer(floor, floor)
                inverse = np.linalg.inv(cov)
                centers.append(mean.tolist())
                inverses.append([float(inverse[i, j]) for i, j in _PAIRS])
                dets.append(float(np.linalg.slogdet(cov)[1]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(centers, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64())), pa.array(dets, pa.float64())],
                names=["g_lang", "g_source", "start", "center", "inverse", "logdet"],
            )

    return sums.select(*columns).mapInArrow(run, _FIT)


_GROUP = ["g_lang", "g_source"]


def _joined(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """rows with what small has for their group; small has one row per group (and start)."""
    return rows.join(small, on)


def _grouped(rows: DataFrame, least_rows: int) -> DataFrame:
    """rows (lang, source, ...) with their group: their language and source, or where that
    has too few rows, the small sources of the language together (source null), or all
    such of small languages (both null)."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") >= least_rows).select("lang", "source", F.lit(True).alias("own"))
    rest = sizes.where(F.col("n") < least_rows).groupBy("lang").agg(F.sum("n").alias("n"))
    langs = rest.where(F.col("n") >= least_rows).select("lang", F.lit(True).alias("pooled"))
    places = materialize(sizes.select("lang", "source").join(large, ["lang", "source"], "left").join(langs, "lang", "left"), "groups")
    made = rows.join(places, ["lang", "source"])
    own, pooled = F.coalesce("own", F.lit(False)), F.coalesce("pooled", F.lit(False))
    # A group's names carry a mark, so that pooled groups differ from any source's name.
    return made.select(
        *rows.columns,
        F.when(own | pooled, F.concat(F.lit("="), "lang")).otherwise(F.lit("*")).alias("g_lang"),
        F.when(own, F.concat(F.lit("="), "source")).otherwise(F.lit("*")).alias("g_source"),
    )


def _reach(bins: DataFrame, keys: list[str], share: Column) -> DataFrame:
    """By keys, the first bin up to which the share of n lies. A group has as many bins
    as its values have steps, which rows don't add to."""
    total = bins.groupBy(*keys).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("all"))
    reached = F.aggregate(
        "all",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("bin")),
        lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.when(a["n"] < F.ceil(share * F.col("total")), b["bin"]).otherwise(a["bin"]).alias("bin")),
    )["bin"]
    return total.select(*keys, reached.alias("bin"))


def _medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """(group, m): the medians of the values by group, to an eighth of a floor."""
    steps = F.array(*[F.floor(v / (FLOORS[i] / 8)).cast("int") for i, v in enumerate(values)])
    each = rows.select(*_GROUP, F.posexplode(steps).alias("dim", "bin"))
    found = _reach(each.groupBy(*_GROUP, "dim", "bin").agg(F.count(F.lit(1)).alias("n")), [*_GROUP, "dim"], F.lit(0.5))
    width = F.element_at(F.array(*[F.lit(f / 8) for f in FLOORS]), F.col("dim") + 1)
    listed = found.groupBy(*_GROUP).agg(F.sort_array(F.collect_list(F.struct("dim", ((F.col("bin") + 0.5) * width).alias("v")))).alias("all"))
    return materialize(listed.select(*_GROUP, F.col("all.v").alias("m")), "medians")


def _starts(rows: DataFrame) -> DataFrame:
    """The fits to begin with, around each group's medians in units of its median
    deviations: 0 without correlations, 1 with those of the values bent by tanh, 2 with
    those of the directions that rows lie in."""
    x = _x()
    median = _medians(rows, x).withColumnRenamed("m", "center")
    away = _joined(rows, median, _GROUP)
    spread = _medians(away, [F.abs(x[i] - F.col("center")[i]) for i in range(DIMENSIONS)])
    scale = F.array(*[F.greatest(1.4826 * F.col("m")[i], F.lit(FLOORS[i])) for i in range(DIMENSIONS)])
    known = materialize(median.join(spread, _GROUP).select(*_GROUP, "center", scale.alias("scale")), "scales")
    z = [(x[i] - F.col("center")[i]) / F.col("scale")[i] for i in range(DIMENSIONS)]
    length = F.sqrt(sum((c * c for c in z), F.lit(1e-12)))
    bent, unit = F.array(*[F.tanh(c) for c in z]), F.array(*[c / length for c in z])
    each = F.explode(F.array(F.struct(F.lit(1).alias("start"), bent.alias("y")), F.struct(F.lit(2).alias("start"), unit.alias("y"))))
    each = _joined(rows, known, _GROUP).select(*_GROUP, each.alias("e")).select(*_GROUP, "e.*")
    products = [F.expr(f"sum(y[{i}] * y[{j}]) AS q{i}{j}") for i, j in _PAIRS]
    sums = each.groupBy(*_GROUP, "start").agg(*products)
    alone = known.select(*_GROUP, F.lit(0).alias("start"), *[F.lit(float(i == j)).alias(f"q{i}{j}") for i, j in _PAIRS])
    sums = alone.unionByName(sums).join(known, _GROUP).select(*_GROUP, "start", "center", "scale", *[f"q{i}{j}" for i, j in _PAIRS])

    def run(batches):
        for b in batches:
            inverses = []
            for r in zip(*[b.column(i).to_pylist() for i in range(4, 5 + len(_PAIRS))]):
                shape = np.empty((DIMENSIONS, DIMENSIONS))
                for (i, j), q in zip(_PAIRS, r[1:]):
                    shape[i, j] = shape[j, i] = q
                size = np.sqrt(np.maximum(np.diag(shape), 1e-12))
                values, axes = np.linalg.eigh(shape / np.outer(size, size))
                inverse = (axes / np.maximum(values, 0.05)) @ axes.T / np.outer(r[0], r[0])
                inverses.append([float(inverse[i, j]) for i, j in _PAIRS])
            dets = pa.array([1e300] * b.num_rows, pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(inverses, pa.list_(pa.float64())), dets], names=[*_GROUP, "start", "center", "inverse", "logdet"])

    return materialize(sums.mapInArrow(run, _FIT), "starts")


def _concentrated(rows: DataFrame, fit: DataFrame, share: float, factor: float) -> DataFrame:
    """The fits of the share of each group's rows that is nearest by the given ones."""
    near = _joined(rows, fit, _GROUP).withColumn("bin", F.expr(_BIN))
    bins = near.groupBy(*_GROUP, "start", "bin").agg(*_moments())
    group = Window.partitionBy(*_GROUP, "start")  # its bins, some thousands at most
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = (share * F.sum("n").over(group) - before) / F.col("n")
    inner = bins.withColumn("part", F.least(F.lit(1.0), part)).where("part > 0")
    sums = inner.groupBy(*_GROUP, "start").agg(*[F.expr(f"sum({c} * part) AS {c}") for c in ("n", *_SUMS)])
    return _fits(sums, factor)


def estimate(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """(g_lang, g_source, center, inverse) by minimum covariance determinant from rows
    (g_lang, g_source, x array<double>), a written table."""
    factor = _consistency(share)
    active, done = _starts(rows), []
    for _ in range(steps):
        before = active.select(*_GROUP, "start", F.col("logdet").alias("before"))
        moved = _concentrated(rows, active, share, factor).join(before, [*_GROUP, "start"])
        settled = F.abs(F.col("logdet") - F.col("before")) <= SETTLED
        moved = materialize(moved.withColumn("settled", settled).drop("before"), "fit")
        done.append(moved.where("settled").drop("settled"))
        active = moved.where("not settled").drop("settled")
        if active.isEmpty():
            break
    fit = reduce(DataFrame.unionByName, [*done, active])
    best = fit.groupBy(*_GROUP).agg(F.min(F.struct("logdet", "start", "center", "inverse")).alias("b")).select(*_GROUP, F.col("b.center").alias("center"), F.col("b.inverse").alias("inverse"))
    # One reweighting step: the moments of all rows within the usual 97.5 % distance.
    near = _joined(rows, materialize(best, "fit"), _GROUP).where(_distance() <= chi_square_quantile(0.975, DIMENSIONS))
    sums = near.groupBy(*_GROUP).agg(*_moments()).withColumn("start", F.lit(0))
    return materialize(_fits(sums, _consistency(0.975)).select(*_GROUP, "center", "inverse"), "fit")


def judge(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    keep: list[str] | None = None,
    share: float = SHARE,
    tail: float = TAIL,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """df (or its columns `keep`) with the five statistics, base_failed, distance (squared,
    null where base_failed), judged_with and kept.

    Null languages and sources are groups of their own, as are empty ones; null and empty
    texts fail the base rules; repeated rows each count; rows at equal distances are judged
    alike; an empty table stays empty. A group of fewer than `least_rows` rows is judged
    with the other small ones of its language, or of all languages; judged_with says which
    it was: source, language or all. Where all of these together are fewer rows than the
    estimate has to have, twice the dimensions and two, judged_with is null and no row is
    rejected by distance. Columns of df with the new names are replaced."""
    kept = df.columns if keep is None else keep
    made = [*STATISTICS, "base_failed", "distance", "judged_with", "kept"]
    kept = [c for c in kept if c.lower() not in made]
    held = [f"c{i}" for i in range(len(kept))]
    plain = df.select(
        *[named(c).alias(h) for c, h in zip(kept, held)],
        F.coalesce(F.concat(F.lit("."), named(lang).cast("string")), F.lit("")).alias("lang"),
        F.coalesce(F.concat(F.lit("."), named(source).cast("string")), F.lit("")).alias("source"),
        named(text).alias("text"),
    )
    rows = statistics(plain, keep=[*held, "lang", "source"])
    rows = materialize(rows.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))), "statistics")
    vector = F.array(*transformed()).alias("x")
    passed = materialize(_grouped(rows.where("not base_failed").select("lang", "source", vector), least_rows).select("lang", "source", *_GROUP, "x"), "vectors")
    fit = estimate(passed.select(*_GROUP, "x"), share)
    enough = passed.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(least_rows, 2 * (DIMENSIONS + 1)))
    how = F.when(F.col("g_source") != "*", "source").when(F.col("g_lang") != "*", "language").otherwise("all")
    of = passed.select("lang", "source", *_GROUP).distinct().join(enough.join(fit, _GROUP), _GROUP).select("lang", "source", "center", "inverse", how.alias("judged_with"))
    out = rows.withColumn("x", vector).join(materialize(of, "fit"), ["lang", "source"], "left")
    distance = F.when(~F.col("base_failed"), _distance())
    out = out.withColumn("distance", distance)
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square_quantile(1 - tail, DIMENSIONS), F.lit(True))
    return out.withColumn("kept", verdict).select(*[named(h).alias(c) for c, h in zip(kept, held)], *made)
