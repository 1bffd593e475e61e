"""The weak-label classifier: expectation-maximisation and threshold against brute force,
training on all texts, the sample of distinct texts, odd texts."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from aislebrook.llm import weaklabels as w


def prose(rng, n):
    kinds = ["tan", "ber", "sol", "in", "the"]
    return " ".join("".join(rng.choice(kinds) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def junk(rng, n):
    return " ".join("".join(rng.choice("#$%&*|<>!?Z9") for _ in range(rng.randint(1, 6))) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(7)
    return [prose(rng, rng.randint(40, 150)) for _ in range(300)], [junk(rng, rng.randint(30, 80)) for _ in range(60)]


def test_copies_of_one_text_do_not_fill_the_sample(spark, mixed):
    good, bad = mixed
    for heavy in (good[0], bad[0]):
        df = frame(spark, good + bad + [heavy] * 2000)
        model, scorer = w.train(df, sample=200)
        got = {r.doc_id: r.kept for r in w.classify(df, model, scorer, keep=["doc_id"]).collect()}
        assert sum(got[i] for i in range(300)) >= 297 and sum(got[i] for i in range(300, 360)) == 0
        assert len({got[i] for i in range(360, 2360)}) == 1  # repeated rows alike


def test_without_a_sample_the_posterior_decides(spark, mixed):
    good, bad = mixed
    df = frame(spark, good + bad + [None, " "])
    model, scorer = w.train(df, sample=0)
    assert not scorer.fitted
    for r in w.classify(df, model, scorer).collect():
        assert r.kept == (r.posterior is not None and r.posterior >= 0.5)


def test_expectation_maximisation_is_that_of_single_documents():
    rng = np.random.default_rng(3)
    truth = rng.random(400) < 0.8
    votes = np.full((400, w.LABELLERS), w.NONE)
    for j in range(w.LABELLERS):
        if j < len(w.DETECTORS):
            votes[(rng.random(400) < np.where(truth, 0.02, 0.4)), j] = w.BAD
        else:
            votes[(rng.random(400) < np.where(truth, 0.8, 0.2)), j] = w.GOOD
    patterns = {}
    for v in votes:
        key = "".join(map(str, v))
        patterns[key] = patterns.get(key, 0) + 1
    model = w.expectation_maximisation(patterns, rounds=60)

    # Document by document, as plain sums over products of probabilities.
    belief, prior = w._belief(), 0.8
    given = belief
    for _ in range(60):
        odds = np.array([[np.prod([given[j, c, v[j]] for j in range(w.LABELLERS)]) * (prior if c else 1 - prior) for c in (0, 1)] for v in votes])
        good = odds[:, 1] / odds.sum(axis=1)
        new = np.empty_like(given)
        for j, c, x in itertools.product(range(w.LABELLERS), (0, 1), (w.BAD, w.GOOD, w.NONE)):
            weight = good if c else 1 - good
            new[j, c, x] = (weight[votes[:, j] == x].sum() + 10 * belief[j, c, x]) / (weight.sum() + 10)
        given, prior = new, min(max(good.mean(), 0.01), 0.99)
    assert model.prior == pytest.approx(prior, abs=1e-6)
    np.testing.assert_allclose(model.given, given, atol=1e-6)
    assert ((good > 0.5) == truth).mean() > 0.9


def test_threshold_has_the_least_expected_loss():
    rng = np.random.default_rng(4)
    for n, cost in itertools.product((1, 2, 30, 200), (0.5, 2.0, 10.0)):
        p, weight = rng.random(n).round(2), rng.integers(1, 5, n).astype(float)
        s = np.clip(p + rng.normal(0, 0.2, n), 0.01, 0.99).round(2)

        def loss(t):
            return (cost * (weight * p)[s < t]).sum() + (weight * (1 - p))[s >= t].sum()

        got = w.threshold_of(s, p, weight, cost)
        assert loss(got) == pytest.approx(min(loss(t) for t in [*s, 2.0, -1.0]))
    assert w.threshold_of(np.array([]), np.array([]), np.array([])) == 0.5


def test_features_hold_whole_words_and_marks():
    long = b"x" * 30
    assert set(w.features_of(long + b"a")) != set(w.features_of(long + b"b"))
    assert set(w.features_of("straße".encode())) != set(w.features_of("straßen".encode()))
    assert set(w.features_of(b"so!!!!!")) != set(w.features_of(b"so!!!!!!"))


def test_a_step_reads_the_buckets_in_place():
    """Sums and slopes of slices are those of single rows, and no row is taken out of Arrow."""
    rng = np.random.default_rng(5)
    texts = [b"", b"One two, two!", b"x" * 40, *(b" ".join(b"w%d" % i for i in rng.integers(0, 90, n)) for n in (1, 7, 300))]
    made = [w.features_of(t) for t in texts]
    column = pa.array([b.astype("<u2").tobytes() for b in made], pa.binary())
    weights, error = rng.normal(size=w.BUCKETS), rng.normal(size=len(texts))
    for a, b in ((0, 6), (2, 5), (5, 6)):
        packed = w.Packed.of(pa.RecordBatch.from_arrays([column], names=["buckets"]).slice(a, b - a))
        np.testing.assert_allclose(packed.sums(weights), [weights[x] @ w._scales(len(x)) for x in made[a:b]], atol=1e-9)
        slope = np.zeros(w.BUCKETS)
        for x, e in zip(made[a:b], error[a:b]):
            np.add.at(slope, x, e * w._scales(len(x)))
        np.testing.assert_allclose(packed.slope(error[a:b]), slope, atol=1e-9)


def test_odd_texts(spark, mixed):
    good, _ = mixed
    texts = [None, "", " \t\n", "a", "!!", "the " * 40_000, "é" * 100_000, *good[:40]]
    df = frame(spark, texts).withColumnRenamed("doc_id", "score")
    model, scorer = w.train(df, sample=30)
    out = w.classify(df, model, scorer)
    assert out.columns == ["text", "posterior", "score", "kept"] and out.count() == len(texts)
    assert not any(r.kept for r in out.where("text IS NULL OR trim(text) IN ('', '\t\n')").collect())
    assert w.keep_good(df, model, scorer).columns == ["score", "text"]


def test_all_texts_train_the_scorer(spark, mixed):
    """Steps over the table give what one process gives for all texts at once; more texts
    than the former sample of 6,000 all take part."""
    good, bad = mixed
    texts = [f"{t} n{i}" for i in range(20) for t in good + bad] + [good[0]] * 50 + [None, " "]
    df = frame(spark, texts).repartition(7)
    made = w.examples(df)
    patterns = {r[0]: r[1] for r in made.groupBy("votes").count().collect()}
    assert sum(patterns.values()) == len(texts)
    model = w.expectation_maximisation(patterns)
    rows = w.weighted(made)
    assert rows.count() == len(texts) - 1 > 6000
    assert rows.agg({"weight": "sum"}).first()[0] == pytest.approx(20 * 360 + w.MOST_COPIES + 1)
    got = w.fit(rows, model, passes=5)

    examples = [(w.features_of(t.encode()), model.posterior(w.votes_of(t.encode())), 1.0) for t in texts[: 20 * 360] + [" "]]
    examples.append((w.features_of(good[0].encode()), model.posterior(w.votes_of(good[0].encode())), float(w.MOST_COPIES)))
    target, weight = (np.array([x[i] for x in examples]) for i in (1, 2))
    importance = weight * (target / (weight * target).sum() + (1 - target) / (weight * (1 - target)).sum())
    importance /= importance.sum()
    weights, bias, squares, square = np.zeros(w.BUCKETS), 0.0, np.full(w.BUCKETS, 1e-8), 1e-8
    for _ in range(5):
        slope, step = 1e-4 * weights, 0.0
        for (b, t, _), i in zip(examples, importance):
            e = i * (1 / (1 + np.exp(-(bias + weights[b] @ w._scales(len(b))))) - t)
            np.add.at(slope, b, e * w._scales(len(b)))
            step += e
        squares, square = squares + slope * slope, square + step * step
        weights, bias = weights - 0.5 * slope / np.sqrt(squares), bias - 0.5 * step / np.sqrt(square)
    np.testing.assert_allclose(got.weights, weights, atol=1e-6)
    assert got.bias == pytest.approx(bias, abs=1e-6)

    # The threshold loses no more than one of single scores, but for what one step holds.
    scores = np.array([got.score(b) for b, _, _ in examples])
    best = w.threshold_of(scores, target, weight)

    def loss(t):
        return (w.GOOD_COST * (weight * target)[scores < t]).sum() + (weight * (1 - target))[scores >= t].sum()

    assert loss(w.threshold(rows, model, got)) <= loss(best) * 1.01 + 1e-6
