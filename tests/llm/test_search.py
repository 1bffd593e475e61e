"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from aislebrook.llm import maxsketch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=10):
    own = [(key, Counter(terms(t))) for key, t in docs]
    own = [(key, c, sum(c.values())) for key, c in own if c]
    total, tokens = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        scores = []
        for key, c, n in own:
            m = 100 - 90 + (90 * n * total) // tokens
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, key is None, key))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, key, -s) for r, (s, _, key) in enumerate(scores[:k], 1)]
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id bigint, text string, score int"), spark.createDataFrame(
        [(a, b, 2) for a, b in items], "item_id bigint, text string, doc_id int"
    )


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("width,queries", [(1024, 4096), (4, 3)])
def test_answers_are_those_of_all_scores(spark, width, queries):
    rng = random.Random(width)
    vocabulary = ["w%d" % int(rng.paretovariate(0.7)) for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120)))) for i in range(900)]
    docs += [(2000, None), (2001, ""), (2002, " \x7f-@"), (2003, "w1 " * 40000), (2004, "É w1 ß\xa0W2!w3"), (None, docs[5][1])] + [(3000 + i, docs[9][1]) for i in range(40)] + [docs[3], docs[3]]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))).upper()) for i in range(40)]
    items += [(100, None), (101, "..."), (102, "nowhere at-all"), (103, docs[9][1]), (104, "é W1 ß w2"), (105, "É"), (103, docs[9][1]), (None, "w1 w2 w7"), (106, docs[5][1])]
    got = [tuple(r) for r in maxsketch.search(*frames(spark, docs, items), width=width, queries=queries).collect()]
    assert order(got) == order(ranked(docs, items))


def test_several_queries_of_one_key_and_few_documents(spark):
    docs, items = [(2, "a b"), (1, "a c")], [(7, "a"), (7, "b")]
    got = maxsketch.search(*frames(spark, docs, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert order(tuple(r) for r in got.collect()) == order(ranked(docs, items))


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    assert maxsketch.search(docs.limit(0), items).count() == 0
    assert maxsketch.search(docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        maxsketch.search(docs, docs, item_key="doc_id")


def test_bounds_hold_and_spare_work():
    rng = random.Random(9)
    vocabulary = ["w%d" % int(rng.paretovariate(0.6)) for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(80))) for i in range(4000)]
    block = maxsketch.Block([0], [set(maxsketch.terms_of(" ".join(vocabulary[:12]).encode()))])
    import numpy as np

    found = maxsketch.Ranking(block, np.arange(1, len(block.number) + 1) * 100, block.slots(64), 64, len(docs), 80 * len(docs), 10)
    for i in range(0, len(docs), 1000):
        lists = [sorted(Counter(block.number[w] for w in maxsketch.terms_of(t.encode()) if w in block.number).items()) for _, t in docs[i : i + 1000]]
        cuts = np.cumsum([0, *map(len, lists)])
        flat = np.array([x for some in lists for x in some], np.int64).reshape(-1, 2)
        found.add(list(range(i, i + 1000)), np.full(1000, 80), cuts, flat[:, 0], flat[:, 1])
    assert len(found.rows()) == 10 and found.scored < len(docs) / 4
