"""Runs of words against brute force, and their Spark form on odd texts."""

import hashlib
import random
import zlib

from aislebrook.llm import periodic, queries


def brute(words, least=12):
    """Every stretch that keeps a period as long as it can, the smallest period of each."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def words_like(rng, n, letters):
    out = []
    while len(out) < n:
        if rng.random() < 0.5:
            out += [b"%d" % rng.randrange(letters) for _ in range(rng.randint(1, 9))] * rng.randint(1, 5)
        else:
            out.append(b"%d" % rng.randrange(50))
    return out


def test_runs_are_those_of_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        words = words_like(rng, rng.randint(0, 60), rng.randint(1, 4))
        least = rng.choice([2, 3, 7, 12])
        assert periodic.runs_of(words, least) == brute(words, least)


def test_squares_without_the_stretches_give_the_same_runs():
    rng = random.Random(4)
    for _ in range(300):
        ids = [int(w) for w in words_like(rng, rng.randint(1, 40), 2)]
        starts = {(s, q) for s, q in periodic.squares(ids)}
        assert starts == {(s, q) for s, _, q in brute(ids, 2)}


def test_long_texts_stay_near_linear():
    rng = random.Random(5)
    base = [b"w%d" % rng.randrange(3000) for _ in range(41)]
    assert periodic.runs_of(base * 2000) == [(0, 82000, 41)]
    assert periodic.runs_of([b"a"] * 50000) == [(0, 50000, 1)]
    assert periodic.runs_of([b"%d" % i for i in range(50000)]) == []


def test_odd_texts_in_spark(spark):
    texts = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "x\x0ba b\x0c" * 7, "é ß é ß " * 4 + "\x1c", "a\xa0" * 20, " ".join(["one two three"] * 5), "b " * 30000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts + texts)], "doc_id bigint, text string, RUNS int")
    got = {}
    for r in periodic.find_runs(df).collect():
        found = (r.n_words, [tuple(x) for x in r.runs], r.collapsed)
        assert got.setdefault(r.text, found) == found  # repeated rows alike
        words = (r.text or "").encode().split()
        want = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        dropped = {i for s, n, q in want for i in range(s + q, s + n)}
        assert found == (len(words), want, b" ".join(w for i, w in enumerate(words) if i not in dropped).decode())
    assert got["a " * 12][1] == [(0, 12, 1)] and got["a " * 11][1] == []
    assert periodic.find_runs(df.limit(0)).count() == 0
    # The column names of the result may be the input's.
    assert periodic.find_runs(df.withColumnRenamed("text", "collapsed"), text="collapsed").columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_query_columns(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(w.decode() for w in words_like(rng, rng.randint(0, 90), 3))) for i in range(300)] + [(301, None), (302, "  "), (None, "a b " * 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for key, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(key).encode())
        if key is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        r = got[key]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
    assert planted > 10
