"""The text operators against the libraries, brute force, round trips and held-out accuracy,
with nulls, empty texts, repeated rows, empty tables and clashing column names."""

import base64
import hashlib
import itertools
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aislebrook.llm import bpe, langid, outliers, packing, queries, sharding, simhash, tokencache, topk, warc, weaklabels
from aislebrook.llm.common import Ragged
from aislebrook.sources.scratch import materialize, scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "a", "A b\tc", "The end.\nThe end.\n", "don't  stop", "é́ß日本\x1c\xa0x", "<|endoftext|> y", "zz" * 4000, "a b " * 3000]


def docs(spark, texts, **more):
    rows = [(i, t, *[c[i] for c in more.values()]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string" + "".join(f", {n} string" for n in more))


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    kinds = {"xx": ["tan", "ber", "sol", "in", "the"], "yy": ["qué", "lla", "ción", "de", "os"]}
    out = []
    for i in range(240):
        lang = "xx" if i % 2 else "yy"
        words = ["".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(60, 200))]
        out.append((i, " ".join(words) + ".", lang, f"s{i % 3}"))
    return out


def test_bpe_is_what_the_library_gives_and_comes_back(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    parts = [" ", "\n", "a", "b'", "s", ".", "é", "\t", "  ", "1", "\x1c", "\xa0", "'t", " ", "zw", "日", "\n\n"]
    texts = ODD[:-2] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(300)] + ["ab" * 1500]
    df = docs(spark, texts + texts[:5]).withColumn("token_ids", F.lit(1))
    for r in bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN, back=True).withColumnRenamed("decoded", "d"), RANKS, public_tokenizers.PATTERN).collect():
        want = library.encode_ordinary(r.text or "")
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want and r.n_tokens == len(want), repr(r.text)
        assert r.decoded == r.d == (r.text or "").encode()
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_rank_queue_gives_the_lowest_rank_and_every_position():
    rng, queue, held = random.Random(2), bpe.RankQueue(60_000), Counter()
    for i in range(3000):
        rank = rng.randrange(60_000) if i % 2 else rng.randrange(70)
        queue.push(rank, i)
        held[rank] += 1
    while held:
        rank = queue.first()
        assert rank == min(held) and len(queue.take(rank)) == held.pop(rank)
    assert queue.first() == -1


def test_token_counts_come_from_the_cache(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    cache = scratch_path(spark, "cache")
    df = docs(spark, ODD + ODD[4:8]).withColumn("n_tokens", F.lit("old"))
    for r in tokencache.count_tokens(df, cache, WORDS).collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids), repr(r.text)
        assert r.n_bytes == len((r.text or "").encode())
    stored = spark.read.parquet(cache).count()
    # All known, and the same text with other blanks: nothing is added; a new text is one row more.
    assert tokencache.count_tokens(docs(spark, ["A  b c", "The end. The end."]), cache, WORDS).count() == 2
    assert spark.read.parquet(cache).count() == stored
    tokencache.count_tokens(docs(spark, ["something new", "something new"]), cache, WORDS)
    assert spark.read.parquet(cache).count() == stored + 1
    # Stored counts are what is read: another count for a digest shows up.
    assert tokencache.count_tokens(df.limit(0), cache, WORDS).count() == 0


def test_token_counts_of_a_second_run_come_from_the_cache(spark, tmp_path):
    texts = ODD + ["hot text of many rows"] * 400 + [f"word{i % 50} and more" for i in range(200)]
    rows = docs(spark, texts).withColumn("digest", F.lit("own")).withColumn("N_BYTES", F.lit("x"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    cache = str(tmp_path / "cache")
    build = queries.QUERIES["op9_token_counts"]
    first = sorted(map(tuple, build(spark, str(tmp_path), cache).collect()))
    stored = sorted(map(tuple, spark.read.parquet(cache).collect()))
    assert sorted(map(tuple, build(spark, str(tmp_path), cache).collect())) == first
    assert sorted(map(tuple, spark.read.parquet(cache).collect())) == stored
    assert sorted(map(tuple, build(spark, str(tmp_path)).collect())) == first  # a cache that holds a part
    # What is stored is what is read.
    other = str(tmp_path / "other")
    spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 5000).write.parquet(other)
    assert [r[2] for r in sorted(map(tuple, build(spark, str(tmp_path), other).collect()))] == [r[2] + 5000 for r in first]
    out = tokencache.count_tokens(rows, cache, WORDS)
    assert out.columns == ["doc_id", "text", "digest", "n_bytes", "n_tokens"] and out.where("digest = 'own'").count() == len(texts)


def test_every_id_is_in_one_piece(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["alpha", "be", "gamma", "x1"]) for _ in range(rng.randint(1, 900))) for _ in range(120)]
    df = docs(spark, texts).withColumn("offset", F.lit(1))
    rows = packing.pack(df, WORDS, group_tokens=1 << 14).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert len(r.token_ids) == 4 * r.length
    for i, t in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r.start)
        got = np.frombuffer(b"".join(r.token_ids for r in parts), "<u4").tolist()
        assert got == library.encode(t or "", add_special_tokens=False).ids + [1]
        assert [r.start for r in parts] == list(itertools.accumulate([0] + [r.length for r in parts]))[:-1]
        assert {r.doc_tokens for r in parts} == {len(got)}
    for some in by_sequence.values():
        some.sort(key=lambda r: r.offset)
        assert [r.offset for r in some] == list(itertools.accumulate([0] + [r.length for r in some]))[:-1]
        assert sum(r.length for r in some) <= 2048
    assert packing.pack(df.limit(0), WORDS).count() == 0


def test_pieces_of_null_and_repeated_keys(spark):
    """Every row is packed, whatever its key; other columns of the result's names are not read."""
    texts = ["be gamma " * 40, "be gamma " * 40, None, "alpha"]
    rows = [(None, texts[0], "x", 1), (7, texts[1], "x", 2), (7, texts[2], "x", 3), (None, texts[3], "x", 4)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, LENGTH string, sequence_id int").coalesce(1)
    got = packing.pack(df, WORDS).collect()
    one = {r.doc_id: r for r in packing.pack(docs(spark, texts), WORDS, fill_every=1 << 30).collect()}
    assert {k: sum(r.length for r in got if r.doc_id == k) for k in (None, 7)} == {
        None: 3 * (one[0].doc_tokens + one[3].doc_tokens),
        7: 3 * (one[1].doc_tokens + one[2].doc_tokens),
    }
    assert sum(r.start == 0 for r in got) == 12
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:]))


def test_rests_are_halved_between_the_limits_and_level_the_windows():
    for n in (0, 1, 3, 4, 5, 63, 64, 130, 2047):
        made = packing.halves(n, 64, 4)
        assert sum(made) == n and all(x <= 64 for x in made) and all(x >= 4 for x in made[:-1])
        for whole in (True, False):
            windows, pieces = packing.cuts(4096 + n, 2048, whole)
            ends = [a + m for a, m in windows + pieces]
            assert [a for a, _ in windows + pieces] == [0, *ends[:-1]] and ends[-1] == 4096 + n
            assert not whole or len(pieces) == bool(n)
    rng = random.Random(12)
    rests = [m for i in range(1200) for _, m in packing.cuts(int(rng.lognormvariate(6, 1)) + 1, 2048, i % 16 > 0)[1]]
    assert sum(rests) / 2048 <= len(packing.partition(rests, 2048)) <= sum(rests) / 2048 + 2


def test_differencing_is_even_and_the_window_count_rises():
    rng = random.Random(4)
    sizes = [rng.randint(1, 60) for _ in range(2000)]
    made = packing.difference(sizes, 40)
    totals = [t for t, _ in made]
    assert len(made) == 40 and max(totals) - min(totals) <= 2
    assert sorted(i for _, tree in made for i in packing.members(tree)) == list(range(2000))
    # Three times 6 in windows of 10 need three windows, though two would hold 18.
    assert sorted(map(len, packing.partition([6, 6, 6], 10))) == [1, 1, 1]


def test_statistics_against_brute_force_and_outliers_go(spark, prose):
    import re

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)

    for t in ODD + ["a b c a b c", "# $%\n# $%\nx", "one two three four"]:
        assert outliers.statistics_of((t or "").encode()) == brute(t), repr(t)
    rows = prose + [(1000, " ".join(f"w{i}###" for i in range(120)), "xx", "s0"), (1001, None, None, None), (1002, "few words", "xx", "s1")]
    df = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string, lang string, source string").withColumn("kept", F.lit(3))
    got = {r.doc_id: r for r in outliers.judge(df).collect()}
    assert not got[1000].kept and not got[1000].base_failed
    assert got[1001].base_failed and got[1002].base_failed and got[1001].distance is None
    clean = [r for i, r in got.items() if i < 240]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert outliers.judge(df.limit(0)).count() == 0


def test_repetition_alone_goes_in_a_clean_group(spark, prose):
    """Texts with 40 to 45 % repeated words, which the base rule lets pass."""
    rows = []
    for i, text, lang, source in prose:
        words = text.split()
        rows.append((i, text, lang, source))
        if i < 20:
            unique = [f"{w}{j}" for j, w in enumerate((words * 3)[:112])]
            rows.append((1000 + i, " ".join(unique + ["tan ber sol solin"] * 21), lang, source))
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    heavy = [got[1000 + i] for i in range(20)]
    assert all(0.40 <= r.n_repeat_words / r.n_words <= 0.45 and not r.base_failed and not r.kept for r in heavy)
    assert sum(got[i].kept for i in range(240)) >= 0.99 * 240


def test_chi_square_quantiles():
    # Published quantiles.
    assert abs(outliers.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(outliers.chi_square_quantile(0.999, 5) - 20.5150) < 1e-3


def test_language_models_are_distributions_and_find_held_out_languages(spark, prose):
    df = spark.createDataFrame([r[:3] for r in prose], "doc_id bigint, text string, lang string")
    held = F.col("doc_id") % 4 == 2
    model = langid.train(df.where(~held & (F.col("doc_id") % 4 != 3)), calibration=F.col("doc_id") % 8 == 0)
    points, _, _ = langid.stream([t for _, t, _, _ in prose])
    alphabet = np.unique(points)
    for context in ("tan", "zzz", " th"):
        mass = sum(2.0 ** -model.cost(np.array([ord(c) for c in context] + [a], np.uint16))[-1].astype(float) for a in alphabet)
        assert (mass < 1.0001).all() and (mass > 0.9).all()
    extra = docs(spark, [None, "", "123 ...", "日本"]).select((F.col("doc_id") + 9000).alias("doc_id"), "text").withColumn("lang", F.lit(None).cast("string"))
    got = {r.doc_id: r for r in langid.identify(df.where(held).union(extra).withColumn("score", F.lit("x")), model).collect()}
    assert all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for i, r in got.items() if i < 9000)
    assert [got[9000 + i].lang_pred for i in range(3)] == ["und"] * 3 and got[9000].rejected and got[9003].rejected
    assert langid.identify(df, langid.train(df.limit(0))).where("lang_pred != 'und'").count() == 0
    kept = langid.keep_identified(df.union(extra), model)
    assert kept.columns == df.columns and kept.where("doc_id >= 9000").count() == 0


def test_language_models_keep_rare_grams_and_are_brute_force(spark):
    """More than a million n-grams of one language, some of them seen once or twice, in
    whole tables and in many parts that are read again each time."""
    texts = [("xx", "tan ber sol " * 9000)] * 12 + [("xx", "quz quz jex"), ("xx", "vok ber"), ("yy", "lla os de lla"), ("yy", "jex os")]
    df = spark.createDataFrame(texts, "lang string, text string")
    counts = {"xx": Counter(), "yy": Counter()}
    for lang, text in texts:
        line = " " + text.strip() + " "
        counts[lang].update(line[i : i + 4] for i in range(len(line) - 3))
    assert sum(counts["xx"].values()) > 1_200_000
    levels = {}
    for lang, c in counts.items():
        levels[lang] = {4: c}
        for k in (3, 2, 1):
            levels[lang][k] = Counter(g[1:] for g in levels[lang][k + 1])
    alphabet = len({g for lang in levels for g in levels[lang][1]})

    def chance(lang, gram):
        if not gram:
            return 1 / (alphabet + 1)
        c = levels[lang][len(gram)]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.9)
        after = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        lower = chance(lang, gram[1:])
        return (max(c[gram] - d, 0) + d * len(after) * lower) / sum(after) if after else lower

    def parted():
        model = langid.estimate(materialize(langid._counted(df, 4), "counts"), 4, part_bytes=200, held_bytes=0)
        assert len(model.tables[3].shared) > 3 and not model.tables[3].held
        return model

    for model in (build() for build in (lambda: langid.train(df, calibration=F.lit(False)), parted)):
        assert model.langs == ["xx", "yy"]
        for gram in ["tan ", " quz", "quz ", "uz j", "jex ", " vok", "vok ", "k be", "lla ", "a os", "zzzz", "n qu", "jeta", " xyz"]:
            cost = model.cost(np.array([ord(c) for c in gram], np.uint16))[-1]
            want = [-np.log2(chance(lang, gram)) for lang in model.langs]
            assert np.allclose(cost, want, atol=1e-3), gram


def test_a_model_beyond_the_allowance_scores_alike_and_is_read_once_for_many_texts(spark, prose, monkeypatch):
    df = docs(spark, [t for _, t, _, _ in prose] + ODD, lang=[x for _, _, x, _ in prose] + ["xx"] * len(ODD))
    counted = materialize(langid._counted(df.where("text is not null").select("lang", "text"), 4), "counts")
    whole = langid.estimate(counted, 4)
    parted = langid.estimate(counted, 4, part_bytes=1000, held_bytes=0)
    assert whole.held and not parted.held and len(parted.tables[3].shared) > 3
    rows = df.where("text is not null").select("lang", "text")
    for model in (whole, parted):
        langid.calibrate(model, rows)
    assert whole.temperature == parted.temperature and np.array_equal(whole.center, parted.center) and np.array_equal(whole.spread, parted.spread)
    for bounds in ({}, {"GATHER_BYTES": 1}, {"HELD_BYTES": 1}):
        with monkeypatch.context() as patch:
            for name, value in bounds.items():
                patch.setattr(langid, name, value)
            batch = pa.RecordBatch.from_pydict({"text": [t for _, t, _, _ in prose] + ODD})
            parts = list(langid.readings(parted, iter([batch, batch]), 0, most=20_000))
            scorers = {id(m) for _, m in parts}
            assert len(parts) > 10 and len(scorers) == (len(parts) if bounds else 1) and all(m.held for _, m in parts)
            for part, scorer in parts:
                texts = [x or "" for x in part.column(0).to_pylist()]
                for a, b in zip(whole.entropies(texts), scorer.entropies(texts)):
                    assert np.array_equal(a, b)
    got, want = ({r.doc_id: r for r in langid.identify(df, m).collect()} for m in (parted, whole))
    assert got == want and len(got) == df.count()


def test_counts_of_many_languages_are_passed_on_in_time(spark, monkeypatch):
    monkeypatch.setattr(langid, "COUNTED", 50)
    texts = [(f"l{i % 9}", f"abc{chr(97 + i % 26)}def ghi{chr(97 + i % 7)}") for i in range(200)] * 2
    want = Counter((lang, f" {t} "[j : j + 4]) for lang, t in texts for j in range(len(t) - 1))
    got = langid._counted(spark.createDataFrame(texts, "lang string, text string"), 4).collect()
    key = lambda g: sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(g))
    assert {(r.lang, r.gram): r.n for r in got} == {(lang, key(g)): n for (lang, g), n in want.items()}


def test_texts_of_tied_languages_and_very_long_ones(spark):
    """Two languages of equal texts tie, and the first by name is named; a text longer
    than a slice is scored whole."""
    df = docs(spark, ["tan ber sol in the "] * 8 + ["lla os de que "] * 4, lang=["b", "a"] * 4 + ["c"] * 4)
    model = langid.train(df, calibration=F.lit(False))
    long = ["tan ber sol in the " * 300_000, "tan ber sol", None]
    got = [r.lang_pred for r in langid.identify(docs(spark, long), model).orderBy("doc_id").collect()]
    assert got == ["a", "a", "und"]


def test_gibberish_among_the_calibration_texts_goes_and_small_languages_reject(spark, prose):
    """Eight per cent of a language's texts are random letters, and a third language has
    too few texts for a limit of its own."""
    rng = random.Random(10)
    noise = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñ") for _ in range(rng.randint(2, 9))) for _ in range(120))
    rows = [(i, t, lang) for i, t, lang, _ in prose]
    rows += [(1000 + i, noise(), "xx") for i in range(10)]
    few = [" ".join(rng.choice(["жук", "дом", "лес", "река"]) for _ in range(100)) for _ in range(6)]
    rows += [(2000 + i, t, "zz") for i, t in enumerate(few)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    aside = F.col("doc_id") % 2 == 0
    # Both languages calibrate with half of their texts: those of xx are odd.
    model = langid.train(df.withColumn("doc_id", F.expr("doc_id div 2")), calibration=aside)
    assert np.isfinite(model.center).all()
    odd = spark.createDataFrame([(3000, "".join(rng.choice("абвгдежзиклмнопрст") for _ in range(600)), None)], df.schema)
    got = {r.doc_id: r.rejected for r in langid.identify(df.union(odd), model).collect()}
    assert all(got[1000 + i] for i in range(10)) and got[3000]
    assert not any(r for i, r in got.items() if i < 1000 or 2000 <= i < 3000)


def test_labellers_find_junk_and_keep_prose(spark, prose):
    rng = random.Random(6)
    junk = [" ".join(rng.choice(["tan", "sol"]) + rng.choice(["###", "%%%"]) for _ in range(80)) for _ in range(15)]
    junk += [" ".join(rng.choice(["TAN", "SOL", "BER"]) + "!!" for _ in range(80)) for _ in range(15)]
    texts = [r[1] for r in prose] + junk + [None, "", "  "]
    df = docs(spark, texts).withColumn("kept", F.lit("no"))
    model, scorer = weaklabels.train(df, sample=200)
    got = {r.doc_id: r for r in weaklabels.classify(df, model, scorer).collect()}
    assert all(got[i].kept for i in range(240))
    assert sum(got[i].kept for i in range(240, 270)) <= 3
    assert not any(got[i].kept for i in range(270, 273)) and got[270].posterior is None
    good = weaklabels.keep_good(df, model, scorer)
    assert good.columns == df.columns and 240 <= good.count() <= 243
    assert weaklabels.classify(df.limit(0), *weaklabels.train(df.limit(0))).count() == 0


def test_covering_masks_miss_no_pair_of_bits():
    for seed in (1, 2, 3):
        family = [m & (1 << 64) - 1 for m in simhash.masks(3, seed)]
        assert len(family) == 15
        for c in itertools.combinations(range(64), 3):
            x = sum(1 << b for b in c)
            assert any(not x & m for m in family)


@pytest.mark.parametrize("bucket", [4, simhash.BUCKET])
def test_links_have_the_components_of_all_pairs(spark, bucket):
    rng = random.Random(7)
    codes = {rng.getrandbits(64) for _ in range(60)}
    for base in list(codes)[:12]:
        for _ in range(25):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            codes.add(x)
            base = x if rng.random() < 0.3 else base
    codes |= {0, 1 << 63, (1 << 64) - 1, (1 << 63) | 7}
    codes = sorted(codes)
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(codes)), 2):
        if bin(codes[i] ^ codes[j]).count("1") <= 3:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    table = spark.createDataFrame([(c,) for c in signed], "simhash bigint")
    found = {r.node: r.root for r in simhash.components(simhash.links(table, 3, bucket)).collect()}
    mine = [found.get(c, c) for c in signed]
    theirs = [root(i) for i in range(len(codes))]
    for i, j in itertools.combinations(range(len(codes)), 2):
        assert (mine[i] == mine[j]) == (theirs[i] == theirs[j])


def test_near_duplicates_of_odd_rows(spark):
    texts = ["one two three four five", "ONE two\tthree four  five", None, "", "\n", "single", "other words here for once"]
    df = docs(spark, texts).withColumn("fingerprint", F.lit(0)).union(docs(spark, [None]).selectExpr("cast(null as bigint)", "'single'", "0"))
    got = {(r.doc_id): r for r in simhash.near_duplicates(df).collect()}
    assert got[0].component_id == got[1].component_id == 0 and got[0].fingerprint == got[1].fingerprint
    assert [got[i].component_id for i in (2, 3, 4)] == [2, 2, 2] and got[2].fingerprint == "0" * 16
    assert got[5].component_id == 5 and got[None].component_id == 5
    kept = simhash.one_of_each(materialize(df, "rows"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 5, 6] and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_very_long_texts_and_their_copies_are_near_duplicates(spark):
    rng = random.Random(13)
    words = [f"w{rng.randrange(5000)}" for _ in range(400_000)]
    other = list(words)
    other[1000] = "changed"
    texts = [" ".join(words), "short text of its own", "\n".join(words).upper(), " ".join(other), "w " * 300_000]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i].component_id for i in range(5)] == [0, 1, 0, 0, 4] and got[0].fingerprint == got[2].fingerprint


def test_shards_are_exact_and_whole(spark):
    df = docs(spark, (ODD * 30)[:350]).withColumn("slot", F.lit(1)).repartition(7)
    got = sharding.shuffle(df, 9, seed=3, task_rows=10).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t in enumerate((ODD * 30)[:350]))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(9)) and {len(x) for x in by.values()} == {38, 39}
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.shuffle(df.limit(0), 9).count() == 0
    assert sorted(r.shard for r in sharding.shuffle(df.limit(3), 9).collect()) == [0, 1, 2]


def test_rows_stay_whole_when_a_table_is_split_otherwise_in_the_next_read(spark, monkeypatch):
    """Splits follow a setting here, as they follow the executors on a cluster."""
    path, key = scratch_path(spark, "files"), "spark.sql.files.maxPartitionBytes"
    docs(spark, [f"text number {i} of its own kind {i * i}" for i in range(120)]).repartition(24).write.parquet(path)
    whole = spark.conf.get(key)

    def changing(table, label="table"):
        made = materialize(table, label)
        spark.conf.set(key, "2k" if spark.conf.get(key) == whole else whole)
        return made

    try:
        for module in (sharding, simhash):
            monkeypatch.setattr(module, "materialize", changing)
        for first in (whole, "2k"):
            spark.conf.set(key, first)
            got = sharding.shuffle(spark.read.parquet(path), 7, seed=3, task_rows=10).collect()
            assert sorted(r.doc_id for r in got) == list(range(120))
            by = {}
            for r in got:
                by.setdefault(r.shard, []).append(r.slot)
            assert all(sorted(x) == list(range(len(x))) for x in by.values()) and {len(x) for x in by.values()} == {17, 18}
            spark.conf.set(key, first)
            made = simhash.one_of_each(spark.read.parquet(path), radius=0)
            spark.conf.set(key, "2k" if first == whole else whole)
            assert sorted(r.doc_id for r in made.collect()) == list(range(120))
    finally:
        spark.conf.set(key, whole)


def test_communication_matrix_follows_its_law(spark):
    """Mean and variance of a hypergeometric count over many uniform numbers."""
    total, good, drawn, n = 200, 60, 50, 4000
    x = spark.range(n).select(sharding.hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), sharding.uniform(F.lit(5), F.col("id"))).alias("x"))
    r = x.agg(F.mean("x"), F.var_samp("x"), F.min("x"), F.max("x")).first()
    mean, var = drawn * good / total, drawn * good / total * (1 - good / total) * (total - drawn) / (total - 1)
    assert abs(r[0] - mean) < 5 * (var / n) ** 0.5 and abs(r[1] / var - 1) < 0.12 and 0 <= r[2] <= r[3] <= drawn
    counts = spark.createDataFrame([(0, 30), (1, 0), (2, 70), (4, 11)], "part bigint, n bigint")
    rows = {r.part: r.ends for r in sharding.matrix(counts, 4, seed=1).collect()}
    each = {p: np.diff([0, *e]) for p, e in rows.items()}
    assert {p: int(e.sum()) for p, e in each.items() if e.sum()} == {0: 30, 2: 70, 4: 11}
    assert sum(each.values()).tolist() == [28, 28, 28, 27] and all((e >= 0).all() for e in each.values())


def test_archives_come_back_whole(spark):
    html = ["<p>a</p>\r\n\r\nWARC/1.1\r\n", None, "", "<p>é</p>", "<p>a</p>\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "<p>é</p>", "<p>é</p>"]
    rows = [(i if i != 3 else None, None if i == 2 else f"http://h.example/{i}\r\n", h) for i, h in enumerate(html)]
    rows.append(rows[-1])
    pages = materialize(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("record_type", F.lit(1)), "pages")
    path = scratch_path(spark, "archives")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path)
    assert records.where("stated_digest != payload_digest and record_type = 'response'").count() == 0
    captures = warc.assemble(records).withColumn("page_id", warc.field_of(F.col("metadata"), "page_id").try_cast("long"))
    got = warc.resolve(captures, ["page_id", "payload_digest", "payload_bytes", "payload"]).collect()
    assert len(got) == len(rows) and all(len(r.requests) == 1 and len(r.metadata) == 1 for r in got)
    last = {}
    for i, (p, _, h) in enumerate(rows):
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    for r in got:
        body = bytes(r.full_payload).decode()
        assert r.full_payload_digest == base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        assert r.full_payload_bytes == len(body.encode())
        if r.record_type == "revisit":
            assert r.full_page_id == last[body] and r.payload_bytes == 0
        else:
            assert r.page_id == last[body]
    assert Counter(bytes(r.full_payload).decode() for r in got) == Counter(h or "" for _, _, h in rows)
    assert Counter(r.record_type for r in got)["response"] == 4


def test_records_are_tied_over_links_either_way_and_big_captures_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(warc, "NESTED", 3)
    rows = [("c1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["q1"]), ("m2", "metadata", ["m1"]), ("lost", "metadata", ["nowhere"])]
    rows += [("c2", "resource", [])] + [(f"n{i}", "metadata", ["c2"]) for i in range(20)]
    table = spark.createDataFrame(
        [(a, b, None, None, None, c, None, None, None, 0, None, None) for a, b, c in rows], warc.RECORD
    )
    got = warc.assemble(table).collect()
    one = [r for r in got if r.record_id == "c1"]
    assert len(one) in (1, 2) and {x.record_id for r in one for x in [*r.requests, *r.metadata]} == {"q1", "m1", "m2"} if one else False
    many = [r for r in got if r.record_id == "c2"]
    assert len(many) > 1 and sorted(x.record_id for r in many for x in r.metadata) == sorted(f"n{i}" for i in range(20))
    assert [x.record_id for r in got if r.record_id is None for x in r.metadata] == ["lost"]
    with pytest.raises(ValueError, match="cut off"):
        import io

        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


def test_top_k_is_brute_force(spark):
    rng = np.random.default_rng(8)
    vectors = [v.tolist() for v in rng.normal(0, 0.2, (300, 12)) * rng.choice([0.1, 1, 3], (300, 1))]
    vectors += [vectors[0]] * 20 + [[0.0] * 12, None, [None] + [1.0] * 11, [float("nan")] * 12, [float("inf")] * 12, [], [1e-9] * 12, [-1e-9] * 12, [2.0, 3.0]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, rank int")
    got = {}
    for r in topk.top_k(materialize(df, "vectors"), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = {i: np.floor(256 * np.array(v, np.float32).astype(float)).tolist() for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all()}
    for i in q:
        if i % 10 == 0:
            best = sorted((-int(np.dot(q[i], q[j])), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
            assert sorted(got.get(i, [])) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)], i
    assert all(i in q for i in got)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_leaves_out_null_ids_and_deals_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 2)
    monkeypatch.setattr(topk, "FIRST_BLOCKS", 3)
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(120, 6)).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(None, [9.0] * 6), (None, None)]
    df = materialize(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vectors")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 3 == 0).collect()}
    q = np.floor(256 * np.array(vectors))
    assert len(got) == 40 * 5
    for i in range(0, 120, 3):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(120) if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in best]


def test_high_cosines_are_pruned_by_coordinates_without_loss():
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(2000, 8))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for q in unit[:40]:
        for cosine in (0.8, 0.9, 0.99):
            need = np.flatnonzero(unit @ q >= cosine)
            assert set(need) <= set(topk._candidates(q, unit, cosine))


def test_pipeline_stages_keep_the_columns_and_the_clean_documents(spark, prose, tmp_path):
    import corpus_pipeline

    rows = [(i, t, lang, s, len(t)) for i, t, lang, s in prose]
    rows += [(500, rows[0][1], "yy", "s0", 1), (501, None, None, None, None), (502, "### " * 200, "xx", "s0", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, df = df, materialize(stage(spark, df, str(tmp_path)), "stage")
        assert df.columns == before.columns and df.exceptAll(before).isEmpty()
    kept = {r.doc_id for r in df.select("doc_id").collect()}
    assert kept == set(range(240))
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept


def test_pipeline_of_clashing_columns_and_of_an_empty_table(spark, prose, tmp_path):
    """Columns that the stages use for themselves stay as they came; no rows give no rows."""
    import corpus_pipeline

    rows = [(i, t, lang, s, len(t), "own", 0.5, True, "f", 3) for i, t, lang, s in prose[:120]] + [(None, None, None, None, None, None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, Score double, rejected boolean, fingerprint string, component_id int"
    df = spark.createDataFrame(rows, schema)
    for name, some in (("all", df), ("none", df.limit(0))):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    kept = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, f"{tmp_path}/all"), "stage")
        assert kept.dtypes == df.dtypes and kept.exceptAll(df).isEmpty()
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/all")
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in kept.collect()} == set(range(120))
    none = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert none.columns == pieces.columns and none.count() == 0


def test_registered_names():
    from aislebrook.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_ids_of_many_texts_are_put_together_in_blocks():
    codes = np.arange(1_000_000) % 1_000
    edges = np.concatenate([np.arange(0, 1_000_000, 400), [1_000_000, 1_000_000]])
    ids = [np.arange(n % 3, dtype="<u4").tobytes() for n in range(1_000)]
    packed = Ragged(codes, edges, ids)
    tracemalloc.start()
    made = packed.texts()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == [b"".join(ids[c] for c in codes[a:b]) for a, b in zip(edges, edges[1:])]
    assert peak < 3 * sum(map(len, made))


def test_slices_of_any_size_pack_alike(spark, prose):
    df = docs(spark, [t for _, t, _, _ in prose] + ODD).coalesce(1)
    few, many = queries.pieces(df, 1 << 10), queries.pieces(df)
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
