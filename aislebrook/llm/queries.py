"""The registered queries of the subpackage and their SQL, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislebrook.sources.scratch import scratch_path

from . import bpe, crosspolytope, langid, maxsketch, outliers, packing, periodic, sharding, simhash, tokencache, topk, warc, weaklabels
from .common import fold

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_classifier")
def quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model, scorer = weaklabels.train(docs)
    return weaklabels.classify(docs, model, scorer, keep=["doc_id"])


@query(
    "op2_warc_assembly",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
    FROM q""",
)
def warc_assembly(spark, sf_dir):
    archives = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), archives)
    captures = warc.assemble_archives(spark, archives).withColumn("page_id", warc.field_of(F.col("metadata"), "page_id").cast("long"))
    whole = warc.resolve(captures, ["page_id", "payload_bytes", "payload_digest"])
    refers = F.when(F.col("record_type") == "revisit", F.col("full_page_id")).alias("refers_to")
    return whole.select("page_id", F.col("full_payload_bytes").alias("payload_bytes"), F.col("full_payload_digest").alias("payload_digest"), "record_type", refers)


@query("op3_byte_bpe")
def byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN, keep=["doc_id"], back=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_quality_rules")
def quality_rules(spark, sf_dir):
    return outliers.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op5_language_id")
def language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = fold(F.col("doc_id"), 4)
    model = langid.train(docs.where(part != 2), calibration=part == 3)
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def pieces(docs: DataFrame, slice_bytes: int = packing.SLICE_BYTES) -> DataFrame:
    packed = packing.pack(docs, WORD_BPE, slice_bytes=slice_bytes)
    return packed.withColumn("ids_crc32", F.crc32("token_ids")).select(*PIECE_COLUMNS)


@query("op6_packing")
def packed_documents(spark, sf_dir):
    return pieces(table(spark, sf_dir, "documents"))


@query("op7_simhash")
def simhash_groups(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_sharding")
def shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = sharding.shuffle(docs, 40, seed=20240229)
    text = F.coalesce(F.col("text"), F.lit(""))
    return dealt.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_token_counts")
def token_counts(spark, sf_dir, cache: str | None = None):
    """Counts through the cache at folder `cache`. Without one, a new cache is filled with
    a quarter of the table first, as by an earlier run; the whole table then finds these
    there and encodes the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if cache is None:
        cache = scratch_path(spark, "token-counts")
        tokencache.count_tokens(docs.where(fold(F.col("doc_id"), 4) == 0), cache, WORD_BPE)
    counted = tokencache.count_tokens(docs, cache, WORD_BPE)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query(
    "op10_topk",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def nearest(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


WORD = r"[^\x20\x09-\x0D]+"


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32(doc_id) and g = h div 10, every tenth document
    repeats its words from word g % n on, at a distance that leaves 3 + g % 8 periods."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = ((h - h % 10) / 10).cast("long")

    def repeated(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        return F.when(n > 0, F.array_join(F.transform(words, lambda x, i: F.get(words, at(i.cast("long")))), " ")).otherwise(F.col("text"))

    words = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    # The words are found once, as the one element that the lambda takes.
    text = F.when((h % 10 == 0) & F.col("text").isNotNull(), F.element_at(F.transform(words, repeated), 1)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


@query("op11_periodic_runs")
def periodic_runs(spark, sf_dir):
    found = periodic.find_runs(planted(table(spark, sf_dir, "documents")), keep=["doc_id"])
    top = periodic.longest(F.col("runs"))
    exponent = F.floor(1000 * top["length"] / top["period"]).cast("long")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        exponent.alias("exponent_milli"),
        F.sha2(periodic.listing(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op12_embedding_groups",
    """
    WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    w AS (SELECT *, sqrt(list_inner_product(e, e)) AS s FROM v WHERE e IS NOT NULL AND len(e) > 0
          AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.r AS a, b.r AS b, b.vec_id FROM w a JOIN w b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) >= 0.9 * a.s * b.s),
    near(a, b) AS (SELECT a, b FROM l UNION SELECT near.a, l.b FROM near JOIN l ON near.b = l.a),
    low AS (SELECT near.a, min(v.vec_id) AS vec_id FROM near JOIN v ON v.r = near.b GROUP BY near.a),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(low.vec_id, v.vec_id)) AS component_id,
           v.vec_id <= coalesce(low.vec_id, v.vec_id) AS kept
    FROM v LEFT JOIN low ON v.r = low.a LEFT JOIN n ON v.r = n.a""",
)
def embedding_groups(spark, sf_dir):
    return crosspolytope.near_duplicates(table(spark, sf_dir, "embeddings"), keep=["vec_id"])


@query(
    "op13_lexical_search",
    r"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
    c AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
    w AS (SELECT term, floor(1000 * ln((2 * max(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term),
    m AS (SELECT doc_id, 100 - 90 + ((90 * n * nn) // ll) AS m FROM d, c),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
          FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT * FROM r WHERE rank <= 10""",
)
def lexical_search(spark, sf_dir):
    return maxsketch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
