"""Token counts through a cache of content digests.

The cache is a Parquet table (content digest, tokenizer digest, count). A text's digest
is taken of its normalised form. Texts are reduced to one per digest, map-side first, so
copies of a text cross the network once; those whose digest and tokenizer the cache
lacks are encoded and appended, and every row then reads its count from the cache.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, field, fresh, named, without
from .wordtokens import encoder

CACHE = T.StructType(
    [T.StructField("content_digest", T.BinaryType()), T.StructField("tokenizer_digest", T.StringType()), T.StructField("n_tokens", T.LongType())]
)


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer file: another file, other counts."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def normalised(text: Column, blank_free: bool) -> Column:
    """The form that the digest is taken of. For a vocabulary that drops white space,
    runs of ASCII blanks count as one and none at the ends; for others the text itself.
    Letter case is left alone, since lower case and composition don't commute."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")) if blank_free else text


def read_cache(spark, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer, one row per digest even where two runs
    appended the same one. A folder that does not exist yet is an empty cache."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer_digest") == version)
    return stored.groupBy(F.col("content_digest").alias("digest")).agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, cache: str, path: str, text: str = "text") -> DataFrame:
    """df with `n_bytes` (UTF-8 bytes of the text as it is) and `n_tokens`, both long.

    Encodes what the cache at folder `cache` lacks and appends it there before the
    result is read; an append that is lost half-way leaves no row, one that is repeated
    only a row that reads the same. A null text counts as empty; repeated rows each get
    their count; an empty table stays empty; columns of df with the two new names are
    replaced. A digest that many rows share is split in the last join: the cache reaches
    it in an exchange of its own, so adaptive execution may cut both sides."""
    spark = df.sparkSession
    version = tokenizer_version(path)
    blank_free = path.endswith(".json") and encoder(path).by_run
    digest = F.unhex(F.sha2(F.encode(normalised(named(text), blank_free), "UTF-8"), 256))
    distinct = df.select(named(text).alias("content"), digest.alias("digest")).groupBy("digest").agg(F.first("content").alias("content"))
    missing = distinct.join(read_cache(spark, cache, version), "digest", "left_anti")

    def compute(texts):
        return [pa.array(encoder(path).encode(texts).counts(), pa.int64())]

    counted = annotate(missing, ["content"], [field("n_tokens", T.LongType())], compute, keep=["digest"])
    counted.select(F.col("digest").alias("content_digest"), F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    key = fresh(df, "digest_")
    kept = without(df, ["n_bytes", "n_tokens"]).columns
    n_bytes = F.octet_length(F.coalesce(named(text), F.lit(""))).cast("long")
    rows = df.select(*[named(c) for c in kept], n_bytes.alias("n_bytes"), digest.alias(key))
    known = read_cache(spark, cache, version).withColumnRenamed("digest", key).hint("rebalance")
    return rows.join(known, key, "left").drop(key)
