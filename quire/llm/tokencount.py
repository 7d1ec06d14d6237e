"""Token counts with a digest cache.

The cache is a table (tokenizer, content, n_tokens): the digest of the tokenizer
file and the digest of the normalised content (null becomes empty; nothing else
may change without changing counts). Counting joins the contents with the cache,
encodes each distinct missing content once, appends the new counts to the cache
and joins the counts back to the documents.

Copies meet in a pre-aggregation by digest before the shuffle, so a text that
half the documents share moves once from each task. The join back carries
digests and lengths only.

Defined cases: a null text counts as empty and has no tokens; repeated rows and
null keys keep a row each; empty tables give empty results; two runs that append
the same content leave two equal rows, of which one is read; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, batch_of, resident, shared_folder, stored

CACHE = "tokenizer string, content binary, n_tokens bigint"


def tokenizer_digest(name: str) -> str:
    return hashlib.sha256(Path(public_tokenizers.path(name)).read_bytes()).hexdigest()


def load_counter(name: str):
    """A function from texts to their numbers of tokens, without special tokens."""
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def read_cache(spark, path: str) -> DataFrame:
    """The cache's rows; an empty table where there is none yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(df: DataFrame, tokenizer: str, cache: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, n_bytes, n_tokens) for each row of df; new counts are appended to the cache.

    cache: the cache's folder, read by all executors; a new one where None.
    """
    spark = df.sparkSession
    cache = cache or shared_folder(spark)
    version = tokenizer_digest(tokenizer)
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("content", F.unhex(F.sha2("_text", 256)))
    known = read_cache(spark, cache).where(F.col("tokenizer") == version)
    distinct = rows.groupBy("content").agg(F.any_value("_text").alias("_text"))
    misses = distinct.join(known.select("content"), "content", "left_anti").select("content", "_text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = resident(("counter", tokenizer), lambda: load_counter(tokenizer))
        for b in batches:
            yield batch_of({"content": b.column(0), "n_tokens": pa.array(counter(b.column(1).to_pylist()), pa.int64())})

    new = arrow_map(misses, encode, "content binary, n_tokens bigint")
    new.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    counts = stored(read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))
    slim = rows.select("_key", "content", F.octet_length("_text").cast("long").alias("n_bytes"))
    # Copies of one text may be a third of all rows; of an inner join of two scans, Spark splits the hot part.
    return slim.join(counts, "content").select(F.col("_key").alias(key), "n_bytes", "n_tokens")
