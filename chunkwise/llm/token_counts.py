"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens).  A
call joins the digests of its texts to the stored counts, encodes only the
distinct texts that are not there, appends their counts, and answers from the
table.  Content is normalised only as far as counts allow: null becomes empty.

One row per distinct missing text is chosen on (digest, smallest id) alone, so
a text with many copies is pre-aggregated before the shuffle and encoded once.  The missing
digests are written: if there are few (``BROADCAST_IDS``), texts do not move at all; else they
move once, keyed by their row, so no key is hot.  By default the cache is a folder per
tokenizer version below ``spark.checkpoint.dir`` that later calls share.

Defined results: a null or empty text has no tokens; equal texts have equal
counts; repeated rows, ids that are null or repeat, ties: each row is
answered; an empty table gives an empty table; extra columns are left out.
Appends by concurrent calls may store a count twice; reads take one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import id_and_text, maybe_broadcast, slices, written
from .encoders import SentencePieceCounts, once

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer file: digest of its bytes."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def default_cache(spark: SparkSession, path: str) -> str:
    """The shared cache folder of a tokenizer file."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/chunkwise-token-cache-{tokenizer_digest(path)[:16]}"


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Counts of one tokenizer version; empty while the cache does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA).select("content_digest", "n_tokens")
    return (spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer_digest") == version)
            .groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")))


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(content_digest, n_tokens) of rows (content_digest, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = once(SentencePieceCounts, path)
        for b in slices(batches, "text", 8 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.count(t) for t in b.column(1).to_pylist()], pa.int64())],
                                             names=["content_digest", "n_tokens"])

    return texts.select("content_digest", "text").mapInArrow(run, "content_digest binary, n_tokens long")


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, content_digest for every row; the cache (a folder, by default
    :func:`default_cache`) grows by what was missing."""
    spark = docs.sparkSession
    cache = cache or default_cache(spark, path)
    version = tokenizer_digest(path)
    rows = id_and_text(docs, id_col, text_col).withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    # one id per digest, then the missing ones: digests and ids only
    first = rows.groupBy("content_digest").agg(F.min("doc_id").alias("first_id"))
    misses = written(first.join(stored(spark, cache, version), "content_digest", "left_anti"), "token-misses")
    # texts move by row id; of rows with one id and text (repeated rows) one count is stored
    todo = (rows.withColumnRenamed("content_digest", "d")
            .join(maybe_broadcast(misses, 5), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("d") == F.col("content_digest")))
            .select("content_digest", "text"))
    (encode_counts(todo, path).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
     .withColumn("tokenizer_digest", F.lit(version))
     .select("content_digest", "tokenizer_digest", "n_tokens").write.mode("append").parquet(cache))
    # the counts that are asked for, written, so that the last join's sides are plain
    # exchanges and a digest of many copies can be split
    answers = written(first.select("content_digest").join(stored(spark, cache, version), "content_digest"), "token-counts")
    return (rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest")
            .join(answers, "content_digest"))
