"""Embedding only what is new (E1, S8): vectors kept by the digest of their text.

A :class:`VectorStore` is a table (model, digest, embedding).  :meth:`VectorStore.embed` joins the digests of
the rows' texts to it, calls the model on the distinct texts that are missing (a text with many copies is
combined before the shuffle and embedded once), appends their vectors, and answers from the table.  Only
digests take part in the look-up of what is missing; a text without a vector is stored as such and not tried again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources.tables import VersionedTable
from .mutate import MAX_BROADCAST_ROWS, _maybe_broadcast

SCHEMA = T.StructType([T.StructField("model", T.StringType(), False), T.StructField("digest", T.StringType(), False),
                       T.StructField("embedding", T.ArrayType(T.FloatType(), False), True)])


class VectorStore:
    """Vectors of one model (``model`` names it with its version) below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.spark, self.model = spark, model
        self.table = VersionedTable(spark, path, SCHEMA)

    def vectors(self) -> DataFrame:
        """(digest, embedding) of this model; concurrent calls may have stored a text twice."""
        return (self.table.read().where(F.col("model") == self.model).groupBy("digest")
                .agg(F.first("embedding", ignorenulls=True).alias("embedding")))

    def embed(self, rows: DataFrame, embedder, text_col: str = "text", out_col: str = "embedding",
              max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
        """``rows`` with ``out_col``.  They are written once, as they are read several times."""
        at = scratch_path(self.spark, "to-embed")
        rows.withColumn("_digest", F.sha2(F.col(text_col), 256)).write.parquet(at)
        keyed = self.spark.read.parquet(at)
        new = (keyed.where("_digest IS NOT NULL").join(self.vectors().select(F.col("digest").alias("_digest")), "_digest", "left_anti")
               .groupBy("_digest").agg(F.min(text_col).alias("_text")))
        self.table.append(new.select(F.lit(self.model).alias("model"), F.col("_digest").alias("digest"), embedder.embed(F.col("_text")).alias("embedding")))
        asked = self.vectors().join(_maybe_broadcast(keyed.select("_digest").distinct().toDF("digest"), max_broadcast_rows), "digest", "left_semi")
        found = asked.select(F.col("digest").alias("_digest"), F.col("embedding").alias(out_col))
        return keyed.drop(out_col).join(found, "_digest", "left").drop("_digest")
