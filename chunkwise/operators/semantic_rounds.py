"""The semantic chunker over piece rows, in rounds.

:func:`chunk_pieces` takes one row per piece, so a document may have any number of them.  Round *b* is one
DataFrame pass over all documents that still have a batch: its elements are the chunk carried out of round
*b* - 1 (re-embedded as one text, as in the reference) and the pieces of batch *b*; scores (C1), thresholds
(C3 - C5) and assembly (C7) are the row-form operators, JVM-side.  Groups are (document, batch), at most
``batch_size`` + 1 rows, and what a round leaves is written, so lineage does not grow with the rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counter import special_tokens
from ..functions.text import token_count
from ..session import scratch_path
from . import semantic as SE


def _written(df: DataFrame, name: str) -> DataFrame:
    at = scratch_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _vectors(df: DataFrame, embedder) -> DataFrame:
    """``_vec`` of ``_text``; a text without tokens counts as a zero vector."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), embedder.dim)
    return df.withColumn("_vec", F.coalesce(embedder.embed(F.col("_text")), zero))


def chunk_pieces(pieces: DataFrame, embedder, group="doc_id", order: str = "pos", text: str = "text",
                 o: SE.SemanticOptions | None = None) -> DataFrame:
    """``group`` columns, chunk_no (from 0), text (pieces joined by newline), n_pieces: the chunks of every group of pieces in
    ``order``.  The number of rounds (largest number of batches) is the only thing the driver reads."""
    o = o or SE.SemanticOptions()
    keys = [group] if isinstance(group, str) else list(group)
    special = special_tokens(o.counter)
    rows = SE.with_batches(pieces.select(*keys, order, F.col(text).alias("_text")), keys, order, o.batch_size, "_batch")
    rows = rows.withColumn("_o", F.row_number().over(Window.partitionBy(*keys, "_batch").orderBy(order)).cast("long"))
    rows = _written(_vectors(rows.select(*keys, "_batch", "_o", "_text", token_count("_text", o.counter).alias("_n"),
                                         F.lit(1).alias("_size")), embedder), "pieces")
    rounds = (rows.agg(F.max("_batch")).first()[0] or 0) + 1
    out, carry = [], None
    for b in range(rounds):
        now = rows.where(F.col("_batch") == b).drop("_batch")
        if carry is not None:
            here = now.select(*keys).distinct()
            # documents without a further batch end with what they carry
            out.append(carry.join(here, keys, "left_anti").select(*keys, F.lit(b).alias("_b"), F.lit(-1).alias("chunk_no"), "_text", "_size"))
            lead = _vectors(carry.join(here, keys, "left_semi").withColumn("_o", F.lit(0).cast("long")), embedder)
            now = now.unionByName(lead.select(*now.columns))
        now = _written(now, "round")
        # read twice below, so written: the vectors are sorted and scored once
        scored = _written(SE.context_similarity(now.drop("_text", "_size"), keys, "_o", "_vec", o.window).drop("_vec"), "scores")
        found = scored.join(SE.thresholds(scored, keys, "_o", "_n", o=o), keys)
        cut = SE.assemble_at(SE.split_points(found, F.col("threshold")), keys, "_o", "_n", o=o)
        last = F.col("chunk_no") == F.max("chunk_no").over(Window.partitionBy(*keys))
        chunks = (now.join(cut.withColumn("_last", last), keys).where("_o BETWEEN first AND last").groupBy(*keys, "chunk_no", "_last")
                  .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_text"))), lambda x: x["_text"]), "\n").alias("_text"),
                       (F.sum("_n") - special * (F.count("*") - 1)).cast("int").alias("_n"), F.sum("_size").cast("int").alias("_size")))
        chunks = _written(chunks, "round-chunks")
        out.append(chunks.where(~F.col("_last")).select(*keys, F.lit(b).alias("_b"), "chunk_no", "_text", "_size"))
        carry = chunks.where("_last").select(*keys, "_text", "_n", "_size")
    out.append(carry.select(*keys, F.lit(rounds).alias("_b"), F.lit(-1).alias("chunk_no"), "_text", "_size"))
    whole = reduce(DataFrame.union, out)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_b", "chunk_no")) - 1
    return whole.select(*keys, nth.alias("chunk_no"), F.col("_text").alias("text"), F.col("_size").alias("n_pieces"))
