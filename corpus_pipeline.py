"""Corpus pipeline: documents in, places of their pieces in packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  In every stage a null text
counts as empty, ids may be null or repeat (a row is a document), an empty table gives an empty one, and
the columns of documents come out as they went in, but for the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chunkwise.llm import language, near_dup, packing, quality, suffix_dedup
from chunkwise.llm.common import table
from chunkwise.llm.queries import BPE_FILE, tokenizer_path
from chunkwise.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first cleaning: failed lines go, and documents that it rejects."""
    return quality.clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unclear go; ``lang`` is set to the language found.
    The dictionaries are learnt from the labelled rows of the stage's own input."""
    return language.keep_identified(docs, language.sample(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest id."""
    return near_dup.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a smaller document holds are cut out; documents of which nothing is left go."""
    return suffix_dedup.dedup_texts(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences (their ids: ``packing.token_pieces``)."""
    return packing.pack_documents(docs, tokenizer_path(BPE_FILE))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("minhash_near_dedup", minhash_near_dedup),
          ("suffix_array_dedup", suffix_array_dedup), ("best_fit_packing", best_fit_packing)]

#: No SQL for compression, alignment and tokenising; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
