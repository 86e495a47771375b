"""Pluggable token counter, PDF pages in the ingest loop, registration of paths, options that take effect."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkwise.functions.counter import TokenCounter
from chunkwise.functions.text import token_count
from chunkwise.operators import semantic as SE
from chunkwise.operators import split as SP
from chunkwise.operators.embed import HashingEmbedder
from chunkwise.plans.ingest import chunk_documents
from chunkwise.plans.sync import register_paths, sync_pending
from chunkwise.schemas import chunks_schema, files_schema
from chunkwise.sources.tables import VersionedTable


def by_value(fn):
    """A counter that workers, which cannot import this file, get by value."""
    return lambda texts, f=fn: [f(t) for t in texts.to_pylist()]


letters, words = by_value(lambda t: len(t)), by_value(lambda t: len(t.split()))


def test_counts_and_nulls(spark):
    df = spark.createDataFrame([("abc",), (None,), ("",), ("abc",)], "t string").coalesce(1)
    got = [r[0] for r in df.select(token_count("t", TokenCounter(letters, special=1))).collect()]
    assert got == [4, None, 1, 4]
    lists = spark.createDataFrame([(["a", "bb"],), ([],), (None,)], "t array<string>").coalesce(1)
    assert [r[0] for r in lists.select(TokenCounter(letters).counts(F.col("t"))).collect()] == [[1, 2], [], None]


def test_each_distinct_text_once_a_batch(spark):
    def fussy(texts):
        own = texts.to_pylist()
        assert len(set(own)) == len(own) and len(own) <= 3
        return [1] * len(own)

    df = spark.createDataFrame([(f"t{k % 7}",) for k in range(50)], "t string").coalesce(1)
    assert df.select(TokenCounter(fussy, batch_size=3).count(F.col("t")).alias("n")).agg(F.sum("n")).first()[0] == 50


@pytest.mark.parametrize("cap", [5, 9, 30])
def test_split_by_letters(spark, cap):
    """Nothing is lost, no chunk is over the cap, and units are packed greedily in order."""
    texts = ["One two. Three four five! Six", "x" * 100 + " y", "日本語。 中文！ 好 z", "", "   ", "a\n b;  c", "no end " * 20, "é" * 33]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    c = TokenCounter(letters, special=0)
    out = {}
    for r in SP.split_tokens(df, size=cap, counter=c).orderBy("id", "pos").collect():
        out.setdefault(r.id, []).append(r.text)
    bare = lambda s: "".join(s.split())
    for k, t in enumerate(texts):
        got = out.get(k, [])
        assert bare("".join(got)) == bare(t)
        # units are counted alone: the joining blanks come on top
        assert all(len(bare(x)) <= cap for x in got)
    assert out[0][0].startswith("One")


def test_default_counter_as_plugin(spark):
    """The built-in counter, plugged in, gives the built-in chunks (its words are short)."""
    import regex

    token = regex.compile(r"[一-鿿]|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")
    plugged = TokenCounter(lambda a: [len(token.findall(t)) for t in a.to_pylist()])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for strategy in ("sentence", "semantic"):
        one = chunk_documents(docs, size=64, strategy=strategy, add_time=0).drop("embedding")
        two = chunk_documents(docs, size=64, strategy=strategy, counter=plugged, add_time=0).drop("embedding")
        assert sorted(one.collect()) == sorted(two.collect())


def test_chunker_counts_with_the_counter(spark):
    o = SE.SemanticOptions(piece_size=40, min_tokens=20, max_tokens=100, batch_size=4, counter=TokenCounter(words, special=0))
    text = " ".join(f"Sentence number {k} has exactly seven words." for k in range(60))
    df = spark.createDataFrame([(text,)], "t string")
    chunks = SE.with_semantic_chunks(df, "t", "c", HashingEmbedder(), o).first().c
    assert " ".join(" ".join(chunks).split()) == text and all(len(c.split()) <= 100 for c in chunks) and len(chunks) > 3


def test_pdf_pages_in_the_loop(spark, tmp_dir):
    for name, body in (("a.pdf", b"page one \npage|two\n|three"), ("b.pdf", b""), ("c.txt", b"Plain text."), ("v1.2/d.pdf", b"Another.")):
        os.makedirs(os.path.dirname(f"{tmp_dir}/in/{name}"), exist_ok=True)
        with open(f"{tmp_dir}/in/{name}", "wb") as f:
            f.write(body or b" ")
    registry = VersionedTable(spark, f"{tmp_dir}/files", files_schema())
    chunks = VersionedTable(spark, f"{tmp_dir}/chunks", chunks_schema(), dim=384)
    new = register_paths(registry, [f"{tmp_dir}/in/a.pdf", f"{tmp_dir}/in/b.pdf", f"{tmp_dir}/in/v1.2", f"{tmp_dir}/in/c.txt", f"{tmp_dir}/in/gone.txt"], 1)
    kinds = {os.path.basename(r.file_path): r.file_type for r in new.collect()}
    assert kinds == {"a.pdf": "pdf", "b.pdf": "pdf", "v1.2": None, "c.txt": "txt", "gone.txt": None}

    def reader(batches):
        for b in batches:
            rows = [(p, k, t) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if c.strip() for k, t in enumerate(c.decode().split("|"))]
            yield pa.RecordBatch.from_pylist([{"file_path": p, "page_no": k, "text": t} for p, k, t in rows],
                                             schema=pa.schema([("file_path", pa.string()), ("page_no", pa.int64()), ("text", pa.string())]))

    status = sync_pending(spark, registry, chunks, 5, pdf_pages=lambda pdfs: pdfs.select("path", "content").mapInArrow(reader, "file_path string, page_no long, text string"))
    got = {os.path.basename(r.file_path): (r.progress, r.error) for r in status.collect()}
    assert got == {"a.pdf": (100, None), "b.pdf": (-1, "pdf: no page text supplied"), "v1.2": (100, None), "c.txt": (100, None), "gone.txt": (-1, "missing path")}
    assert {os.path.basename(r.file_path): r.text for r in chunks.read().collect()} == {"a.pdf": "page onepagetwothree", "c.txt": "Plain text.", "d.pdf": "Another."}
    register_paths(registry, [f"{tmp_dir}/in/c.txt"], 9)
    assert {os.path.basename(r.file_path): r.progress for r in registry.read().collect()} == {"a.pdf": 100, "b.pdf": -1, "v1.2": 100, "c.txt": 0, "gone.txt": -1}


def test_model_batches(spark):
    from chunkwise.operators.embed import ArrowEmbedder, EmbedOptions

    m = ArrowEmbedder(lambda t: np.full((len(t), 1), float(len(t))), 1)
    texts = spark.createDataFrame([(f"t{k}",) for k in range(20)], "t string").coalesce(1)
    for size, want in ((3, {3.0, 2.0}), (32, {20.0})):
        assert {r[0][0] for r in texts.select(EmbedOptions(batch_size=size).embedder(m).embed("t")).collect()} == want
