"""The streamed splitter gives the chunks of the assembled text and keeps little."""

import random

import pytest
from pyspark.sql import functions as F

from chunkwise.functions.counter import TokenCounter
from chunkwise.functions.text import normalize_text
from chunkwise.operators import split as SP
from chunkwise.operators.stream_split import PageSplitter, split_pages
from chunkwise.sources.pages import assemble_pages

PIECES = ["word", "two words ", "End. ", "Ende.", "!", "? ", ";", "。", "！ ", "；。", "日本", " ", "  ", "\t", "\n", "\n\n", " \n\t", "\r", "\r\n", "\x0b", " ", "\x85",
          " ", "é", "x" * 9, "3.14", "...", "a b c d e f g", "漢字漢字漢字", "-_-", "😀"]


def assembled(pages, **kw):
    size = kw.pop("size")
    overlap, counter = kw.pop("overlap", 0), kw.pop("counter", None)
    whole = assemble_pages(pages, **kw).select("doc_id", normalize_text(F.col("text")).alias("text"))
    return sorted((r.doc_id, r.pos, r.text) for r in SP.split_tokens(whole, size=size, overlap=overlap, keep=["doc_id"], counter=counter).collect())


def streamed(pages, **kw):
    return sorted((r.doc_id, r.pos, r.text) for r in split_pages(pages, **kw).collect())


@pytest.fixture(scope="module")
def random_pages(spark):
    rng = random.Random(4)
    rows = []
    for d in range(500):
        for p in range(rng.choice([1, 2, 3, 8])):
            rows.append((d, p, None if rng.random() < 0.02 else "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 3, 10, 30])))))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, page_no int, text string").repartition(5).cache()


@pytest.mark.parametrize("kw", [dict(size=7), dict(size=5, overlap=2), dict(size=12, separator="\n", page_separator="\n"), dict(size=40, overlap=10),
                                dict(size=3, page_separator=" "), dict(size=9, separator="\n \n")])
def test_equals_assembled(spark, random_pages, kw):
    assert streamed(random_pages, **kw) == assembled(random_pages, **kw)


def test_equals_assembled_with_a_counter(spark, random_pages):
    c = TokenCounter(lambda a: [len(t) for t in a.to_pylist()], special=1)
    for size in (8, 25):
        assert streamed(random_pages, size=size, counter=c) == assembled(random_pages, size=size, counter=c)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "text").toDF("doc_id", "page_no", "text")
    for size in (20, 256):
        assert streamed(pages, size=size) == assembled(pages, size=size)


def test_memory_stays_flat():
    """A document of thousands of pages, one without any sentence end, and a single endless word."""
    for page in ("A sentence of a page. And one that goes on ", "no end in sight ", "wordwithoutend-", "漢字"):
        s, most, n = PageSplitter(50), 0, 0
        for _ in range(5000):
            n += len(s.feed(page))
            most = max(most, len(s.raw) + len(s.text) + sum(len(t) for t, _, _ in s.units))
        n += len(s.finish())
        assert most < 2000 and n > 90


def test_nulls_and_empties(spark):
    rows = [(None, 1, "Null id."), (None, 2, " Two."), (1, None, "b"), (1, 1, "a"), (2, 1, ""), (3, 1, None), (4, 1, " \n ")]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    assert sorted(map(str, split_pages(pages, size=50).collect())) == [
        "Row(doc_id=1, pos=0, text='ba')", "Row(doc_id=None, pos=0, text='Null id. Two.')"]
    assert split_pages(pages.limit(0)).count() == 0
