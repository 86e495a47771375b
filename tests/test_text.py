"""Text functions against plain-Python statements."""

import re

import regex
from pyspark.sql import functions as F

from chunkwise.functions import text as TX
from chunkwise.operators import split as SP

DIRTY = ["  a b  \n\n\n\t c\t\n d ", "\n\nx\n", "", "one", " \n \n ", "l1\nl2\n\nl3\n\n\n\nl4"]


def py_clean(t):
    lines = [ln.strip(" \t") for ln in t.split("\n")]
    return "\n".join(ln for ln in lines if ln)


def py_fold(t):
    return t.replace("\n\n", "\x01").replace("\n", " ").replace("\x01", "\n\n")


TOK = regex.compile(r"[一-鿿]|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")


def test_clean_and_fold(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(DIRTY)], "id long, text string")
    rows = df.select("id", TX.clean_text("text").alias("c"), TX.fold_newlines("text").alias("f"),
                     TX.normalize_text(F.col("text")).alias("n")).orderBy("id").collect()
    for r in rows:
        src = DIRTY[r["id"]]
        assert r["c"] == py_clean(src)
        assert r["f"] == py_fold(src)
        assert r["n"] == py_fold(py_clean(src))  # D2: nothing double is left after cleaning
        assert "\n" not in r["n"]


def test_token_count(spark):
    texts = ["Hello, world!", "中文字 abc12 ..", "", "  ", "é-è ü"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(TX.token_count("text")).collect()]
    assert got == [len(TOK.findall(t)) + 2 for t in texts]


def py_pack_sentences(text, n):
    if not text:
        return []
    if len(text.encode()) < n:
        return [text]
    sents = re.split(r"[.;]", text)
    if text[-1] in ".;":
        sents = sents[:-1]
    out, cur = [], []
    for s in sents:
        cur.extend((s + ".").split())
        if len(cur) >= n:
            out.append(" ".join(cur))
            cur = []
    if cur:
        out.append(" ".join(cur))
    return out


def test_sentence_packer(spark):
    texts = ["", "short", "a b. c d; e f g. h", "x. y. z.", "one two three four five six. seven;", "..;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = df.select("id", SP.pack_sentences(F.col("text"), 3).alias("c")).orderBy("id").collect()
    for r in rows:
        assert list(r["c"]) == py_pack_sentences(texts[r["id"]], 3), texts[r["id"]]


def test_token_chunks_properties(spark):
    """Every non-blank character kept in order; chunks within budget."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", TX.normalize_text(F.col("text")).alias("text"))
    size = 64
    ch = SP.split_tokens(docs, "text", size=size, keep=["doc_id"])
    per_doc = ch.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))),
                                                                  lambda x: x["text"]), "").alias("joined"),
                                       F.max(TX.token_count("text")).alias("max_tok"))
    src = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in per_doc.collect():
        assert re.sub(r"\s", "", r["joined"]) == re.sub(r"\s", "", src[r["doc_id"]])
        assert r["max_tok"] <= size


def test_overlap_repeats_tail(spark):
    text = " ".join(f"w{i}." for i in range(40))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    plain = [r["text"] for r in SP.split_tokens(df, size=12, keep=["doc_id"]).orderBy("pos").collect()]
    over = [r["text"] for r in SP.split_tokens(df, size=12, overlap=4, keep=["doc_id"]).orderBy("pos").collect()]
    assert " ".join(plain).split() == text.split()
    assert len(over) > len(plain)
    for a, b in zip(over, over[1:]):
        assert a.split()[-1] in b.split()


def test_epoch_seconds(spark):
    """Epoch seconds of timestamps (session time zone UTC)."""
    import datetime

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", TX.epoch_seconds("ts").alias("e"))
    for r in ev.limit(50).collect():
        assert r["e"] == int(r["ts"].replace(tzinfo=datetime.timezone.utc).timestamp() // 1)
    assert spark.range(1).select(TX.epoch_seconds().alias("now")).first()["now"] > 1_600_000_000


def test_splitter_is_linear_in_text_length(spark):
    """English, unspaced full-width text and overlap: eight times the text, no more than
    about eight times the work (quadratic would be sixty-four)."""
    import time

    from pyspark.sql import functions as F

    from chunkwise.operators import split as SP

    kinds = {"english": ("The miller counts his sacks before the market opens. ", 0),
             "cjk": ("这是一个关于河流和磨坊的测试句子。", 0), "unspaced": ("磨坊河流", 0), "overlap": ("The miller counts his sacks before the market opens. ", 32)}
    for name, (unit, overlap) in kinds.items():
        def run(chars, unit=unit, overlap=overlap):
            df = spark.createDataFrame([(1, (unit * (chars // len(unit) + 1))[:chars])], "id int, text string")
            t = time.time()
            n = SP.split_tokens(df, "text", size=256, overlap=overlap, keep=["id"]).agg(F.sum(F.length("text"))).first()[0]
            assert n >= chars * 0.95
            return time.time() - t
        run(1000)
        small, large = min(run(50_000), run(50_000)), min(run(400_000), run(400_000))
        assert large <= 20 * max(small, 0.3), (name, small, large)


def test_wide_sentence_ends(spark):
    from chunkwise.operators import split as SP

    df = spark.createDataFrame([(1, "第一句。第二句！！第三句？ Last one. End; x\ny \u0001z")], "id int, text string")
    row = df.select(SP.sentences("text").alias("s"), SP.token_chunks("text", 400).alias("c")).first()
    assert row["s"] == ["第一句。", "第二句！！", "第三句？", "Last one.", "End;", "x", "y \u0001z"]
    assert row["c"] == ["第一句。第二句！！第三句？Last one. End; x y \u0001z"]
