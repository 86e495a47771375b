"""File-tree ingest (E4, D12), the binaryFile stream, and the pluggable embedder."""

import os
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chunkwise.operators.embed import ArrowEmbedder, HashingEmbedder

# the model stand-in below runs in Python workers, which cannot import this file
from pyspark import cloudpickle  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _tree(root):
    os.makedirs(os.path.join(root, "docs", "sub"))
    long_text = " ".join(f"Sentence number {i} talks about topic {i % 7}." for i in range(300))
    files = {"docs/a.txt": long_text, "docs/sub/b.md": "# Title\n\nSome *markdown* body text.",
             "docs/c.csv": "x,y", "docs/noext": "z"}
    for name, body in files.items():
        with open(os.path.join(root, name), "w") as f:
            f.write(body)
    return os.path.join(root, "docs")


def test_chunk_files_keeps_root_and_failures(spark, tmp_dir):
    from chunkwise.plans.files import chunk_files, files_under

    root = _tree(tmp_dir)
    files, missing = files_under(spark, [root, os.path.join(tmp_dir, "nope")])
    assert missing == [os.path.join(tmp_dir, "nope")]
    chunks, failures = chunk_files(files, size=64, now=123)
    rows = chunks.collect()
    assert {os.path.basename(r["file_path"]) for r in rows} == {"a.txt", "b.md"}
    assert all(r["root_path"] == root and r["add_time"] == 123 and len(r["embedding"]) == 384 for r in rows)
    a = sorted((r for r in rows if r["file_path"].endswith("a.txt")), key=lambda r: r["pos"])
    assert len(a) > 3 and [r["pos"] for r in a] == list(range(len(a)))
    assert len({r["chunk_id"] for r in rows}) == len(rows)
    bad = {os.path.basename(r["file_path"]): r["error"] for r in failures.collect()}
    assert set(bad) == {"c.csv", "noext"}


def test_stream_files_status(spark, tmp_dir):
    from pyspark.sql import functions as F

    from chunkwise.streaming.ingest import stream_files
    from chunkwise.streaming.status import latest_status

    root = _tree(tmp_dir)
    out, status, ck = (os.path.join(tmp_dir, n) for n in ("chunks", "status", "ck"))
    q = stream_files(spark, root, out, status, max_files_per_trigger=2, trigger={"availableNow": True},
                     checkpoint=ck, size=64)
    q.awaitTermination()
    log = spark.read.parquet(status)
    stages = {os.path.basename(r["file_path"]): sorted(r["p"]) for r in log.groupBy("file_path").agg(F.collect_list("progress").alias("p")).collect()}
    assert stages == {"a.txt": [1, 50, 100], "b.md": [1, 50, 100], "c.csv": [-1, 1], "noext": [-1, 1]}
    st = {os.path.basename(r["file_path"]): r["progress"] for r in latest_status(log).collect()}
    assert st == {"a.txt": 100, "b.md": 100, "c.csv": -1, "noext": -1}
    assert spark.read.parquet(out).select("file_path").distinct().count() == 2


def _bow(texts: pa.Array) -> np.ndarray:
    """A small non-linear model stand-in: squared word counts over 16 buckets."""
    out = np.zeros((len(texts), 16))
    for i, t in enumerate(texts.to_pylist()):
        for w in (t or "").lower().split():
            out[i, sum(map(ord, w)) % 16] += 1
    return out ** 2


def test_arrow_embedder_and_semantic_reembed(spark):
    from chunkwise.functions.text import normalize_text
    from chunkwise.operators.semantic import SemanticOptions, segment_document, with_semantic_chunks
    from chunkwise.operators.split import with_token_chunks
    from chunkwise.functions.text import token_count

    e = ArrowEmbedder(_bow, 16)
    df = spark.createDataFrame([("alpha beta",), ("",), (None,)], "text string")
    vecs = [r[0] for r in df.select(e.embed("text")).collect()]
    assert vecs[0] is not None and len(vecs[0]) == 16 and vecs[1] is None and vecs[2] is None

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 3000").select(
        "doc_id", normalize_text(F.col("text")).alias("t"))
    o = SemanticOptions(piece_size=80, batch_size=3)
    got = {r["doc_id"]: [list(g) for g in r["groups"]]
           for r in with_semantic_chunks(docs, "t", "c", e, o, groups_col="groups").collect()}
    pieces = with_token_chunks(docs, "t", "p", size=80).select(
        "doc_id", "p", F.transform("p", lambda x: token_count(x)).alias("tc")).collect()
    for r in pieces:
        texts = list(r["p"])
        vec = _bow(pa.array(texts))

        def reembed(members, texts=texts):
            return _bow(pa.array(["\n".join(texts[m] for m in members)]))[0]

        assert got[r["doc_id"]] == segment_document(list(r["tc"]), vec, o, raw=False, reembed=reembed)


def test_hashing_embedder_linear(spark):
    e = HashingEmbedder(dim=32)
    df = spark.createDataFrame([(["Hello world", "again, hello"],)], "p array<string>")
    r = df.select(e.embed_many_raw("p").alias("raw"), e.embed(F.array_join("p", "\n")).alias("joined")).first()
    s = np.array(r["raw"][0]) + np.array(r["raw"][1])
    assert np.allclose(s / np.linalg.norm(s), np.array(r["joined"]), atol=1e-6)


def test_embedders_hold_some_rows_at_a_time(monkeypatch):
    """The token codes of a large Arrow batch are never held at once; any step gives the same vectors and groups."""
    import numpy as np
    import pyarrow as pa

    from chunkwise.operators import embed as EM
    from chunkwise.operators import semantic as SE

    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 300, n)]
    toks = pa.array([None if i % 50 == 7 else words(i % 9) for i in range(1500)], pa.list_(pa.string()))
    docs = [[words(120) for _ in range(i % 6)] for i in range(400)]
    counts = pa.array([[122] * len(d) for d in docs], pa.list_(pa.int32()))
    pieces = pa.array(docs, pa.list_(pa.list_(pa.string())))
    most, dense = [], EM._dense_from_codes

    def watched(values, lengths, *more):
        most.append(len(lengths))
        return dense(values, lengths, *more)

    monkeypatch.setattr(EM, "_dense_from_codes", watched)
    seen = set()
    for step in (512, 1 << 30, 10):
        monkeypatch.setattr(EM, "ROWS", step)
        most.clear()
        vectors = EM._scatter_udf(384).func(toks)
        chunks = SE._hashing_segment_udf(SE.SemanticOptions(), 384).func(counts, pieces)
        assert max(most) <= min(step, 1500) and len(vectors) == 1500 and len(chunks) == 400
        seen.add((str(vectors.to_pylist()), str(chunks.to_pylist())))
    assert len(seen) == 1


def test_a_file_for_each_key_is_written_by_the_tasks(spark, tmp_dir):
    """The same folders and lines as Spark's writer, repeated and missing keys and texts included, without Hadoop's
    checksum files (each of which costs a process for its permissions)."""
    import pytest

    from chunkwise.sources.files import FileEach

    rows = [(i, f"text {i}\nsecond, \"line\" {i}") for i in range(40)] + [(7, "again"), (None, "no key"), (None, "no key"), (41, None), (42, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for kind in ("text", "csv"):
        here, there = f"{tmp_dir}/{kind}", f"{tmp_dir}/spark-{kind}"
        getattr(FileEach(df, "doc_id"), kind)(here)
        getattr(df.repartition(4, "doc_id").write.partitionBy("doc_id"), kind)(there)

        def tree(at):
            return {d[len(at):]: sorted(line for f in files if f.startswith("part-") for line in open(f"{d}/{f}").read().splitlines())
                    for d, _, files in os.walk(at) if d != at}

        assert len(tree(here)) == 43 and tree(here) == tree(there)
        names = [f for _, _, files in os.walk(here) for f in files]
        assert len(names) == 43 and all(f.startswith("part-") and f.endswith({"text": ".txt", "csv": ".csv"}[kind]) for f in names)
        with pytest.raises(Exception):
            getattr(FileEach(df, "doc_id"), kind)(here)
    FileEach(df.where("doc_id < 0"), "doc_id").text(f"{tmp_dir}/none")
    assert os.listdir(f"{tmp_dir}/none") == []


def test_a_file_writing_task_that_is_repeated_doubles_nothing(tmp_dir, monkeypatch):
    from types import SimpleNamespace

    from chunkwise.sources import files as FI

    batch = pa.RecordBatch.from_pydict({"folder": ["k=1", "k=1", "k=2"], "line": ["a\n", "b\n", "c\n"]})
    write = FI._folder_writer(tmp_dir, "n.txt")
    for attempt in (0, 1):
        task = SimpleNamespace(partitionId=lambda: 3, taskAttemptId=lambda attempt=attempt: attempt)
        monkeypatch.setattr(FI, "TaskContext", SimpleNamespace(get=lambda task=task: task))
        assert next(write(iter([batch]))).column(0).to_pylist() == [2]
    assert {d: os.listdir(f"{tmp_dir}/{d}") for d in os.listdir(tmp_dir)} == {k: ["part-00003-n.txt"] for k in ("k=1", "k=2")}
    assert open(f"{tmp_dir}/k=1/part-00003-n.txt").read() == "a\nb\n"


def test_large_files_are_dealt_out(spark, tmp_dir):
    """Spark reads files in the order of their sizes: the texts are dealt anew, so that no task has all large ones."""
    from chunkwise.plans.files import files_under, staged_texts
    from chunkwise.session import gathered_tasks

    os.makedirs(f"{tmp_dir}/tree")
    for i in range(64):
        with open(f"{tmp_dir}/tree/{i}.txt", "w") as f:
            f.write(f"Text {i}. " * (5000 if i < 8 else 1))
    files, _ = files_under(spark, [f"{tmp_dir}/tree"])
    texts = staged_texts(files)
    large = texts.where("size > 10000").groupBy(F.col("_metadata.file_name")).count().collect()
    assert texts.count() == 64 and sum(r["count"] for r in large) == 8 and max(r["count"] for r in large) < 8
    assert gathered_tasks(files) % spark.sparkContext.defaultParallelism == 0
