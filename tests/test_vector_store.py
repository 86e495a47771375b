"""Vectors by digest of the text, and the table of latest statuses that a stream keeps."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwise.operators.embed import ArrowEmbedder
from chunkwise.operators.vector_store import VectorStore
from chunkwise.schemas import status_log_schema
from chunkwise.sources.tables import VersionedTable
from chunkwise.streaming.status import latest_status
from chunkwise.streaming.table_sink import stream_status


def sizes(dim=2):
    return ArrowEmbedder(lambda t: np.array([[len(x or ""), 1.0] if x != "none" else [0, 0] for x in t.to_pylist()], np.float32).reshape(-1, dim), dim)


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_only_new_texts_meet_the_model(spark, tmp_dir, bound):
    seen = spark.sparkContext.accumulator(0)

    def counting(texts):
        seen.add(len(texts))
        return np.array([[len(x), 1.0] if x != "none" else [0, 0] for x in texts.to_pylist()], np.float32).reshape(-1, 2)

    store, model = VectorStore(spark, f"{tmp_dir}/v", "m"), ArrowEmbedder(counting, 2)
    rows = lambda *t: spark.createDataFrame(list(enumerate(t)), "id int, text string")
    out = lambda df: {r.id: r.embedding and r.embedding[0] for r in df.collect()}
    first = rows(*["same"] * 50, "aa", "bbb", "none", None, "")
    assert out(store.embed(first, model, max_broadcast_rows=bound)) == {**{k: 4.0 for k in range(50)}, 50: 2.0, 51: 3.0, 52: None, 53: None, 54: 0.0}
    assert seen.value == 5
    assert out(store.embed(rows("aa", "same", "cc", "none"), model, max_broadcast_rows=bound)) == {0: 2.0, 1: 4.0, 2: 2.0, 3: None}
    assert seen.value == 6
    assert out(store.embed(rows("aa").limit(0), model)) == {} and seen.value == 6
    # another model has vectors of its own; columns of the same names are replaced
    other = VectorStore(spark, f"{tmp_dir}/v", "n")
    got = other.embed(rows("aa").withColumn("embedding", F.array(F.lit(9.0).cast("float"))).withColumn("digest", F.lit("x")), model)
    assert got.columns == ["id", "text", "digest", "embedding"] and out(got) == {0: 2.0} and seen.value == 7


def test_sync_again_embeds_nothing(spark, tmp_dir):
    from chunkwise.plans.sync import register_paths, sync_pending
    from chunkwise.schemas import chunks_schema, files_schema

    registry = VersionedTable(spark, f"{tmp_dir}/files", files_schema())
    chunks = VersionedTable(spark, f"{tmp_dir}/chunks", chunks_schema(), dim=2)
    store = VectorStore(spark, f"{tmp_dir}/v", "m")
    path = f"{tmp_dir}/a.txt"
    for text, n in (("One text here. " * 40, 1), ("One text here. " * 40, 1), ("Another text.", 2)):
        with open(path, "w") as f:
            f.write(text)
        register_paths(registry, [path], 1)
        assert [r.progress for r in sync_pending(spark, registry, chunks, 5, embedder=sizes(), vectors=store).collect()] == [100]
        assert store.table.read().count() == n
        assert [(r.embedding[0], len(r.text)) for r in chunks.read().collect()] == [(float(len(text.strip())), len(text.strip()))]


def test_latest_statuses(spark, tmp_dir):
    log, latest = (VersionedTable(spark, f"{tmp_dir}/{n}", status_log_schema()) for n in ("log", "latest"))
    at = dt.datetime(2024, 1, 1)
    later = dt.datetime(2024, 1, 2)

    def put(*rows):
        log.append(spark.createDataFrame([(p, n, t, e, s) for p, n, t, e, s in rows], status_log_schema()))

    def run():
        stream_status(log, latest, f"{tmp_dir}/ck", commits_per_trigger=2, trigger={"availableNow": True}).awaitTermination()
        key = lambda df: sorted(map(tuple, df.select("file_path", "progress", "error").collect()))
        assert key(latest.read()) == key(latest_status(log.read()))
        return {r.file_path: r.progress for r in latest.read().collect()}

    put(("a", 1, at, None, 1), ("a", 100, at, None, 1), ("b", 1, at, None, 1))
    put(("b", -1, at, "bad", 1), ("c", 1, later, None, 2))
    assert run() == {"a": 100, "b": -1, "c": 1}
    put(("c", 100, at, None, 1), ("b", 0, at, None, 2), ("d", 50, at, None, 1))  # late for c, a retry of b in the same second
    log.compact(1, keep=1)
    put(("d", 100, at, None, 1))
    assert run() == {"a": 100, "b": 0, "c": 1, "d": 100}
    version = latest.current_version()
    assert run() == {"a": 100, "b": 0, "c": 1, "d": 100} and latest.current_version() == version
