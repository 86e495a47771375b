"""Streams into the chunk table, the registry as a source, status order, reads after many changes."""

import os

import pytest
from pyspark.sql import functions as F

from chunkwise.operators import scan as SC
from chunkwise.plans.ingest import chunk_documents
from chunkwise.plans.sync import remove_paths, retry_failed, sync_pending
from chunkwise.schemas import chunks_schema, files_schema, status_log_schema
from chunkwise.sources.tables import CommitConflict, VersionedTable
from chunkwise.streaming.ingest import DOCUMENTS_SCHEMA
from chunkwise.streaming.status import latest_status, status_view
from chunkwise.streaming.table_sink import store_batch, stream_documents_into, stream_registry

ONCE = {"availableNow": True}


def tables(spark, at):
    return (VersionedTable(spark, f"{at}/files", files_schema()), VersionedTable(spark, f"{at}/chunks", chunks_schema(), dim=384),
            VersionedTable(spark, f"{at}/log", status_log_schema()))


def drop(spark, rows, at):
    full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(full, DOCUMENTS_SCHEMA).coalesce(1).write.mode("append").parquet(at)


def texts(table):
    return sorted((r.file_path, r.pos, r.text) for r in table.read().collect())


def batch_texts(spark, rows):
    docs = spark.createDataFrame([(i, t, "src") for i, t in rows], "doc_id long, text string, source string")
    return sorted((r.file_path, r.pos, r.text) for r in chunk_documents(docs).collect())


def test_stream_replaces_by_path(spark, tmp_dir):
    _, chunks, log = tables(spark, tmp_dir)
    src = f"{tmp_dir}/in"

    def run():
        stream_documents_into(chunks, src, f"{tmp_dir}/ck", status_log=log, max_files_per_trigger=1, trigger=ONCE).awaitTermination()

    drop(spark, [(1, "First text. " * 100), (2, "Second text."), (3, "Third text.")], src)
    run()
    assert texts(chunks) == batch_texts(spark, [(1, "First text. " * 100), (2, "Second text."), (3, "Third text.")])
    drop(spark, [(1, "First text, shorter."), (3, " ")], src)
    drop(spark, [(4, "Fourth."), (4, "Fourth.")], src)
    run()
    now = [(1, "First text, shorter."), (2, "Second text."), (4, "Fourth.")]
    assert texts(chunks) == batch_texts(spark, now)
    last = {r.file_path: (r.progress, r.error) for r in latest_status(log.read()).collect()}
    assert last == {"src/1.txt": (100, None), "src/2.txt": (100, None), "src/3.txt": (-1, "no text"), "src/4.txt": (100, None)}
    version = chunks.current_version()
    run()
    assert chunks.current_version() == version


def test_replayed_batch_changes_nothing(spark, tmp_dir):
    _, chunks, log = tables(spark, tmp_dir)
    make = lambda t: chunk_documents(t, add_time=1)
    rows = lambda r: spark.createDataFrame(r, "doc_id long, text string, source string").withColumn(
        "file_path", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt"))).withColumn("error", F.lit(None).cast("string"))
    one = rows([(1, "Some text.", "s"), (2, "", "s")])
    store_batch(one, make, chunks, log, ("q", 0))
    before, n = texts(chunks), log.read().count()
    # lost after the chunks' commit, before the last status rows: a second log without that stage
    half = VersionedTable(spark, f"{tmp_dir}/log2", status_log_schema())
    store_batch(one, make, chunks, half, ("q", 0))
    assert texts(chunks) == before and sorted(r.progress for r in half.read().collect()) == [-1, 1, 1, 50, 100]
    store_batch(one, make, chunks, log, ("q", 0))
    assert log.read().count() == n and chunks.committed_batch("q") == 0
    store_batch(rows([(1, "Other text.", "s")]), make, chunks, log, ("other", 0))
    assert [t[2] for t in texts(chunks)] == ["Other text."]
    chunks.compact(1)
    assert chunks.committed_batch("q") == 0 and chunks.committed_batch("other") == 0


def test_registry_stream(spark, tmp_dir):
    registry, chunks, log = tables(spark, tmp_dir)

    def put(name, text):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(text)
        return os.path.join(tmp_dir, name)

    def register(paths, at):
        registry.append(SC.registry_rows(spark.createDataFrame([(p,) for p in paths], "file_path string"), at))

    clock = iter(range(1000, 2000))

    def run():
        stream_registry(registry, chunks, f"{tmp_dir}/ck", lambda: next(clock), status_log=log, limit=2, commits_per_trigger=1, trigger=ONCE).awaitTermination()

    a, b, c = (put(f"{n}.txt", f"Text of {n}.") for n in "abc")
    late, bad = os.path.join(tmp_dir, "late.txt"), put("bad.docx", "no zip")
    register([a, b, c], 1)
    register([late, bad], 2)
    run()
    state = lambda: {r.file_path: r.progress for r in registry.read().collect()}
    assert state() == {a: 100, b: 100, c: 100, late: -1, bad: -1}
    # registered late, and retried
    d = put("d.txt", "Text of d.")
    put("late.txt", "Here at last.")
    put("a.txt", "Another text.")
    register([d], 3)
    retry_failed(registry, 4)
    remove_paths(registry, chunks, spark.createDataFrame([(b,)], "file_path string"))
    registry.change(spark.createDataFrame([(a,)], "file_path string"), "file_path",
                    SC.registry_rows(spark.createDataFrame([(a,)], "file_path string"), 5))
    run()
    assert state() == {a: 100, c: 100, d: 100, late: 100, bad: -1}
    assert sorted(r.text for r in chunks.read().collect()) == ["Another text.", "Here at last.", "Text of c.", "Text of d."]
    last = {r.file_path: r.progress for r in latest_status(log.read()).collect()}
    assert last[bad] == -1 and last[late] == 100
    run()
    assert state()[bad] == -1 and SC.pending(registry.read(), 5).isEmpty()


def test_failed_file_stays_failed(spark, tmp_dir):
    registry, chunks, log = tables(spark, tmp_dir)
    os.makedirs(f"{tmp_dir}/tree")
    for name, text in (("good.txt", "Some text."), ("bad.docx", "no zip"), ("empty.txt", " \n")):
        with open(f"{tmp_dir}/tree/{name}", "w") as f:
            f.write(text)
    registry.append(SC.registry_rows(spark.createDataFrame([(f"{tmp_dir}/tree",)], "file_path string"), 1))
    sync_pending(spark, registry, chunks, 5, status_log=log)
    last = {os.path.basename(r.file_path): (r.progress, r.error) for r in latest_status(log.read()).collect()}
    assert last["good.txt"] == (100, None) and last["empty.txt"] == (-1, "no text")
    assert last["bad.docx"][0] == -1 and last["bad.docx"][1]
    view = {r.file_path: r.progress for r in status_view(registry.read(), log.read()).collect()}
    assert view == {f"{tmp_dir}/tree": 100}


def test_many_changes_read_by_one_join(spark, tmp_dir):
    t = VersionedTable(spark, f"{tmp_dir}/t", files_schema())
    row = lambda p, n: SC.registry_rows(spark.createDataFrame([(p,)], "file_path string"), n)
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "file_path string")
    t.append(row("a", 0).union(row("b", 0)).union(row("c", 0)))
    for k in range(1, 13):
        t.change(paths("a"), "file_path", row("a", k))
    t.change(paths("b"), "file_path")
    t.append(row("b", 50))
    t.change(spark.createDataFrame([("c", 0)], "name string, add_time long"), ["name", "add_time"], row("d", 1))
    assert {r.file_path: r.add_time for r in t.read().collect()} == {"a": 12, "b": 50, "d": 1}
    plan = t.read()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2  # one for each set of key columns
    t.compact(1)
    assert {r.file_path: r.add_time for r in t.read().collect()} == {"a": 12, "b": 50, "d": 1}
    assert "Join" not in t.read()._jdf.queryExecution().optimizedPlan().toString()


def test_second_writer_tries_again(spark, tmp_dir):
    one, two = (VersionedTable(spark, f"{tmp_dir}/t", files_schema()) for _ in range(2))
    row = lambda p, n: SC.registry_rows(spark.createDataFrame([(p,)], "file_path string"), n)
    commit, first = one._commit, []

    def late(version, *rest):
        if not first:
            first.append(two.append(row("other", 1)))
        return commit(version, *rest)

    one._commit = late
    assert one.change(spark.createDataFrame([("other",)], "file_path string"), "file_path", row("mine", 2)) == 2
    assert [r.file_path for r in one.read().collect()] == ["mine"]
    with pytest.raises(CommitConflict):
        commit(2, [])


def test_staged_rows_are_written_once(spark, tmp_dir):
    one, two = (VersionedTable(spark, f"{tmp_dir}/t", files_schema()) for _ in range(2))
    row = lambda p, n: SC.registry_rows(spark.createDataFrame([(p,)], "file_path string"), n)
    key = spark.createDataFrame([("mine",)], "file_path string")
    staged = one.stage(row("mine", 2).drop("sync_time"))
    (folder,) = staged.folders
    assert one.read().isEmpty() and [(r.file_path, r.sync_time) for r in staged.read().collect()] == [("mine", None)]
    assert one.change(key, "file_path", staged) == 1 and one.manifest() == [folder]
    # another writer takes the version: the folder is renamed, so that its rows outlive that writer's delete
    late = one.stage(row("mine", 3))
    (folder,) = late.folders
    two.change(key, "file_path")
    assert one.change(key, "file_path", late) == 3
    assert folder not in one.manifest() and [r.add_time for r in one.read().collect()] == [3]
    assert [r.add_time for r in late.read().collect()] == [3]
    assert len([f for f in os.listdir(f"{tmp_dir}/t") if f.startswith("w=")]) == 2


def test_batches_and_steps_write_their_chunks_once(spark, tmp_dir, monkeypatch):
    _, chunks, log = tables(spark, tmp_dir)
    writes, stage, write = [], VersionedTable.stage, VersionedTable._write
    monkeypatch.setattr(VersionedTable, "stage", lambda self, df: (writes.append("stage"), stage(self, df))[1])
    monkeypatch.setattr(VersionedTable, "_write", lambda self, df, *a: (
        writes.append(self.path) if hasattr(df, "write") and self is chunks else None, write(self, df, *a))[1])
    rows = spark.createDataFrame([(1, "Some text.", "s", "s/1.txt"), (2, "", "s", "s/2.txt")], "doc_id long, text string, source string, file_path string")
    store_batch(rows.withColumn("error", F.lit(None).cast("string")), lambda t: chunk_documents(t, add_time=1), chunks, log, ("q", 0))
    assert writes == ["stage", chunks.path] and [t[2] for t in texts(chunks)] == ["Some text."]


def test_shuffle_files_go_with_their_query(spark, tmp_dir):
    import time

    from chunkwise.session import shuffles_removed

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = disk.getAllFiles()  # a copy: others come and go
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", held()
    usual = spark.conf.get(key)
    with shuffles_removed(spark):
        assert spark.conf.get(key) == "true"
        spark.range(1000).repartition(5).write.parquet(f"{tmp_dir}/out")
    for _ in range(100):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(key) == usual and spark.read.parquet(f"{tmp_dir}/out").count() == 1000


def test_spread_runs_no_shuffle_to_count_its_tasks(spark):
    from chunkwise.session import spread

    rows = spark.createDataFrame([(i % 7, i) for i in range(100)], "k long, v long").repartition(3, "k").groupBy("k").sum("v")
    spark.sparkContext.setJobGroup("spread", "spread")
    try:
        assert spread(rows) is rows
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("spread")) == 0
    finally:
        spark.sparkContext._jsc.clearJobGroup()
