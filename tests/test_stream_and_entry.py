"""Streaming ingest equals batch, restarts duplicate nothing; driver contract."""

import os
import re
import shutil

from pyspark.sql import functions as F


def test_stream_equals_batch_and_restart(spark, tmp_dir):
    from chunkwise.plans.ingest import chunk_documents
    from chunkwise.streaming.ingest import stream_documents

    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for i, lang in enumerate(["en", "de", "fr", "es"]):
        docs.where(F.col("lang") == lang).coalesce(1).write.parquet(os.path.join(tmp_dir, f"part{i}"))
        f = [x for x in os.listdir(os.path.join(tmp_dir, f"part{i}")) if x.endswith(".parquet")][0]
        shutil.copy(os.path.join(tmp_dir, f"part{i}", f), os.path.join(src, f"docs{i}.parquet"))
    out, status, ck = (os.path.join(tmp_dir, n) for n in ("chunks", "status", "ck"))
    seen = []
    q = stream_documents(spark, src, out, status, max_files_per_trigger=1, trigger={"availableNow": True},
                         checkpoint=ck, on_batch=lambda df, b: seen.append(b))
    q.awaitTermination()
    assert len(seen) == 4
    streamed = spark.read.parquet(out).select("chunk_id", "text")
    batch = chunk_documents(docs, add_time=0).select("chunk_id", "text")
    assert streamed.count() == batch.count() and streamed.exceptAll(batch).count() == 0
    # restart on the same checkpoint: no new batch, no duplicate rows
    q = stream_documents(spark, src, out, status, max_files_per_trigger=1, trigger={"availableNow": True},
                         checkpoint=ck)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == batch.count()
    st = spark.read.parquet(status)
    assert st.where("progress = 100").select("file_path").distinct().count() == docs.count()


def test_entry_and_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["query_id", "n_hits", "markdown"] and len(rows) > 0
    assert any(r["markdown"].startswith("### File: ") for r in rows)
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    # every query of the reference's operators has a SQL statement
    own = {n for n in q if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own <= set(s) and len(own) > 50


def test_stream_of_a_table_that_is_a_folder(spark, tmp_dir):
    """x1_stream_ingest reads ``documents.parquet`` whether it is one file or a folder of files."""
    import __spark_entry__ as E

    rows = [(i, f"Text {i}. More of it.", "en", "web", 20) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_dir}/folder/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_dir}/one")
    part, = (n for n in os.listdir(f"{tmp_dir}/one") if n.endswith(".parquet"))
    os.mkdir(f"{tmp_dir}/file")
    os.rename(f"{tmp_dir}/one/{part}", f"{tmp_dir}/file/documents.parquet")
    docs.limit(1).write.parquet(f"{tmp_dir}/folder/other.parquet")
    for kind in ("folder", "file"):
        got = E.q_x1_stream_ingest(spark, f"{tmp_dir}/{kind}").collect()
        assert sorted(r["chunk_id"] for r in got) == [f"web/{i}.txt#0000000000" for i in range(9)]


def test_source_files_and_many_small_files(spark, tmp_dir, monkeypatch):
    """A stream's source has as many files as its bytes want; small files are read in few tasks."""
    import __spark_entry__ as E
    from chunkwise.session import gather
    from chunkwise.sources.files import list_files

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_dir}/docs")
    docs = spark.read.parquet(f"{tmp_dir}/docs")
    assert E._in_files(docs, 2).rdd.getNumPartitions() == 2
    monkeypatch.setattr(E, "SOURCE_FILE_BYTES", 100)
    assert E._in_files(docs, 2).rdd.getNumPartitions() > 10
    E._file_each(docs.where("doc_id < 200")).text(f"{tmp_dir}/tree")
    files = list_files(spark, f"{tmp_dir}/tree")
    few = gather(files.repartition(100))
    assert few.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism and few.count() == files.count() == 200
