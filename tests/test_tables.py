"""The reference's asserting storage tests (registry, chunk table, settings), re-stated."""

import time

from pyspark.sql import functions as F

from chunkwise.operators import mutate as MU
from chunkwise.operators import scan as SC
from chunkwise.operators.retrieve import nearest, top_k
from chunkwise.schemas import chunks_schema, files_schema, settings_schema
from chunkwise.sources.tables import VersionedTable


def test_registry_insert_scan_pending_update(spark, tmp_dir):
    t = VersionedTable(spark, f"{tmp_dir}/files", files_schema())
    now = int(time.time())
    paths = spark.createDataFrame([("test_files",), ("test_files/test.md",)], "file_path string")
    t.append(SC.registry_rows(paths, now))
    rows = {r["file_path"]: r for r in t.read().collect()}
    assert len(rows) == 2
    assert rows["test_files"]["name"] == "test_files" and rows["test_files"]["file_type"] is None
    assert rows["test_files/test.md"]["name"] == "test.md" and rows["test_files/test.md"]["file_type"] == "md"
    assert all(r["add_time"] > 0 and r["sync_time"] == 0 and r["progress"] == 0 for r in rows.values())
    assert SC.pending(t.read(), 10).count() == 2
    upd = spark.createDataFrame([("test_files/test.md", 100)], "file_path string, progress int")
    t.replace(MU.update_progress(t.read(), upd, now + 5))
    rows = {r["file_path"]: r for r in t.read().collect()}
    assert rows["test_files/test.md"]["progress"] == 100 and rows["test_files/test.md"]["sync_time"] > 0
    assert rows["test_files"]["progress"] == 0 and rows["test_files"]["sync_time"] == 0
    assert [r["file_path"] for r in SC.pending(t.read(), 10).collect()] == ["test_files"]


def _chunk_rows(spark, vecs):
    now = int(time.time())
    return spark.createDataFrame(
        [(f"test_path#{i:010d}", "test_path", "test_path", i, txt, [float(x) for x in v], now) for i, (txt, v) in enumerate(vecs)],
        chunks_schema())


def test_chunk_table_scan_top1_delete(spark, tmp_dir):
    t = VersionedTable(spark, f"{tmp_dir}/chunks", chunks_schema(), dim=384)
    ones, twos = [1.0] * 384, [2.0] * 384
    other = [1.0] * 192 + [-1.0] * 192
    t.append(_chunk_rows(spark, [("你好，世界", ones), ("测试文本", twos), ("另一个", other)]))
    assert t.read().count() == 3
    hit = nearest(t.read(), ones, k=1, corpus_id="chunk_id").collect()
    # 1.0 and 2.0 vectors are cosine-identical: the id breaks the tie
    assert [r["text"] for r in hit] == ["你好，世界"]
    hits = nearest(t.read(), ones, k=5, corpus_id="chunk_id").collect()
    assert [r["chunk_id"] for r in hits] == ["test_path#0000000000", "test_path#0000000001"]  # the orthogonal vector is beyond 0.6
    t.replace(MU.delete_keys(t.read(), spark.createDataFrame([("test_path",)], "file_path string"), "file_path"))
    assert t.read().count() == 0


def test_vector_size_checked(spark, tmp_dir):
    import pytest
    t = VersionedTable(spark, f"{tmp_dir}/chunks2", chunks_schema(), dim=384)
    with pytest.raises(Exception):
        t.append(_chunk_rows(spark, [("x", [1.0] * 10)]))


def test_settings_insert_scan_predicate_update_flag(spark, tmp_dir):
    t = VersionedTable(spark, f"{tmp_dir}/settings", settings_schema())
    now = int(time.time())
    t.append(spark.createDataFrame([(1, "https://api.example.org/v1", "token1", True, now)], settings_schema()))
    assert t.read().count() == 1
    assert SC.available(t.read(), 10).count() == 1
    r = SC.lookup(t.read(), "id", 1).collect()[0]
    assert r["url"].endswith("/v1") and r["token"] == "token1"
    ch = spark.createDataFrame([(1, "https://api.example.org/v2", "new_token2")], "id long, url string, token string")
    t.replace(MU.upsert_token(t.read(), ch, now + 1))
    r = SC.lookup(t.read(), "id", 1).collect()[0]
    assert r["url"].endswith("/v2") and r["token"] == "new_token2" and r["state"]
    t.replace(MU.set_state(t.read(), spark.createDataFrame([(1,)], "id long"), False, now + 2))
    assert SC.available(t.read(), 10).count() == 0
    t.replace(MU.update_token(t.read(), ch, now + 3))
    assert SC.available(t.read(), 10).count() == 1  # update resets state to true
    # upsert of an absent key inserts
    t.replace(MU.upsert_token(t.read(), spark.createDataFrame([(2, "u", "t")], "id long, url string, token string"), now))
    assert sorted(r["id"] for r in t.read().collect()) == [1, 2]


def test_compaction_keeps_rows(spark, tmp_dir):
    t = VersionedTable(spark, f"{tmp_dir}/files3", files_schema())
    for i in range(3):
        t.append(SC.registry_rows(spark.createDataFrame([(f"p{i}.txt",)], "file_path string"), 1))
    v = t.compact(1)
    assert v == 4 and t.read().count() == 3 and len(t.manifest()) == 1


def brute_force(qs, corpus, k, max_d):
    """Plain statement of exact cosine top-k on the driver (small fixtures only)."""
    import numpy as np
    c = [(r["chunk_id"], np.array(r["embedding"], dtype=np.float64)) for r in corpus.collect()]
    out = []
    for q in qs.collect():
        v = np.array(q["embedding"], dtype=np.float64)
        d = [(round(max(1 - float(v @ x) / (np.linalg.norm(v) * np.linalg.norm(x)), 0.0), 9), cid) for cid, x in c]
        d = sorted(t for t in d if t[0] < max_d)[:k]
        out.extend((q["query_id"], i + 1, cid) for i, (_, cid) in enumerate(d))
    return sorted(out)


def test_top_k_equals_brute_force_and_no_hit(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    corpus = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)]) for i in range(300)]
                                   + [(300 + i, [1.0] * 16) for i in range(4)],  # exact copies tie
                                   "chunk_id long, embedding array<float>")
    qs = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)]) for i in range(20)]
                               + [(99, [1.0] * 16), (100, [-1.0] * 16)], "query_id long, embedding array<float>")
    a = top_k(qs, corpus, k=3, max_distance=0.9, payload=[]).collect()
    key = lambda r: (r["query_id"], r["rank"], r["chunk_id"])
    assert sorted(map(key, a)) == brute_force(qs, corpus, 3, 0.9)
    assert [r["chunk_id"] for r in sorted(a, key=key) if r["query_id"] == 99] == [300, 301, 302]
    tight = top_k(qs, corpus, k=3, max_distance=0.01, payload=[]).collect()
    assert {r["query_id"] for r in tight} == {99}  # only the exact copies are that close


def test_top_k_query_blocks(spark):
    """More queries than one broadcast may hold: blocks give the same answer."""
    import numpy as np
    rng = np.random.default_rng(2)
    corpus = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)],
                                   "chunk_id long, embedding array<float>")
    qs = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(50)],
                               "query_id long, embedding array<float>")
    one = top_k(qs, corpus, k=4, max_distance=2.0, payload=[]).collect()
    many = top_k(qs, corpus, k=4, max_distance=2.0, payload=[], dim=8, max_broadcast_bytes=8 * 8 * 7).collect()
    key = lambda r: (r["query_id"], r["rank"], r["chunk_id"])
    assert sorted(map(key, one)) == sorted(map(key, many))


def test_top_k_grid(spark, monkeypatch):
    """Both sides large: no vector goes through the driver, any block size gives the same, wrong lengths are an error."""
    import numpy as np
    import pytest
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(8)
    vec = lambda n: [float(x) for x in rng.normal(size=n)]
    corpus = spark.createDataFrame([(f"c{i:03d}", vec(6)) for i in range(150)] + [(f"t{i}", [1.0] * 6) for i in range(9)] + [("null", None), ("zero", [0.0] * 6)],
                                   "chunk_id string, embedding array<float>").repartition(5)
    qs = spark.createDataFrame([(i, vec(6)) for i in range(40)] + [(90, [1.0] * 6), (91, None), (92, [0.0] * 6)], "query_id long, embedding array<float>")
    key = lambda r: (r["query_id"], r["rank"], r["chunk_id"], r["distance"])
    want = sorted(map(key, top_k(qs, corpus, k=4, max_distance=1.2, payload=[], dim=6).collect()))
    assert [w[2] for w in want if w[0] == 90] == ["t0", "t1", "t2", "t3"]

    def refuse(self):
        raise AssertionError("rows went to the driver")

    for rows in (1, 7, 39):
        with monkeypatch.context() as m:
            m.setattr(DataFrame, "collect", refuse)
            got = top_k(qs, corpus, k=4, max_distance=1.2, payload=[], dim=6, max_broadcast_bytes=8 * 6 * rows)
        assert sorted(map(key, got.collect())) == want
    for budget in (1 << 20, 8 * 6 * 7):
        with pytest.raises(Exception, match="must all have 6 dimensions"):
            top_k(qs, corpus.union(spark.createDataFrame([("bad", vec(5))], corpus.schema)), k=4, payload=[], dim=6, max_broadcast_bytes=budget).collect()


def test_top_k_properties_on_documents(spark):
    """Per question: at most k hits, ranks 1..n, sorted by distance, unique chunks, within [0, bound)."""
    from chunkwise.plans.ingest import chunk_documents
    from chunkwise.plans.rag import retrieve

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    qs = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").withColumnRenamed("item_id", "query_id")
    hits = retrieve(qs, chunk_documents(docs, add_time=0), k=4, max_distance=0.7).collect()
    by_q = {}
    for r in hits:
        by_q.setdefault(r["query_id"], []).append(r)
    assert by_q
    for rows in by_q.values():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 4
        d = [r["distance"] for r in rows]
        assert d == sorted(d) and all(0 <= x < 0.7 for x in d)
        assert len({r["chunk_id"] for r in rows}) == len(rows)


def test_top_k_query_tiles(spark, monkeypatch):
    """Tiny distance tiles (many query tiles per batch) give the same answer."""
    import numpy as np

    from chunkwise.operators import retrieve as R
    rng = np.random.default_rng(5)
    corpus = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)],
                                   "chunk_id long, embedding array<float>")
    qs = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(30)],
                               "query_id long, embedding array<float>")
    monkeypatch.setattr(R, "MAX_BLOCK", 7)
    got = R.top_k(qs, corpus, k=3, max_distance=1.5, payload=[]).collect()
    key = lambda r: (r["query_id"], r["rank"], r["chunk_id"])
    assert sorted(map(key, got)) == brute_force(qs, corpus, 3, 1.5)


def test_sync_lifecycle(spark, tmp_dir):
    """Register paths -> sync pending (10 at a time) -> progress 100 / -1 -> remove a path."""
    import os

    from chunkwise.plans.sync import remove_paths, sync_pending
    from chunkwise.schemas import status_log_schema

    os.makedirs(os.path.join(tmp_dir, "folder"))
    for i in range(3):
        with open(os.path.join(tmp_dir, "folder", f"f{i}.txt"), "w") as f:
            f.write(" ".join(f"Line {j} of file {i}." for j in range(80)))
    single = os.path.join(tmp_dir, "single.md")
    with open(single, "w") as f:
        f.write("# Head\n\nBody text here.")
    bad = os.path.join(tmp_dir, "table.csv")
    with open(bad, "w") as f:
        f.write("a,b")
    folder, missing = os.path.join(tmp_dir, "folder"), os.path.join(tmp_dir, "gone")
    reg = VersionedTable(spark, f"{tmp_dir}/t_files", files_schema())
    ch = VersionedTable(spark, f"{tmp_dir}/t_chunks", chunks_schema(), dim=384)
    log = VersionedTable(spark, f"{tmp_dir}/t_log", status_log_schema())
    reg.append(SC.registry_rows(spark.createDataFrame([(folder,), (single,), (bad,), (missing,)], "file_path string"),
                                100, is_file=F.col("file_path").rlike(r"\.[a-z]+$")))
    st = {r["file_path"]: r["progress"] for r in sync_pending(spark, reg, ch, 200, limit=10, status_log=log).collect()}
    assert st == {folder: 100, single: 100, bad: -1, missing: -1}
    prog = {r["file_path"]: (r["progress"], r["sync_time"]) for r in reg.read().collect()}
    assert prog[folder] == (100, 200) and prog[bad] == (-1, 200)
    assert SC.pending(reg.read(), 10).count() == 0
    assert sync_pending(spark, reg, ch, 300).count() == 0  # nothing left to do
    roots = {r["root_path"] for r in ch.read().collect()}
    assert roots == {folder, single}
    # 5 files extracted, 4 embedded and stored, one failed file, 4 registered paths
    stages = {r[0]: r[1] for r in log.read().groupBy("progress").count().collect()}
    assert stages == {1: 5, 50: 4, 100: 6, -1: 2}
    remove_paths(reg, ch, spark.createDataFrame([(folder,)], "file_path string"))
    assert {r["root_path"] for r in ch.read().collect()} == {single}
    assert folder not in {r["file_path"] for r in reg.read().collect()}


def test_versions_commit_and_vacuum(spark, tmp_dir):
    import pytest

    t = VersionedTable(spark, f"{tmp_dir}/vt", files_schema())
    for i in range(3):
        t.replace(SC.registry_rows(spark.createDataFrame([(f"p{i}.txt",)], "file_path string"), 1))
    assert t.versions() == [0, 1, 2, 3] and t.read().count() == 1
    with pytest.raises(Exception):
        t._commit(3, [])  # a version is committed once
    again = VersionedTable(spark, f"{tmp_dir}/vt", files_schema())  # reopening never resets
    assert again.current_version() == 3
    assert t.vacuum(keep=2) == [0, 1] and t.versions() == [2, 3] and t.read().count() == 1


def test_bucketed_keyed_rewrite_touches_one_bucket(spark, tmp_dir):
    t = VersionedTable(spark, f"{tmp_dir}/bt", chunks_schema(), dim=4, bucket_col="file_path", n_buckets=8)
    rows = [(i, f"r{i % 3}", f"f{i % 20}.txt", i, f"text {i}", [float(i), 1.0, 0.0, 0.0], 1) for i in range(200)]
    t.append(spark.createDataFrame(rows, chunks_schema()))
    before = set(t.manifest())
    used = t.read().select(t.bucket_of("file_path")).distinct().count()
    assert len(before) == used > 1 and t.read().count() == 200
    gone = spark.createDataFrame([("f7.txt",)], "file_path string")
    t.rewrite_keys(gone, lambda old: MU.delete_keys(old, gone, "file_path"))
    after = set(t.manifest())
    # one bucket rewritten (or emptied), every other folder reused as is
    assert len(before - after) == 1 and len(after - before) <= 1 and len(before & after) == len(before) - 1
    got = t.read()
    assert got.count() == 190 and got.where("file_path = 'f7.txt'").count() == 0
    # upsert of one file's chunks, again touching one bucket
    new = spark.createDataFrame([(1000, "r0", "f3.txt", 0, "new", [1.0, 0.0, 0.0, 0.0], 2)], chunks_schema())
    keys = new.select("file_path")
    t.rewrite_keys(keys, lambda old: MU.delete_keys(old, keys, "file_path").unionByName(new))
    got = t.read()
    assert got.count() == 181 and [r["text"] for r in got.where("file_path = 'f3.txt'").collect()] == ["new"]
    t.vacuum(keep=1)
    assert t.read().count() == 181


def test_maintain_compacts_and_vacuums(spark, tmp_dir):
    from chunkwise.sources.tables import maintain

    t = VersionedTable(spark, f"{tmp_dir}/mt", files_schema())
    for i in range(4):
        t.append(SC.registry_rows(spark.createDataFrame([(f"q{i}.txt",)], "file_path string"), 1))
    assert len(t.manifest()) == 4
    out = maintain([t], target_files=1, keep=1)
    assert out == {t.path: 5} and t.versions() == [5] and len(t.manifest()) == 1 and t.read().count() == 4


def always_fails(system, prompt, url, token):
    raise RuntimeError("provider down")


def test_generator_failure_falls_back_and_can_switch_off(spark):
    """A failing call gives that question its Markdown; the reference's
    circuit break (state -> false) is available as a settings update."""
    import sys

    from pyspark import cloudpickle

    from chunkwise.operators.answer import answer_questions, settings_after_failures
    from chunkwise.plans.ingest import chunk_documents

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    qs = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").withColumnRenamed("item_id", "query_id").limit(5)
    settings = spark.createDataFrame([(1, "u", "t", True, 0)], settings_schema())
    a = answer_questions(qs, chunk_documents(docs, add_time=0), settings, always_fails).collect()
    assert a and all(r["generator_failed"] and r["source"] == "markdown" for r in a)
    assert all(r["answer"].startswith("### File: ") for r in a if r["n_hits"] > 0)
    after = settings_after_failures(settings, spark.createDataFrame(a), now=9).collect()
    assert after[0]["state"] is False and after[0]["time"] == 9


def test_top_k_reads_ids_and_vectors_only(spark, tmp_dir):
    """The scored scan has no text in it, and any number of query blocks is one corpus pass."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(f"f#{i:010d}", "f", f"text {i}", [float(x) for x in rng.normal(size=8)]) for i in range(500)]
    spark.createDataFrame(rows, "chunk_id string, file_path string, text string, embedding array<float>").write.parquet(f"{tmp_dir}/c")
    corpus = spark.read.parquet(f"{tmp_dir}/c")
    qs = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)], "query_id long, embedding array<float>")
    one = top_k(qs, corpus, k=3, max_distance=2.0, dim=8)
    many = top_k(qs, corpus, k=3, max_distance=2.0, dim=8, max_broadcast_bytes=8 * 8 * 7)
    for df in (one, many):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
        scored = [line for line in plan.splitlines() if "FileScan" in line and "embedding" in line]
        assert len(scored) == 1 and "text" not in scored[0].split("ReadSchema")[1]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_chunk_whose_counts_cancel_is_stored(spark, tmp_dir):
    """Two tokens of one bucket and opposite signs: the chunk is stored with a zero vector, which no search finds."""
    from itertools import count

    from chunkwise.operators.embed import hash_token
    from chunkwise.plans.files import chunk_texts
    from chunkwise.plans.ingest import chunk_documents, chunk_pages

    seen = {}
    for n in count():
        code = hash_token(f"w{n}", 384)
        if code ^ 1 in seen:
            text = f"w{n} {seen[code ^ 1]}"
            break
        seen[code] = f"w{n}"
    docs = spark.createDataFrame([(1, text, "a"), (2, "plain words", "a")], "doc_id long, text string, source string")
    files = docs.selectExpr("'r' AS root_path", "concat(source, doc_id) AS file_path", "text")
    pages = docs.selectExpr("string(doc_id) AS file_path", "1 AS page_no", "text")
    made = [chunk_documents(docs, add_time=0), chunk_documents(docs, add_time=0, strategy="semantic"), chunk_texts(files, now=0), chunk_pages(pages, add_time=0)]
    for i, rows in enumerate(made):
        t = VersionedTable(spark, f"{tmp_dir}/cancel{i}", chunks_schema(), dim=384)
        t.append(rows)
        got = {r["text"]: r["embedding"] for r in t.read().collect()}
        assert got[text] == [0.0] * 384 and any(got["plain words"])
        q = spark.createDataFrame([(7, [1.0] * 384)], "query_id int, embedding array<float>")
        assert text not in {r["text"] for r in top_k(q, t.read(), k=5, max_distance=3.0).collect()}


def test_grid_copies_are_bounded():
    """A small budget of many queries does not send the corpus once per block of that size; a cell's queries fit CELL_BYTES."""
    from chunkwise.operators import retrieve as R

    for total in (2_000, 130_000, 780_000):
        for rows in (100, 150, 65_536):
            blocks, splits = R._shape(total, rows, 64, 12)
            fits = max(rows, R.CELL_BYTES // 512)
            assert blocks * fits >= total * 1.25 - 1 and blocks * splits >= 36
            assert blocks <= max(R.COPIES, -(-int(total * 1.25) // fits))
    assert R._shape(130_000, 150, 64, 12) == (6, 6)
    assert R._shape(400, 150, 64, 12)[0] == 4  # blocks of the budget while they are few


def test_cell_tiles_and_merges(monkeypatch):
    """Any tile size and batch size gives the brute-force result, ties by id, with and without rows beyond the bound."""
    import numpy as np
    import pyarrow as pa

    from chunkwise.operators import retrieve as R

    rng = np.random.default_rng(3)
    C = np.round(rng.normal(size=(500, 4)), 1)
    C[100:140] = C[:40]
    Q = rng.normal(size=(23, 4))
    ids, block = np.arange(500)[::-1].copy(), R._unit_rows(list(range(23)), Q, 4)
    unit = C / np.sqrt((C * C).sum(axis=1))[:, None]
    D = np.round(np.maximum(1 - unit @ block[1].T, 0), 9)
    schema = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("d", pa.float64()), ("s", pa.string())])
    for max_d in (0.05, 0.6, 3.0):
        want = sorted((q, int(ids[r]), D[r, q]) for q in range(23) for r in sorted((r for r in range(500) if D[r, q] < max_d), key=lambda r: (D[r, q], ids[r]))[:5])
        for rows, tile in ((2048, 1 << 21), (7, 11), (64, 100)):
            monkeypatch.setattr(R, "ROWS", rows)
            monkeypatch.setattr(R, "MAX_BLOCK", tile)
            cell = R._Cell(block, 5, max_d, 0.0, 4)
            for a in range(0, 500, 90):
                vec = pa.array(C[a:a + 90].tolist(), pa.list_(pa.float64()))
                cell.see(pa.array(ids[a:a + 90]), vec, pa.array([f"f{i}" for i in ids[a:a + 90]]))
            got = [tuple(r.values()) for b in cell.rows(schema) for r in b.to_pylist()]
            assert all(s == f"f{c}" for _, c, _, s in got)
            assert [(q, c) for q, c, _, _ in sorted(got)] == [w[:2] for w in want]
            assert np.allclose([r[2] for r in sorted(got)], [w[2] for w in want], atol=2e-9)


def test_payload_from_the_hits_sources(spark):
    """With a source the payload is sought in the hits' files only: the other texts are not looked at again."""
    from pyspark.sql import functions as F

    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        looked.add(1)
        return text

    rows = [(f"f{i % 20}#{i}", f"f{i % 20}", f"text {i}", [1.0, float(i)]) for i in range(200)]
    corpus = spark.createDataFrame(rows, "chunk_id string, file_path string, text string, embedding array<float>")
    corpus = corpus.withColumn("text", read("text"))
    qs = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    options = dict(k=2, max_distance=2.0, dim=2, payload=["file_path", "text"])
    want = sorted(map(tuple, top_k(qs, corpus, **options).collect()))
    before = looked.value
    got = sorted(map(tuple, top_k(qs, corpus, source="file_path", **options).collect()))
    assert got == want and len(got) == 2
    assert before == 200 and looked.value - before == 20


def test_large_lists_of_deleted_keys(spark, tmp_dir, monkeypatch):
    """The keys that are deleted, found by the key columns alone: the same rows, and files without a row left are not read."""
    from pyspark.sql import types as T

    from chunkwise.sources import tables as TB

    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("x", T.LongType())])
    t = TB.VersionedTable(spark, f"{tmp_dir}/t", schema)
    rows = lambda *kx: spark.createDataFrame(list(kx), schema).coalesce(1)
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    t.append(rows(("a", 1), ("a", 2), ("b", 3)))          # all go
    t.append(rows(("c", 4), (None, 5), ("d", 6)))         # c and the missing key go
    t.change(keys("a", "c"), "k", rows(("a", 7), ("e", 8)))
    t.change(keys("b", None, "never"), "k", rows((None, 9)))
    t.change(keys("e"), "k")
    t.append(rows(("b", 10)))
    plain = sorted(t.read().collect(), key=str)
    assert sorted(r.x for r in plain) == [6, 7, 9, 10]
    monkeypatch.setattr(TB, "LIST_BYTES", 0)
    monkeypatch.setattr(TB, "WIDE", 0)
    narrow = t.read()
    assert sorted(narrow.collect(), key=str) == plain
    assert narrow.select(F.col("x")).where("x < 4").isEmpty() and "file_path" in narrow._jdf.queryExecution().optimizedPlan().toString()
    t.change(keys("a", "b", "c", "d", "e", None), "k")
    assert t.read().isEmpty()
    monkeypatch.setattr(TB.VersionedTable, "_narrowed", None)  # by two sets of columns: as before
    t.append(rows(("z", 1), ("z", 2)))
    t.change(spark.createDataFrame([("z", 1)], schema), ["k", "x"])
    assert [r.x for r in t.read().collect()] == [2]
