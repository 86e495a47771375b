"""Benchmark: the engine's headline jobs on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Jobs (SURVEY 7.6):
  ingest_sentence   clean + 256-token chunks + hashing embedder for every document,
                    written as a versioned chunk table
  retrieve_markdown every benchmark question -> exact top-5 over the stored table -> Markdown
  semantic_chunk    semantic chunking + embedding of every document
  upsert_delete     re-ingest the files of one language and delete those of toxic
                    documents, by one keyed change of the table

Every job first runs once on a 200-document sample (Python worker start-up,
JIT compilation of the expression paths); that warm-up is reported as
"warmup_sec" and kept out of the timed, full-data run.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def _mem_gb() -> int:
    try:
        with open("/proc/meminfo") as f:
            kb = int(next(line for line in f if line.startswith("MemTotal")).split()[1])
        return max(2, int(kb / 1024 / 1024 * 0.6))
    except Exception:  # noqa: BLE001
        return 4


def run_jobs(spark, docs, questions, labels, emb, tag: str) -> tuple[dict[str, float], dict[str, int]]:
    from pyspark.sql import functions as F

    from chunkwise.operators import mutate as MU
    from chunkwise.plans.ingest import chunk_documents
    from chunkwise.plans.rag import answer_markdown
    from chunkwise.schemas import chunks_schema
    from chunkwise.session import scratch_path
    from chunkwise.sources.tables import VersionedTable

    times: dict[str, float] = {}
    info: dict[str, int] = {}
    table = VersionedTable(spark, scratch_path(spark, f"bench-{tag}"), chunks_schema(), dim=emb.dim)
    now = int(time.time())

    t = time.time()
    table.append(chunk_documents(docs, add_time=now, embedder=emb))
    times["ingest_sentence"] = time.time() - t
    chunks = table.read()
    info["chunks"] = chunks.count()
    info["questions"] = questions.count()

    t = time.time()
    md = answer_markdown(questions, chunks, k=5, max_distance=0.6, embedder=emb).collect()
    times["retrieve_markdown"] = time.time() - t
    info["answers_with_hits"] = sum(1 for r in md if r["n_hits"] > 0)

    t = time.time()
    sem = chunk_documents(docs, add_time=now, embedder=emb, strategy="semantic")
    info["semantic_chunks"] = sem.agg(F.count(F.lit(1)), F.sum(F.size("embedding"))).collect()[0][0]
    times["semantic_chunk"] = time.time() - t

    t = time.time()
    # one keyed change: the files of one language are re-ingested, those of toxic documents go;
    # nothing is rewritten
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path")
    french = docs.where("lang = 'fr'")
    gone = docs.join(labels.where("toxic = 1"), "doc_id").select(path)
    fresh = chunk_documents(french, add_time=now + 1, embedder=emb)
    table.change(french.select(path).union(gone), "file_path", MU.delete_keys(fresh, gone, "file_path"))
    times["upsert_delete"] = time.time() - t
    info["chunks_after_change"] = table.read().count()
    return times, info


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))

    from chunkwise.operators.embed import HashingEmbedder
    from chunkwise.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="chunkwise-bench",
                          driver_memory=f"{_mem_gb()}g")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    questions = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumnRenamed("item_id", "query_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    emb = HashingEmbedder()

    t = time.time()
    run_jobs(spark, docs.orderBy("doc_id").limit(200), questions.orderBy("query_id").limit(20), labels, emb, "warm")
    warm = time.time() - t

    times, info = run_jobs(spark, docs, questions, labels, emb, "run")
    info["documents"] = docs.count()
    rates = {"ingest_docs_per_sec": round(info["documents"] / times["ingest_sentence"], 1),
             "semantic_docs_per_sec": round(info["documents"] / times["semantic_chunk"], 1),
             "query_chunk_pairs_per_sec": round(info["questions"] * info["chunks"] / times["retrieve_markdown"], 1)}
    total = sum(times.values())
    print(json.dumps({"metric": "total_sec", "value": round(total, 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in times.items()},
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "cpus": cpus, "driver_memory_gb": _mem_gb(), "warmup_sec": round(warm, 3),
                      "rows": info, "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
