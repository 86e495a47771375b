"""The reference's lifecycle as batch steps over versioned tables.

* :func:`sync_pending` — one step of the ingest loop: take up to ``limit``
  registry rows still at progress 0 (P3), read their files (S1-S5), chunk and
  embed them (E4), store the chunks (S11) and record the stages 1, 50 and 100,
  or -1 with the error, for each file and registered path (M3, status log).  Run it
  on a schedule, or use :mod:`chunkwise.streaming.ingest` for a
  continuously running stream.
* :func:`retry_failed` — failed paths become pending again.
* :func:`remove_paths` — M2: the same paths removed from registry and chunks,
  each by a list of keys in a new table version.

Only the pending paths (at most ``limit``, a bounded list) reach the driver,
to name the folders to read; file contents and chunks stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mutate as MU
from ..operators import scan as SC
from ..sources.tables import VersionedTable
from ..session import written
from ..streaming.status import EMBEDDED, EXTRACTING, FAILED, STORED
from .files import chunk_texts, files_under, is_file, staged_texts


def register_paths(registry: VersionedTable, paths: list[str], now: int) -> DataFrame:
    """Paths registered by a user (a bounded list), each once, as pending rows.  The file system is
    asked whether a path is a file: a folder ``v1.2`` has no file type.  Registering a path again makes it pending."""
    spark = registry.spark
    rows = spark.createDataFrame([(p, is_file(spark, p)) for p in dict.fromkeys(paths)], "file_path string, _file boolean")
    new = SC.registry_rows(rows, now, is_file=F.coalesce("_file", F.lit(False)))
    registry.change(rows.select("file_path"), "file_path", new)
    return new


def retry_failed(registry: VersionedTable, now: int) -> None:
    """Registry rows at -1 become pending (0) again, by a keyed change."""
    failed = registry.read().where(F.col("progress") == -1)
    rows = failed.withColumn("progress", F.lit(0)).withColumn("sync_time", F.lit(now).cast("long"))
    registry.change(failed.select("file_path"), "file_path", rows)


def sync_pending(spark: SparkSession, registry: VersionedTable, chunks: VersionedTable, now: int, *,
                 limit: int = 10, embedder=None, size: int = 256, strategy: str = "sentence", counter=None, pdf_pages=None, vectors=None,
                 status_log: VersionedTable | None = None) -> DataFrame:
    """Returns the status rows written for this step (file_path, progress, error): one per
    registered path, and one per file below it that failed or gave no text.

    The chunks of the pending paths are replaced in one commit, so a step that is
    repeated after a crash does not double them."""
    pending = [r["file_path"] for r in SC.pending(registry.read(), limit).select("file_path").collect()]
    kind = "file_path string, progress int, error string"
    if not pending:
        return spark.createDataFrame([], kind)
    # the rows of a step have one time; the registry's version numbers the steps
    seq = F.lit(registry.current_version()).cast("long").alias("seq")
    log = (lambda rows: status_log.append(rows.select("file_path", "progress", F.timestamp_seconds(F.lit(now)).alias("ts"), "error", seq))) \
        if status_log is not None else (lambda rows: None)
    files, missing = files_under(spark, pending)
    results = [spark.createDataFrame([(p, FAILED, "missing path") for p in missing], kind)]
    if files is not None:
        texts = staged_texts(files, pdf_pages)
        none = F.lit(None).cast("string")
        log(texts.select("file_path", F.lit(EXTRACTING).alias("progress"), none.alias("error")))
        roots = spark.createDataFrame([(p,) for p in pending if p not in missing], "root_path string")
        # the chunks are written once, to the folders that the commit below takes
        new = chunks.stage(chunk_texts(texts.where(F.col("error").isNull()), size=size, embedder=embedder, now=now, strategy=strategy, counter=counter, vectors=vectors))
        stored = written(new.read().select("root_path", "file_path").distinct(), "sync-stored")
        log(stored.select("file_path", F.lit(EMBEDDED).alias("progress"), none.alias("error")))
        chunks.change(roots, "root_path", new)
        bad = (texts.join(stored.select("file_path", F.lit(True).alias("_ok")), "file_path", "left").where("_ok IS NULL")
               .select("root_path", "file_path", F.lit(FAILED).alias("progress"), F.coalesce("error", F.lit("no text")).alias("error")))
        log(stored.select("file_path", F.lit(STORED).alias("progress"), none.alias("error")))
        per = (texts.groupBy("root_path").agg(F.count("*").alias("n"))
               .join(bad.groupBy("root_path").agg(F.count("*").alias("n_bad"), F.min("error").alias("first")), "root_path", "left"))
        n_bad = F.coalesce("n_bad", F.lit(0))
        per_root = roots.join(per, "root_path", "left").select(
            F.col("root_path").alias("file_path"),
            F.when(F.coalesce("n", F.lit(0)) > n_bad, F.lit(STORED)).otherwise(F.lit(FAILED)).cast("int").alias("progress"),
            F.when(n_bad > 0, F.when(F.col("n") == 1, F.col("first")).otherwise(
                F.concat(n_bad.cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" files failed: "), F.col("first"))))
            .when(F.col("n").isNull(), F.lit("no text")).alias("error"))
        # a file that is registered itself (listed with its scheme) has its row already
        results += [per_root, bad.where(~F.endswith("file_path", "root_path")).select("file_path", "progress", "error")]
    status = results[0]
    for r in results[1:]:
        status = status.unionByName(r)
    # written once, so every use below sees the same rows
    status = written(status, "sync-status")
    log(status)
    mine = status.join(spark.createDataFrame([(p,) for p in pending], "file_path string"), "file_path", "left_semi")
    rows = registry.read().join(mine.select("file_path"), "file_path", "left_semi")
    registry.change(mine.select("file_path"), "file_path", MU.update_progress(rows, mine.select("file_path", "progress"), now))
    return status


def remove_paths(registry: VersionedTable, chunks: VersionedTable, paths: DataFrame) -> None:
    """M2: registry rows and chunks of the given registered paths, removed.  Each table gets
    the list of paths; no data folder is rewritten."""
    p = paths.select(F.col("file_path")).distinct()
    registry.change(p, "file_path")
    chunks.change(p.withColumnRenamed("file_path", "root_path"), "root_path")
