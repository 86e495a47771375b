"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "chunkwise",
                  driver_memory: str = "16g", extra: dict | None = None) -> SparkSession:
    """Session for tests and the benchmark. On a cluster, build your own session."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only in local mode, where all tasks
    share one machine, an unset folder is created and registered; on a cluster
    a missing setting is an error, since executors do not see one another's disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="chunkwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (survives executor loss)."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/chunkwise/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when it ends; Spark keeps them until the driver's next garbage collection, which
    a large driver may not reach in hours.  A later use of the same plan would run its stages again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if usual is None else spark.conf.set(key, usual)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a scratch folder and read from it, so every use sees the same ones."""
    at = scratch_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


TASKS_PER_SLOT = 2


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a DataFrame into ``TASKS_PER_SLOT`` tasks per task slot when
    it arrives in fewer partitions (e.g. one small file with a single row
    group).  Per-document work is CPU-heavy, so this shuffle of raw rows pays
    for itself, and more than one task per core measured clearly faster than
    one large task per core (local[4], sf0.1 bench: 73 s -> 26 s).
    Large inputs already arrive in many splits and are left untouched."""
    target = min_partitions or TASKS_PER_SLOT * df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df
    # files tell their splits; other inputs are small enough to count their partitions, but a shuffle has a task
    # for each slot at least, and counting its partitions would run it
    files = len(df._jdf.inputFiles())  # their names stay in the JVM
    if not files and df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    if files >= target or (not files and df.rdd.getNumPartitions() >= target):
        return df
    return df.repartition(target) if not files or _splits(df) < target else df


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of the plan's bytes, for files their sizes (no job runs for the answer)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _splits(df: DataFrame) -> int:
    """Partitions of a plan that only reads files (no shuffle runs for the answer);
    a plan with a shuffle has its shuffle's partitions."""
    return max(1, plan_bytes(df) // int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))


#: Bytes of files that one task reads at least, where there are more tasks than :func:`spread` wants.
GATHERED_BYTES = 16 << 20


def gathered_tasks(df: DataFrame) -> int:
    """Tasks for the rows of a plan: as many for each slot, two or one for :data:`GATHERED_BYTES`.  (Spark packs the files that
    they write into a task for each slot; with some more than that there would be a second round.)"""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return slots * max(TASKS_PER_SLOT, -(-plan_bytes(df) // (GATHERED_BYTES * slots)))


def gather(df: DataFrame) -> DataFrame:
    """Many small files, of which Spark reads about 32 in a task, in fewer tasks (no shuffle)."""
    if df.isStreaming:
        return df
    return df.coalesce(gathered_tasks(df))
