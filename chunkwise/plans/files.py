"""File-tree ingest: registered paths -> files -> text -> chunks.

One distributed job: every file is a row, failed files stay as rows with
``error`` (nothing dropped silently).  Chunks keep both the registered root
(the delete key) and the real file path; a chunk's id is its file path and position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators.embed import HashingEmbedder
from .ingest import chunk_key, stored_vector
from ..operators.split import explode_positions, with_token_chunks
from ..session import gather, gathered_tasks, shuffles_removed, spread, written
from ..sources.files import extract_text, list_files


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def is_file(spark: SparkSession, path: str) -> bool:
    """False for folders and for what does not exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.getFileStatus(p).isFile())


def files_under(spark: SparkSession, roots: list[str]) -> tuple[DataFrame | None, list[str]]:
    """S1 for several registered roots: (file rows carrying their ``root_path``,
    roots that do not exist).  A missing root is reported, not a job failure."""
    out, missing = None, []
    for r in roots:
        if not path_exists(spark, r):
            missing.append(r)
            continue
        f = list_files(spark, r).withColumn("root_path", F.lit(r))
        out = f if out is None else out.unionByName(f)
    return out, missing


def staged_texts(files: DataFrame, pdf_pages=None) -> DataFrame:
    """S2-S5 once: every file's text or error, written to the shared folder, so that chunks
    and statuses derive from the same extraction and no file is read twice.
    ``files``: binaryFile rows plus ``root_path``; ``pdf_pages`` as for :func:`chunkwise.sources.files.extract_text`."""
    texts = extract_text(gather(spread(files.select("path", "modificationTime", "length", "content", "root_path"))), pdf_pages=pdf_pages, keep=("root_path",))
    if len(files._jdf.inputFiles()):  # not a stream's batch, whose bytes are not known
        # Spark reads files in the order of their sizes, the largest in one task
        texts = texts.repartition(gathered_tasks(files), "file_path")
    with shuffles_removed(files.sparkSession):
        return written(texts, "texts")


def chunk_texts(texts: DataFrame, *, size: int = 256, overlap: int = 0, embedder=None, now=None,
                strategy: str = "sentence", semantic_options=None, counter=None, vectors=None) -> DataFrame:
    """Chunk table rows of extracted texts (``root_path``, ``file_path``, ``text``).  With a store of
    ``vectors`` (:class:`chunkwise.operators.vector_store.VectorStore`) the sentence strategy's chunks are embedded
    only if their text is new to it."""
    embedder = embedder or HashingEmbedder()
    stamp = F.unix_timestamp() if now is None else F.lit(now)
    ok = texts.select("root_path", "file_path", normalize_text(F.col("text")).alias("_t"))
    vec = embedder.embed(F.col("text"))
    if strategy == "semantic":
        from ..operators.semantic import SemanticOptions, with_semantic_chunks
        staged = with_semantic_chunks(ok, "_t", "_chunks", embedder, semantic_options or SemanticOptions(counter=counter), vectors_col="_vecs")
        z = staged.select("root_path", "file_path", F.arrays_zip(F.col("_chunks").alias("t"), F.col("_vecs").alias("v")).alias("_z"))
        chunks = (explode_positions(z, ["root_path", "file_path"], "_z", "pos", "_cz")
                  .select("root_path", "file_path", "pos", F.col("_cz.t").alias("text"), F.col("_cz.v").alias("_vec")))
        vec = F.col("_vec")
    else:
        staged = with_token_chunks(ok, "_t", "_chunks", size, overlap, counter)
        chunks = explode_positions(staged, ["root_path", "file_path"], "_chunks", "pos", "text")
    keys = [chunk_key(F.col("file_path"), F.col("pos")), F.col("root_path"), F.col("file_path"), F.col("pos").cast("int").alias("pos"), F.col("text")]
    if vectors is not None and strategy == "sentence":
        rows = chunks.select(*keys, stamp.cast("long").alias("add_time"))
        return vectors.embed(rows, embedder).select("chunk_id", "root_path", "file_path", "pos", "text", stored_vector(F.col("embedding"), embedder).alias("embedding"), "add_time")
    return chunks.select(*keys, stored_vector(vec, embedder).alias("embedding"), stamp.cast("long").alias("add_time"))


def chunk_files(files: DataFrame, pdf_pages=None, **options) -> tuple[DataFrame, DataFrame]:
    """Returns (chunks, failures).  ``files``: binaryFile rows plus ``root_path``; ``options`` as
    for :func:`chunk_texts`."""
    texts = staged_texts(files, pdf_pages)
    failures = texts.where(F.col("error").isNotNull()).select("root_path", "file_path", "file_type", "error")
    return chunk_texts(texts.where(F.col("error").isNull()), **options), failures
