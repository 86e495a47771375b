"""File-tree sources.

``binaryFile`` lists a tree recursively (a single file passes through) and
reads each file as one row; text extraction dispatches on the lower-cased
extension.  Unsupported or failing files are kept as rows with ``error``
set instead of failing the job (quarantine), and a missing extension is an
``unsupported`` row rather than a crash.

* txt: UTF-8 decode.
* md: Markdown reduced to text by a fixed chain of ``regexp_replace`` (our
  rules, documented in the README: front matter, heading marks, emphasis,
  links/images, code fences and inline code marks).
* docx: :mod:`chunkwise.sources.docx` (stdlib zip + XML in an Arrow helper).
* pdf: byte decoding is not built; ``pdf_pages`` takes page texts or a function that reads them.
"""

from __future__ import annotations

import os
import uuid
from typing import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_extension
from ..session import TASKS_PER_SLOT

SUPPORTED = ("pdf", "md", "txt", "docx")

#: Tasks per task slot that list a tree's folders; Spark's own number is 10,000, of a few folders each.
LISTING_TASKS = 8


def list_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """S1 + S7: one row per file: path, modificationTime, length, content."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    usual = spark.conf.get(key)
    spark.conf.set(key, str(min(int(usual), LISTING_TASKS * spark.sparkContext.defaultParallelism)))
    try:
        return r.load(path)  # lists the tree
    finally:
        spark.conf.set(key, usual)


class FileEach:
    """Writes a folder and file per value of ``key`` (a number) with the rows' other column, in the layout of ``partitionBy``: ``<root>/<key>=<value>/part-...``.

    The tasks write a local (or mounted) root themselves: without its native library, Hadoop's local file system starts a
    process for the permissions of every file and of its checksum file.  Other stores get Spark's writer, by the committer's
    version 2, so that each task moves its own files (by version 1 the driver moves all, one by one, at the end)."""

    def __init__(self, rows: DataFrame, key: str):
        self.key, self.value = key, next(c for c in rows.columns if c != key)
        self.rows = rows.repartition(TASKS_PER_SLOT * rows.sparkSession.sparkContext.defaultParallelism, key)

    def text(self, root: str) -> None:
        self._write(root, F.coalesce(self.value, F.lit("")), "txt")

    def csv(self, root: str) -> None:
        # Spark's writer leaves the file empty where there is no value
        self._write(root, F.when(F.col(self.value).isNotNull(), F.to_csv(F.struct(F.coalesce(self.value, F.lit("")).alias("_")))), "csv")

    def _write(self, root: str, line: Column, kind: str) -> None:
        spark = self.rows.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.getUri().getScheme() != "file":
            w = self.rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(self.key)
            return w.text(root) if kind == "txt" else w.csv(root)
        if fs.exists(at):
            raise FileExistsError(root)
        fs.mkdirs(at)  # also if there are no rows
        value = F.coalesce(F.col(self.key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
        lines = self.rows.select(F.concat(F.lit(f"{self.key}="), value).alias("folder"),
                                 F.concat(line, F.lit("\n")).alias("line"))
        writer = _folder_writer(fs.makeQualified(at).toUri().getPath(), f"{uuid.uuid4().hex}.{kind}")
        lines.sortWithinPartitions("folder").mapInArrow(writer, "files long").write.format("noop").mode("overwrite").save()


def _folder_writer(root: str, name: str):
    """Arrow function over rows (folder, line) that come in order: a file ``name`` in each folder.  A file has another name until
    it is whole, and the same one in every attempt of a task, so that a task that is repeated doubles nothing."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        last = f"part-{task.partitionId():05d}-{name}"
        folder, out, done = None, None, 0

        def close() -> int:
            if out is None:
                return 0
            out.close()
            os.replace(out.name, os.path.join(root, folder, last))
            return 1

        for batch in batches:
            for one, line in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if one != folder:
                    done += close()
                    folder = one
                    os.makedirs(os.path.join(root, folder), exist_ok=True)
                    out = open(os.path.join(root, folder, f".{task.taskAttemptId()}-{last}"), "wb")
                if line.is_valid:
                    out.write(line.as_buffer())
        done += close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([done], pa.int64())})

    return write


def markdown_to_text(col) -> Column:
    """Markdown -> plain text (see module docstring for the rules)."""
    c = F.col(col) if isinstance(col, str) else col
    t = F.regexp_replace(c, r"\A---\n(?s:.*?)\n---\n", "")           # front matter
    t = F.regexp_replace(t, r"(?m)^```.*$\n?", "")                    # code fences
    t = F.regexp_replace(t, r"(?m)^ {0,3}#{1,6}[ \t]+", "")            # heading marks
    t = F.regexp_replace(t, r"!\[([^\]]*)\]\([^)]*\)", "$1")          # images
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")           # links
    t = F.regexp_replace(t, r"(\*\*|__)(.+?)\1", "$2")                # strong
    t = F.regexp_replace(t, r"(?<![\w*])([*_])(?!\s)(.+?)(?<!\s)\1(?![\w*])", "$2")  # emphasis
    t = F.regexp_replace(t, r"`([^`]*)`", "$1")                       # inline code
    return t


def extract_text(files: DataFrame, docx_separator: str = "", pdf_pages: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """File rows -> (file_path, file_type, text, error, modified_at, size, *keep).

    ``pdf_pages`` supplies PDF page texts: a table (file_path, page_no, text), or a function that makes one of
    the PDF rows of ``files`` (path, content, ...), e.g. a ``mapInArrow`` of the user's PDF reader; PDFs
    without pages get an error row.  Only PDF rows are joined.  ``keep`` columns of ``files`` pass through.
    """
    from .docx import docx_text

    ext = F.lower(file_extension(F.col("path")))
    x = files.select(F.col("path").alias("file_path"), ext.alias("file_type"),
                     F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), "content", *keep)
    # only DOCX bytes cross into Python (other rows pass a NULL); staged once
    x = x.withColumn("_docx", docx_text(F.when(F.col("file_type") == "docx", F.col("content")), docx_separator))
    utf8 = F.decode(F.col("content"), "UTF-8")
    docx = F.col("_docx")
    text = (F.when(F.col("file_type") == "txt", utf8)
            .when(F.col("file_type") == "md", markdown_to_text(utf8))
            .when(F.col("file_type") == "docx", docx["text"]))
    err = (F.when(F.col("file_type").isNull(), F.lit("unsupported: no extension"))
           .when(~F.col("file_type").isin(*SUPPORTED), F.concat(F.lit("unsupported: "), F.col("file_type")))
           .when(F.col("file_type") == "docx", docx["error"])
           .when(F.col("file_type") == "pdf", F.lit("pdf: no page text supplied")))
    out = x.select("file_path", "file_type", text.alias("text"), err.alias("error"), "modified_at", "size", *keep)
    if pdf_pages is not None:
        from .pages import assemble_pages
        pages = pdf_pages(files.where(ext == "pdf")) if callable(pdf_pages) else pdf_pages
        pdf = assemble_pages(pages, doc_col="file_path", page_col="page_no", text_col="text") \
            .select("file_path", F.col("text").alias("_pdf"))
        is_pdf = F.coalesce(F.col("file_type") == "pdf", F.lit(False))
        found = out.where(is_pdf).join(pdf, "file_path", "left").select(
            "file_path", "file_type", F.col("_pdf").alias("text"), F.when(F.col("_pdf").isNull(), F.col("error")).alias("error"),
            "modified_at", "size", *keep)
        out = out.where(~is_pdf).unionByName(found)
    return out
