"""Scans, projections, predicates and limits over the registry / chunk /
settings tables (P1-P9).  Filters and projections are plain DataFrame
expressions, so Catalyst pushes them into the parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_extension, file_name


def first_n(df: DataFrame, n: int, order_by=("file_path",)) -> DataFrame:
    """First n rows; an order is added so the answer is deterministic
    (plans as TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)


def pending(files: DataFrame, n: int) -> DataFrame:
    """Registry rows still waiting (progress = 0), oldest first."""
    return files.where(F.col("progress") == 0).orderBy("add_time", "file_path").limit(n)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup, at most one row."""
    return df.where(F.col(key) == F.lit(value)).orderBy(key).limit(1)


def available(settings: DataFrame, n: int) -> DataFrame:
    """P5: rows with ``state = true``."""
    return settings.where(F.col("state")).orderBy("id").limit(n)


def without_vector(chunks: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Every column except the vector (most of the bytes; pruned at the scan)."""
    return chunks.select(*[c for c in chunks.columns if c != vec_col])


def registry_rows(paths: DataFrame, now, path_col: str = "file_path", is_file: Column | None = None) -> DataFrame:
    """Registry rows for registered paths.

    name = last path component, file_type = extension for regular files (NULL
    for directories or when there is none), add_time = now, sync_time = 0,
    progress = 0.  ``is_file`` defaults to "the path has an extension"; for paths of a
    file system use :func:`chunkwise.plans.sync.register_paths`, which looks.
    """
    p = F.col(path_col)
    ext = file_extension(p)
    is_f = is_file if is_file is not None else ext.isNotNull()
    now_c = now if isinstance(now, Column) else F.lit(now)
    return paths.select(
        F.coalesce(file_name(p), p).alias("name"),
        p.alias("file_path"),
        F.when(is_f, ext).alias("file_type"),
        now_c.cast("long").alias("add_time"),
        F.lit(0).cast("long").alias("sync_time"),
        F.lit(0).cast("int").alias("progress"))


def chunk_rows(embedded: DataFrame, path, now, text_col: str = "text", vec_col: str = "embedding") -> DataFrame:
    """P8 + P9: drop rows without text, take the first vector of a multi-vector
    result (when the column is array<array<float>>), stamp the path and one time."""
    v = F.col(vec_col)
    dt = embedded.schema[vec_col].dataType
    if hasattr(dt, "elementType") and hasattr(dt.elementType, "elementType"):
        v = F.get(v, 0)
    path_c = path if isinstance(path, Column) else F.lit(path)
    now_c = now if isinstance(now, Column) else F.lit(now)
    return embedded.where(F.col(text_col).isNotNull()).select(
        path_c.alias("file_path"), F.col(text_col).alias("text"), v.alias("embedding"),
        now_c.cast("long").alias("add_time"))
