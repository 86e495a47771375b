"""Explicit table schemas: registry (files), chunks (file contents), settings, status log."""

from __future__ import annotations

from pyspark.sql import types as T

DEFAULT_DIM = 384


def files_schema() -> T.StructType:
    return T.StructType([
        T.StructField("name", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("file_type", T.StringType(), True),
        T.StructField("add_time", T.LongType(), False),
        T.StructField("sync_time", T.LongType(), False),
        T.StructField("progress", T.IntegerType(), False),
    ])


def chunks_schema() -> T.StructType:
    """One row per chunk. ``root_path`` is the registered path (delete key),
    ``file_path`` the real file, ``chunk_id`` file path and position (identity and tie-breaks)."""
    return T.StructType([
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("root_path", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
        T.StructField("add_time", T.LongType(), False),
    ])


def settings_schema() -> T.StructType:
    return T.StructType([
        T.StructField("id", T.LongType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("token", T.StringType(), False),
        T.StructField("state", T.BooleanType(), False),
        T.StructField("time", T.LongType(), False),
    ])


def status_log_schema() -> T.StructType:
    """``seq``: number of the step that wrote the row, greater in later steps."""
    return T.StructType([
        T.StructField("file_path", T.StringType(), False),
        T.StructField("progress", T.IntegerType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("error", T.StringType(), True),
        T.StructField("seq", T.LongType(), True),
    ])
