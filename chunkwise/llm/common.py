"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir



def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, as ``doc_id`` long and ``text``
    (null: empty); every other column, whatever its name, is left out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text column of each piece holds about
    ``max_bytes`` at most (one row may be larger: texts are never cut)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if batch.num_rows == 0:
            continue
        lengths = pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and (size + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        yield batch.slice(start, batch.num_rows - start)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there, so a lost
    executor costs a reread, never a recomputation."""
    at = shared_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def shared_path(spark, name: str) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/chunkwise-{name}-{uuid.uuid4().hex}"


#: Id lists up to this length (16 MB of longs) may be broadcast; longer ones are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def maybe_broadcast(ids: DataFrame, width: int = 1) -> DataFrame:
    """A written table of ids (rows of ``width`` longs), with a broadcast hint if its counted length allows one."""
    return F.broadcast(ids) if ids.count() * width <= BROADCAST_IDS else ids


# 64-bit hashing in numpy: every operation is modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k for k < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up = np.full(size, _BASE)
        up[0] = 1
        down = np.full(size, _INVERSE)
        down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for every span, the same wherever the span lies."""
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and starts and ends of the words between ASCII white space."""
    a = np.frombuffer(data, np.uint8)
    space = np.zeros(len(a) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1])
    return a, edge[::2], edge[1::2]
