"""Best-fit packing of token pieces into sequences (best-two-fit).

Texts become ids, the end id is appended, and only documents longer than the
capacity are cut, into capacity-long pieces with the shorter one first.  A
bin is filled greedily with the longest pieces that fit; then its smallest
piece is replaced by the two unpacked pieces that fit the expanded gap most
tightly, if they fit more tightly.

Pieces of one length are interchangeable, so the plan is made on the counts
per length: at most ``capacity`` numbers, however many documents there are.
Each bin layout is applied as often as the counts allow and takes a length
class (nearly) to its end, so the plan has few layouts.  Pieces find their
places without the driver: a piece's rank among those of its length (counts
per salt bucket, then a window inside the bucket) picks layout, bin and place.

Defined results: a null or empty text is one piece that holds the end id
only; repeated rows, and rows with equal or null ids, are pieces of their own
(the piece key is id, piece and a row number inside its bucket); an empty
table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import id_and_text, slices
from .encoders import ByteBpe, once

CAPACITY = 1024
END_ID = 2
#: Pieces of one salt bucket; buckets grow in number with the input, not in size.
BUCKET_ROWS = 200_000
MIN_BUCKETS = 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, bytes) of a document's ids; the first piece may be shorter."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    ends = [first, *range(first + capacity, n + 1, capacity)]
    for k, end in enumerate(ends):
        start = ends[k - 1] if k else 0
        yield k, start, ids[4 * start:4 * end]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: :data:`PIECES` and, with ``with_ids``, ``ids array<int>``."""
    end = end_id.to_bytes(4, "little")
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = once(ByteBpe, path)
        for b in slices(batches, "text", 4 << 20):
            rows = [(d, k, s, x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                    for k, s, x in cut(enc.ids(t) + end, capacity)]
            ids = [x for *_, x in rows]
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]), pa.int32()),
                    pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


class Layouts:
    """Bin layouts over counts per length, and where the r-th piece of a length goes."""

    def __init__(self, counts: dict[int, int], capacity: int):
        left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            left[length] = n
        self.capacity, self.bins = capacity, 0
        slots: dict[int, list[tuple[int, int, int, tuple[int, ...]]]] = {}
        rank = np.zeros(capacity + 1, np.int64)
        while left.any():
            layout = self._fill(left.copy())
            own: dict[int, list[int]] = {}
            at = 0
            for n in layout:
                own.setdefault(n, []).append(at)
                at += n
            times = min(int(left[n]) // len(offs) for n, offs in own.items())
            for n, offs in own.items():
                slots.setdefault(n, []).append((int(rank[n]), self.bins, len(offs), tuple(offs)))
                rank[n] += times * len(offs)
                left[n] -= times * len(offs)
            self.bins += times
        self.slots = {n: ([s[0] for s in v], [s[1] for s in v], [s[2] for s in v], [s[3] for s in v]) for n, v in slots.items()}

    def _fill(self, left: np.ndarray) -> list[int]:
        """One bin: greedy by length, then its smallest piece against the best two."""
        layout, gap = [], self.capacity
        while gap and (fit := np.flatnonzero(left[:gap + 1])).size:
            n = int(fit[-1])
            layout.append(n)
            left[n] -= 1
            gap -= n
        if gap and len(layout) > 1:
            small, room = layout[-1], gap + layout[-1]
            sizes = np.flatnonzero(left[:room + 1])
            if sizes.size:
                # for each first piece the longest second one that still fits
                at = np.searchsorted(sizes, room - sizes, "right") - 1
                ok = at >= 0
                a, b = sizes[ok], sizes[at[ok]]
                alone = (a == b) & (left[a] < 2)
                lower = np.where(at[ok] > 0, sizes[np.maximum(at[ok] - 1, 0)], 0)
                b = np.where(alone, lower, b)
                total = np.where(b > 0, a + b, 0)
                if total.size and total.max() > small:
                    k = int(total.argmax())
                    layout[-1:] = sorted((int(a[k]), int(b[k])), reverse=True)
        return layout

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of one length with these ranks."""
        first, base, times, offs = self.slots[length]
        k = np.searchsorted(first, ranks, "right") - 1
        each = np.asarray(times)[k]
        local = ranks - np.asarray(first)[k]
        pos = local % each
        width = max(times)
        grid = np.array([list(o) + [0] * (width - len(o)) for o in offs], np.int64)
        return np.asarray(base)[k] + local // each, grid[k, pos]


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", key: tuple[str, ...] = ("piece",)) -> DataFrame:
    """``pieces`` (a table with a ``length`` from 1 to capacity) with
    ``sequence_id`` and ``offset`` long.  It is read more than once: give a
    written or otherwise stable table."""
    keys = [id_col, *key]
    n = pieces.count()
    buckets = max(MIN_BUCKETS, -(-n // BUCKET_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    per = salted.groupBy("length", "_salt").count()
    # counts per length: at most ``capacity`` rows, whatever the input
    counts = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("count")).collect()}
    layouts = Layouts(counts, capacity)
    before = (per.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count"))
              .select("length", "_salt", "_before"))
    ranked = (salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)))
              .join(F.broadcast(before) if len(counts) * buckets <= 200_000 else before, ["length", "_salt"])
              .withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).drop("_salt", "_before"))
    names = [c for c in pieces.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(b.schema.get_field_index("length")).to_numpy()
            ranks = b.column(b.schema.get_field_index("_rank")).to_numpy()
            seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if own.size:
                    seq[own], off[own] = layouts.place(int(lengths[own[0]]), ranks[own])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(seq), pa.array(off)],
                                             names=[*names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType(list(pieces.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: :data:`PIECES` with places.  The pieces are written
    once to the shared folder, so tokenising runs once and survives lost executors."""
    spark = docs.sparkSession
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/chunkwise-pieces-{uuid.uuid4().hex}"
    token_pieces(docs, path, capacity, end_id, with_ids=with_ids).write.parquet(at)
    return pack(spark.read.parquet(at), capacity)
