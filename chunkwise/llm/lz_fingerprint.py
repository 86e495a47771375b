"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into LZ78 dictionary phrases; the hashes of its phrase set
give a signature of ``SIZE`` minimum hashes, written as hex.  The likeness of
two signatures is the share of equal places, an estimate of the overlap of
the phrase sets, which is high where one text helps to compress the other.

:func:`neighbours` also compares each document with an edited text and with
the next document by descending id.  Ids are cut into ranges at quantiles; a
range is sorted in one partition and streamed, so texts move once, and the
first row of the range below comes along as a guest.

Defined results: a null or empty text has no phrases and the signature of all
ones (two empty texts are alike with 1); equal texts have equal fingerprints;
null ids are the smallest; rows with equal ids follow one another by text; a
lone row is its own next; an empty table gives an empty table; extra columns
are left out.  Whole texts are parsed, one at a time, in linear time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, mix, slices, span_hashes

SIZE = 64
#: Documents of one id range, about.
RANGE_ROWS = 4000
#: Ranges per shuffle partition at most.
RANGES = 4
_LOW = -(1 << 63)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Parse:
    """An LZ78 parse that can be continued, and taken back to an earlier point."""

    def __init__(self) -> None:
        self.known: set[str] = set()
        self.open = ""

    def feed(self, text: str) -> list[str]:
        """Parse on; the phrases that end in ``text``."""
        known, w, out = self.known, self.open, []
        add, done = known.add, out.append
        for c in text:
            w += c
            if w not in known:
                add(w)
                done(w)
                w = ""
        self.open = w
        return out

    def back(self, phrases: list[str], open_: str) -> None:
        self.known.difference_update(phrases)
        self.open = open_


def minima(phrases: list[str], size: int = SIZE) -> np.ndarray:
    """Minimum hashes of a list of phrases."""
    if not phrases:
        return np.full(size, _FULL)
    codes = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
    starts = np.concatenate([[0], ends[:-1]])
    out = np.full(size, _FULL)
    h = np.empty(len(phrases), np.uint64)
    # spans of about a million characters keep the arrays of eight bytes a character small
    lo = 0
    while lo < len(phrases):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (1 << 20), "right")))
        own = codes[starts[lo]:ends[hi - 1]]
        h[lo:hi] = span_hashes(own, starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo])
        lo = hi
    for k in range(0, len(h), 1 << 13):
        own = h[k:k + (1 << 13)]
        for j in range(0, size, 16):
            out[j:j + 16] = np.minimum(out[j:j + 16], (own[None, :] * _ODD[j:j + 16, None]).min(axis=1))
    return out


def _sealed(m: np.ndarray) -> np.ndarray:
    return (m >> np.uint64(32)).astype(">u4")


def signature(text: str, size: int = SIZE) -> np.ndarray:
    """Signature of a whole text."""
    p = Parse()
    phrases = p.feed(text)
    return _sealed(minima(phrases + [p.open] if p.open else phrases, size))


def with_edit(text: str, tail: str, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of ``text`` and of the text with its last third replaced by ``tail``;
    the common part is parsed once."""
    cut = len(text) - len(text) // 3
    p = Parse()
    common = minima(p.feed(text[:cut]), size)
    at = p.open
    out = []
    for rest in (text[cut:], tail):
        phrases = p.feed(rest)
        out.append(_sealed(np.minimum(common, minima(phrases + [p.open] if p.open else phrases, size))))
        p.back(phrases, at)
    return out[0], out[1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint (hex) for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8 << 20):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([signature(t).tobytes().hex() for t in texts])],
                names=["doc_id", "n_chars", "fingerprint"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _ranges(rows: DataFrame) -> DataFrame:
    """``rows`` with ``blk`` (higher ids, higher ranges) and ``guest``, plus as a guest of each
    range the first row of the range below (of the lowest: the first row of all)."""
    from pyspark.ml.feature import Bucketizer

    # a range is read as a stream, so its size does not matter; their number, and with it what the driver sees, is
    # bound by the shuffle partitions, not by the table
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = max(1, min(rows.count() // RANGE_ROWS, RANGES * partitions))
    cuts = rows.approxQuantile("doc_id", [i / k for i in range(1, k)], 0.25 / k) if k > 1 else []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) > 2:
        put = Bucketizer(splits=splits, inputCol="at", outputCol="blk")
        own = put.transform(rows.withColumn("at", F.col("doc_id").cast("double"))).drop("at").withColumn("blk", F.col("blk").cast("int"))
    else:
        own = rows.withColumn("blk", F.lit(0))
    # one number for each range
    tops = sorted((r[0], r[1]) for r in own.groupBy("blk").agg(F.max("doc_id")).collect())
    guests = [(tops[i - 1][1], blk) for i, (blk, _) in enumerate(tops)]
    to = rows.sparkSession.createDataFrame(guests, "doc_id long, blk int")
    return (own.select("blk", F.lit(0).alias("guest"), "doc_id", "text")
            .union(rows.join(F.broadcast(to), "doc_id").select("blk", F.lit(1).alias("guest"), "doc_id", "text")))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(_LOW)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (_ranges(rows).repartition(n, "blk")
             .sortWithinPartitions("blk", "guest", F.col("doc_id").desc(), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, str] | None = None  # the row that waits for its next
        waiting: list[tuple] = []
        last: np.ndarray | None = None

        def meet(text: str) -> None:
            # the held row's next has come: parse the held row with its edit
            nonlocal held, last
            blk, doc, own = held
            tail = text[:len(own) // 3]
            sig, edited = with_edit(own, tail)
            sha = hashlib.sha256((own[:len(own) - len(own) // 3] + tail).encode("utf-8", "surrogatepass")).hexdigest()
            if waiting:
                row = waiting.pop()
                ready.append((*row, likeness(last, sig)))
            waiting.append((None if doc == _LOW else doc, len(own), sha, sig.tobytes().hex(), edited.tobytes().hex(), likeness(sig, edited)))
            held, last = None, sig

        ready: list[tuple] = []
        for b in slices(batches, "text", 8 << 20):
            for blk, guest, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                if held is not None and held[0] == blk:
                    meet(text)
                    if guest:
                        ready.append((*waiting.pop(), likeness(last, signature(text))))
                if not guest:
                    held = blk, doc, text
            if ready:
                yield _rows(ready)
                ready.clear()

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                 "near_edited double, near_next double")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
