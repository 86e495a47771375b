"""Suffix-array dedup: remove bytes that a smaller document has already shown.

A byte goes if a ``length``-byte string covers it that also starts in a
document with a smaller id.  Strings are judged on the input, matches never
cross documents.

The suffixes of all texts are dealt into suffix buckets by content, and each
bucket is sorted on its own by :mod:`suffix_sort` (difference cover, one
bucket at a time).  Only suffixes that can repeat are sent there:

1. Every ``length``-byte window has an anchor, its ``K``-byte string with the
   smallest hash, so equal windows have equal anchors.  Blocks of documents
   send the distinct anchor hashes, by hash, to partitions that answer which
   of them occur in two blocks or more (a bit each).
2. For shared anchors a block sends each distinct context (the bytes of all
   windows that have the anchor) once, with its smallest document.  The
   partition groups equal windows by the blockwise sort and answers, a bit
   each, for which windows another block has a smaller document.
3. The block marks its bytes and returns what is left.

Blocks, not documents, talk to partitions, and a block sends a string once
however often it occurs there, so hot passages and groups of copies are
combined before every shuffle.  Texts move once (the exchange is reused).

Defined results: a null text is empty (nothing removed); texts shorter than
``length`` keep all; null ids count as the largest, rows with equal ids are
not smaller than one another (so repeated rows keep what no smaller id has);
an empty table gives an empty table; other columns, whatever their names, are
carried through unread.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import mix
from .suffix_sort import window_classes

LENGTH = 50
K = 20
#: Bytes of text in a block (one document may be larger); blocks grow in number with the input.
BLOCK_BYTES = 4 << 20
#: Key partitions for each shuffle partition at least, so that hashing evens out, and the bytes of text for
#: one of them at most (by hash): they grow in number with the input, so what one holds in memory does not.
KEYS_PER_PARTITION = 4
PART_BYTES = 64 << 20
_LAST = (1 << 63) - 1
_MULT = np.uint64(0x9FB21C651E98DF25)


def _hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes from every position (len(buf) - k + 1 of them)."""
    n = len(buf) - k + 1
    h, size, power = buf.astype(np.uint64) + np.uint64(1), 1, _MULT
    out, done = None, 0
    # binary powers of the span: h holds hashes of ``size`` bytes from every position
    while True:
        if k & size:
            if out is None:
                out, done = h[:n].copy(), size
            else:
                with np.errstate(over="ignore"):
                    out = out * power + h[done:done + n]
                done += size
        if size * 2 > k:
            return mix(out)
        with np.errstate(over="ignore"):
            h = h[:-size] * power + h[size:]
            power = power * power
        size *= 2


class Block:
    """The texts of one block, their anchors and the windows of each anchor."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int):
        self.length, w = length, length - K + 1
        # rows in an order of their own, so that every pass over a block sees the same
        order = sorted(range(len(texts)), key=lambda i: (int(ids[i]), texts[i]))
        self.order = np.array(order, np.int64)
        self.ids = np.asarray(ids, np.int64)[self.order] if len(texts) else np.zeros(0, np.int64)
        texts = [texts[i] for i in order]
        sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        anchors, lows, highs, keys = [], [], [], []
        # pieces of whole documents bound the arrays of eight bytes a character
        doc = 0
        while doc < len(texts):
            end = max(doc + 1, int(np.searchsorted(self.offsets, self.offsets[doc] + (1 << 20), "right")) - 1)
            lo, hi = int(self.offsets[doc]), int(self.offsets[end])
            if hi - lo >= length:
                h = _hashes(self.buf[lo:hi], K)
                v = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
                span = 1
                while span * 2 <= w:
                    v = np.minimum(v[:-span], v[span:])
                    span *= 2
                if w - span:
                    v = np.minimum(v[:span - w], v[w - span:])
                # windows that lie inside one document
                own = self.offsets[doc:end + 1] - lo
                edge = np.zeros(hi - lo + 1, np.int64)
                fits = sizes[doc:end] >= length
                np.add.at(edge, own[:-1][fits], 1)
                np.add.at(edge, (own[1:] - length + 1)[fits], -1)
                starts = np.flatnonzero(np.cumsum(edge[:len(v)]) > 0)
                if len(starts):
                    a = (v[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    new = np.ones(len(a), bool)
                    # a run: one anchor, and starts without a gap (a gap is a document's end)
                    new[1:] = (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)
                    at = np.flatnonzero(new)
                    anchors.append(a[at] + lo)
                    lows.append(starts[at] + lo)
                    highs.append(starts[np.append(at[1:], len(a)) - 1] + lo)
                    keys.append(h[a[at]])
            doc = end
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.anchor, self.low, self.high = cat(anchors, np.int64), cat(lows, np.int64), cat(highs, np.int64)
        self.key = cat(keys, np.uint64)
        self.doc = np.searchsorted(self.offsets, self.low, "right") - 1

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The block's distinct keys in order, and whether two of its ids have them."""
        keys, inverse = np.unique(self.key, return_inverse=True)
        ids = self.ids[self.doc]
        small = np.full(len(keys), _LAST, np.int64)
        large = np.full(len(keys), -_LAST - 1, np.int64)
        np.minimum.at(small, inverse, ids)
        np.maximum.at(large, inverse, ids)
        return keys, small < large

    def contexts(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the anchors with a key in ``shared`` (sorted): which runs, the id of each
        run's context, and of the distinct contexts key, padded row and smallest id.
        A row is (bytes before the anchor, length, the bytes)."""
        runs = np.flatnonzero(np.isin(self.key, shared)) if len(shared) else np.zeros(0, np.int64)
        width = 2 * self.length - K + 2
        rows = np.zeros((len(runs), width), np.uint8)
        size = self.high[runs] - self.low[runs] + self.length
        rows[:, 0] = self.anchor[runs] - self.low[runs]
        rows[:, 1] = size
        pos = np.minimum(self.low[runs, None] + np.arange(width - 2), max(len(self.buf) - 1, 0))
        if len(runs):
            rows[:, 2:] = np.where(np.arange(width - 2) < size[:, None], self.buf[pos], 0)
        flat = np.ascontiguousarray(rows).view(f"V{width}").ravel()
        order = np.lexsort((flat.view(f"S{width}"), self.key[runs])) if len(runs) else runs
        new = np.ones(len(runs), bool)
        if len(runs):
            same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1) & (self.key[runs][order[1:]] == self.key[runs][order[:-1]])
            new[1:] = ~same
        context = np.empty(len(runs), np.int64)
        context[order] = np.cumsum(new) - 1
        first = order[new]
        smallest = np.full(len(first), _LAST, np.int64)
        np.minimum.at(smallest, context, self.ids[self.doc[runs]])
        return runs, context, self.key[runs][first], rows[first], smallest


def _block(t: pa.Table, length: int) -> Block:
    texts = t.column("_text").to_pylist()
    return Block(t.column("_id").to_numpy(), texts, length)


def _by_part(keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    return [(int(part[own[0]]), own) for own in np.split(order, cuts[1:]) if len(own)] if len(order) else []


def _shared_keys(block: Block, replies: pa.Table, parts: int) -> np.ndarray:
    """Sorted keys of the block that occur in two documents anywhere."""
    keys, here = block.distinct()
    hit = here.copy()
    bits = dict(zip(replies.column("_part").to_pylist(), replies.column("bits").to_pylist()))
    for part, own in _by_part(keys, parts):
        if part in bits:
            hit[own] |= np.unpackbits(np.frombuffer(bits[part], np.uint8), count=len(own)).astype(bool)
    return keys[hit]


def _send_keys(blk: int, block: Block, parts: int) -> pa.Table:
    keys, _ = block.distinct()
    cut = _by_part(keys, parts)
    return pa.table({"_part": pa.array([p for p, _ in cut], pa.int64()), "_blk": pa.array([blk] * len(cut), pa.int64()),
                     "keys": pa.array([keys[o].tobytes() for _, o in cut], pa.binary())})


def _answer_keys(t: pa.Table) -> pa.Table:
    """For one key partition: which keys of each block another block has too."""
    blks = t.column("_blk").to_pylist()
    lists = [np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()]
    keys, counts = np.unique(np.concatenate(lists), return_counts=True)
    many = keys[counts > 1]
    bits = [np.isin(x, many, assume_unique=True) for x in lists]
    rows = [(b, np.packbits(x).tobytes()) for b, x in zip(blks, bits) if x.any()]
    part = t.column("_part")[0].as_py()
    return pa.table({"_blk": pa.array([r[0] for r in rows], pa.int64()), "_part": pa.array([part] * len(rows), pa.int64()),
                     "bits": pa.array([r[1] for r in rows], pa.binary())})


def _send_contexts(blk: int, block: Block, shared: np.ndarray, parts: int) -> pa.Table:
    _, _, keys, rows, smallest = block.contexts(shared)
    cut = _by_part(keys, parts)
    blobs = []
    for _, own in cut:
        r = rows[own]
        inside = np.arange(r.shape[1] - 2) < r[:, 1:2]
        blobs.append(r[:, 2:][inside].tobytes())
    return pa.table({"_part": pa.array([p for p, _ in cut], pa.int64()), "_blk": pa.array([blk] * len(cut), pa.int64()),
                     "befores": pa.array([rows[o, 0].tobytes() for _, o in cut], pa.binary()),
                     "sizes": pa.array([rows[o, 1].tobytes() for _, o in cut], pa.binary()),
                     "ids": pa.array([smallest[o].tobytes() for _, o in cut], pa.binary()),
                     "context": pa.array([pa.compress(b, codec="zstd", asbytes=True) for b in blobs], pa.binary())})


def _answer_contexts(t: pa.Table, length: int) -> pa.Table:
    """For one key partition: a bit for each window of each context that starts in a
    smaller document somewhere than the context's own smallest.

    Equal contexts of several blocks are one; an anchor with one context has nothing to
    sort (all its windows start where the context does).  The windows of the others are
    grouped by the blockwise suffix sort."""
    blks = t.column("_blk").to_pylist()
    n_of = [len(x) for x in t.column("sizes").to_pylist()]
    size = np.frombuffer(b"".join(t.column("sizes").to_pylist()), np.uint8).astype(np.int64)
    before = b"".join(t.column("befores").to_pylist())
    ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), np.int64)
    blob = b"".join(pa.decompress(x.as_py(), int(np.frombuffer(z.as_py(), np.uint8).sum()), codec="zstd", asbytes=True)
                    for x, z in zip(t.column("context"), t.column("sizes")))
    end = np.cumsum(size).tolist()
    known: dict[bytes, int] = {}
    same = np.fromiter((known.setdefault(blob[e - n:e], len(known)) for e, n in zip(end, size.tolist())), np.int64, len(size))
    least = np.full(len(known), _LAST, np.int64)  # of each distinct context
    np.minimum.at(least, same, ids)
    first = np.unique(same, return_index=True)[1]
    texts = list(known)
    anchors: dict[bytes, list[int]] = {}
    for c, k in enumerate(first.tolist()):
        anchors.setdefault(texts[c][before[k]:before[k] + K], []).append(c)
    many = [c for cs in anchors.values() if len(cs) > 1 for c in cs]
    masks = np.zeros(len(size), np.uint64)
    single = np.ones(len(known), bool)
    if many:
        single[many] = False
        sizes = np.array([len(texts[c]) for c in many], np.int64)
        buf = np.frombuffer(b"".join(texts[c] for c in many), np.uint8)
        windows = sizes - length + 1
        of = np.repeat(np.arange(len(many)), windows)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        cls = window_classes(buf, (np.cumsum(sizes) - sizes)[of] + nth, length)
        order = np.argsort(cls, kind="stable")
        head = np.flatnonzero(np.diff(cls[order], prepend=-1))
        low = np.empty(len(cls), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(least[np.array(many)][of[order]], head), np.diff(np.append(head, len(cls))))
        # the smallest id of every window, by distinct context, against each block's own
        begin = np.full(len(known), -1, np.int64)
        begin[many] = np.cumsum(windows) - windows
        rows = np.flatnonzero(~single[same])
        n = size[rows] - length + 1
        at = np.repeat(rows, n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        hit = low[begin[same[at]] + k] < ids[at]
        np.bitwise_or.at(masks, at[hit], np.uint64(1) << k[hit].astype(np.uint64))
    whole = single[same] & (least[same] < ids)
    masks[whole] = ~np.uint64(0) >> (np.uint64(64) - (size[whole] - length + 1).astype(np.uint64))
    cuts = np.cumsum(n_of)[:-1]
    part = t.column("_part")[0].as_py()
    return pa.table({"_blk": pa.array(blks, pa.int64()), "_part": pa.array([part] * len(blks), pa.int64()),
                     "masks": pa.array([m.tobytes() for m in np.split(masks, cuts)], pa.binary())})


def _covered(block: Block, shared: np.ndarray, replies: pa.Table, parts: int) -> np.ndarray:
    """A flag for each byte of the block: whether it goes."""
    runs, context, keys, _, smallest = block.contexts(shared)
    masks = np.zeros(len(keys), np.uint64)
    got = dict(zip(replies.column("_part").to_pylist(), replies.column("masks").to_pylist()))
    for part, own in _by_part(keys, parts):
        masks[own] = np.frombuffer(got[part], np.uint64)
    low, n = block.low[runs], block.high[runs] - block.low[runs] + 1
    later = block.ids[block.doc[runs]] > smallest[context]
    edge = np.zeros(len(block.buf) + 1, np.int64)
    np.add.at(edge, low[later], 1)
    np.add.at(edge, (low + n - 1 + block.length)[later], -1)
    rest = np.flatnonzero(~later & (masks[context] != 0))
    of = np.repeat(rest, n[rest])
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n[rest]) - n[rest], n[rest])
    hit = (masks[context[of]] >> nth.astype(np.uint64)) & np.uint64(1) == 1
    start = (low[of] + nth)[hit]
    np.add.at(edge, start, 1)
    np.add.at(edge, start + block.length, -1)
    return np.cumsum(edge[:-1]) > 0


def _result(t: pa.Table, block: Block, gone: np.ndarray, with_text: bool) -> pa.Table:
    n = len(block.ids)
    kept, spans, removed = [b""] * n, [[] for _ in range(n)], np.zeros(n, np.int64)
    for k in range(n):
        lo, hi = int(block.offsets[k]), int(block.offsets[k + 1])
        own, row = gone[lo:hi], int(block.order[k])
        data = block.buf[lo:hi]
        if own.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
            spans[row] = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
            removed[row] = int(own.sum())
            data = data[~own]
        kept[row] = data.tobytes()
    sizes = pa.compute.binary_length(t.column("_text")).cast(pa.int64())
    return pa.table({"_rest": t.column("_rest"), "n_bytes": sizes, "n_removed": pa.array(removed),
                     "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                     "kept": pa.array([x.decode(errors="ignore") for x in kept] if with_text else [None] * n, pa.string())})


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """Every row's other columns as the struct ``_rest``, n_bytes, n_removed, the removed
    spans (byte offsets), kept_sha256 (of the kept bytes) and, with ``with_text``, the kept
    text (bytes of a character that was cut apart are left out)."""
    spark = docs.sparkSession
    if not K < length <= 83:
        raise ValueError("length must be above 20 and at most 83")  # a context's windows fit 64 bits, its size a byte
    total = docs.select(F.sum(F.octet_length(F.col(text_col).cast("binary")).cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(KEYS_PER_PARTITION * n, -(-total // PART_BYTES))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    # by id and text: rows with one id (or none) spread over the blocks as well
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks)).alias("_blk"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_id"),
                       F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"),
                       rest.alias("_rest")).repartition(n, "_blk")
    grouped = rows.groupBy("_blk")
    blk = lambda t: t.column("_blk")[0].as_py()

    def send_keys(t: pa.Table) -> pa.Table:
        return _send_keys(blk(t), _block(t, length), parts)

    def answer_contexts(t: pa.Table) -> pa.Table:
        return _answer_contexts(t, length)

    def send_contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _send_contexts(0, Block(np.zeros(0, np.int64), [], length), np.zeros(0, np.uint64), parts)
        block = _block(left, length)
        return _send_contexts(blk(left), block, _shared_keys(block, right, parts), parts)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _block(left, length)
        kind = right.column("masks").is_null()
        shared = _shared_keys(block, right.filter(kind), parts)
        return _result(left, block, _covered(block, shared, right.filter(pa.compute.invert(kind)), parts), with_text)

    keys = grouped.applyInArrow(send_keys, "_part long, _blk long, keys binary")
    bits = keys.groupBy("_part").applyInArrow(_answer_keys, "_blk long, _part long, bits binary")
    contexts = grouped.cogroup(bits.groupBy("_blk")).applyInArrow(
        send_contexts, "_part long, _blk long, befores binary, sizes binary, ids binary, context binary")
    masks = contexts.groupBy("_part").applyInArrow(answer_contexts, "_blk long, _part long, masks binary")
    answers = (bits.withColumn("masks", F.lit(None).cast("binary"))
               .union(masks.select("_blk", "_part", F.lit(None).cast("binary").alias("bits"), "masks")))
    out = StructType([StructField("_rest", rows.schema["_rest"].dataType), StructField("n_bytes", LongType()),
                      StructField("n_removed", LongType()),
                      StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
                      StructField("kept_sha256", StringType()), StructField("kept", StringType())])
    return grouped.cogroup(answers.groupBy("_blk")).applyInArrow(finish, out)


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings removed: the same columns, ``n_chars`` (if it
    is there) counted anew.  Documents of which nothing is left go; a null text
    becomes empty and stays."""
    done = dedup(docs, id_col, text_col, length).where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    cols = [F.col("kept").alias(c) if c == text_col else
            F.length("kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_rest.`{c}`").alias(c)
            for c in docs.columns]
    return done.select(*cols)
