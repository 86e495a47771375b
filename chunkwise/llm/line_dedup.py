"""Incremental, reversible line dedup: sharded cuckoo filters over exact reference counts.

A ``LineIndex`` is a folder of tables.  Its reference counts tell for every line
key (a 128-bit digest) how many documents hold it; every change appends a part of
signed counts, so inserting or deleting documents costs their own lines and a
scan of the counts, not a rewrite.  A key that reaches ``threshold`` documents is put into the
cuckoo filter of its shard, one that falls below is taken out again: that is why
the filters are cuckoo filters (16 bytes a key shrink to a 32-bit fingerprint that can be
deleted).  A filter that gets too full is built anew from the counts.

``clean`` drops the lines whose key is in a filter.  The few keys that pass a filter
by chance are found in the exact counts beforehand and excepted, so the result is
exact.  Filters of at most ``FILTER_BYTES`` in all are sent to the tasks, which
then read the texts once and shuffle nothing; larger ones stay in their shards
and the line keys are dealt to them (salted by document).

Every change is a version: ``at`` opens an earlier one, ``delete`` undoes an
``insert`` exactly, and a change that failed before its version row was written left nothing.

Defined results: a row is a document, whatever its id (equal and null ids count
as several); a null or empty text has one empty line; keys of fewer than
``min_chars`` code points are never dropped; documents that were never inserted may be
cleaned with ``inserted=False``; deleting lines that were not inserted raises; an empty table changes
nothing and gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, maybe_broadcast, slices, written

THRESHOLD = 10
MIN_CHARS = 1
#: Filters of at most so many bytes go to every task.
FILTER_BYTES = 64 << 20
#: Parts of counts that are merged into one when a change finds more.
MAX_PARTS = 8
SLOTS = 4
FULL = 0.85
MAX_KICKS = 500
SPACE = b" \t\n\x0b\x0c\r"

COUNTS = "hi long, lo long, n long"
FILTERS = "shard long, buckets long, held long, slots binary, stash array<long>"
VERSIONS = "version long, parts array<string>, filters string, shards long, threshold long, min_chars long"


# --- one cuckoo filter ------------------------------------------------------------------------

class Cuckoo:
    """A cuckoo filter with four 32-bit fingerprints a bucket (0: free).  A fingerprint that finds
    no place after ``MAX_KICKS`` moves goes to the stash (bucket << 32 | fingerprint), so no key is ever lost."""

    def __init__(self, buckets: int, slots: bytes | None = None, stash=(), held: int = 0):
        self.buckets, self.held = buckets, held
        self.slots = np.zeros(buckets * SLOTS, np.uint32) if slots is None else np.frombuffer(slots, "<u4").copy()
        self.stash = list(stash)

    @staticmethod
    def buckets_for(keys: int) -> int:
        return 1 << max(2, (int(keys / (FULL * SLOTS) * 1.25)).bit_length())

    def _places(self, lo: int) -> tuple[int, int, int]:
        fp = lo & 0xFFFFFFFF or 1
        one = (lo >> 32) & (self.buckets - 1)
        return fp, one, self._other(one, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return bucket ^ (fp * 0x5BD1E995 >> 13 & (self.buckets - 1))

    def add(self, lo: int) -> None:
        fp, one, two = self._places(lo)
        self.held += 1
        at = one
        for bucket in (one, two):
            if self._put(bucket, fp):
                return
        for kick in range(MAX_KICKS):
            spot = at * SLOTS + (kick + fp) % SLOTS
            fp, self.slots[spot] = int(self.slots[spot]), fp
            at = self._other(at, fp)
            if self._put(at, fp):
                return
        self.stash.append(at << 32 | fp)

    def _put(self, bucket: int, fp: int) -> bool:
        free = np.flatnonzero(self.slots[bucket * SLOTS:bucket * SLOTS + SLOTS] == 0)
        if len(free):
            self.slots[bucket * SLOTS + free[0]] = fp
        return len(free) > 0

    def remove(self, lo: int) -> None:
        fp, one, two = self._places(lo)
        self.held -= 1
        for bucket in (one, two):
            if bucket << 32 | fp in self.stash:
                self.stash.remove(bucket << 32 | fp)
                return
            found = np.flatnonzero(self.slots[bucket * SLOTS:bucket * SLOTS + SLOTS] == fp)
            if len(found):
                self.slots[bucket * SLOTS + found[0]] = 0
                return
        raise ValueError("a line key is not in its filter")


class Filters:
    """All filters of an index, or some, side by side for vectorised look-ups."""

    def __init__(self, shards: int, rows):
        self.shards = shards
        self.base = np.zeros(shards, np.int64)
        self.mask = np.zeros(shards, np.uint64)
        flat, at, self.stash = [np.zeros(SLOTS, np.uint32)], 1, set()
        for shard, buckets, slots, stash in rows:
            self.base[shard], self.mask[shard] = at, buckets - 1
            flat.append(np.frombuffer(slots, "<u4"))
            at += buckets
            self.stash.update((shard, x) for x in stash)
        self.flat = np.concatenate(flat).reshape(-1, SLOTS)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        shard = np.mod(hi, self.shards)
        u = lo.view(np.uint64)
        fp = u & np.uint64(0xFFFFFFFF)
        fp[fp == 0] = 1
        mask, base = self.mask[shard], self.base[shard]
        one = (u >> np.uint64(32)) & mask
        two = one ^ ((fp * np.uint64(0x5BD1E995) >> np.uint64(13)) & mask)
        fp32 = fp.astype(np.uint32)[:, None]
        known = base > 0
        found = ((self.flat[base + one.astype(np.int64) * known] == fp32).any(1) | (self.flat[base + two.astype(np.int64) * known] == fp32).any(1)) & known
        if self.stash:
            for k in np.flatnonzero(~found).tolist():
                found[k] = any((int(shard[k]), int(b) << 32 | int(fp[k])) in self.stash for b in (one[k], two[k]))
        return found


# --- line keys --------------------------------------------------------------------------------

def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def text_keys(data: bytes, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text and the digest of each one's key (None: too short to be dropped)."""
    lines = data.split(b"\n")
    keys = [line_key(x) for x in lines]
    return lines, [hashlib.blake2b(k, digest_size=16).digest()
                   if len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars) else None for k in keys]


def two_longs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def key_counts(docs: DataFrame, min_chars: int = MIN_CHARS, sign: int = 1) -> DataFrame:
    """(hi, lo, n): in how many documents each line key occurs, times ``sign``.  Each slice of
    documents sends a key once, so a line that every document holds is one row a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 16 << 20):
            seen: dict[bytes, int] = {}
            for t in _texts(b):
                for d in set(text_keys(t, min_chars)[1]):
                    if d is not None:
                        seen[d] = seen.get(d, 0) + sign
            if seen:
                k = two_longs(list(seen))
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(list(seen.values()), pa.int64())], names=["hi", "lo", "n"])

    return docs.select("text").mapInArrow(run, COUNTS).groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def without(lines: list[bytes], digests: list[bytes | None], gone) -> tuple[int, int, bytes]:
    """Number of lines, how many of them have a key in ``gone``, the others joined."""
    kept = [x for x, d in zip(lines, digests) if d not in gone] if gone else lines
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _cleaned(b: pa.RecordBatch, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n, dropped, kept = zip(*rows)
    return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()),
                                       pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])


CLEANED = "doc_id long, n_lines long, n_dropped long, kept string"


# --- the index --------------------------------------------------------------------------------

@dataclass(frozen=True)
class LineIndex:
    """One version of an index below ``path``."""

    spark: SparkSession
    path: str
    version: int
    parts: tuple[str, ...]
    filter_path: str | None
    shards: int
    threshold: int
    min_chars: int

    @staticmethod
    def create(spark: SparkSession, path: str, shards: int | None = None, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> LineIndex:
        """An empty index; ``path`` lies in a folder that driver and executors share.  A shard's
        filter has to fit a task (four bytes a frequent key): size ``shards`` (default: the shuffle partitions) for that."""
        shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        return LineIndex(spark, path.rstrip("/"), -1, (), None, shards, threshold, min_chars)._commit()

    @staticmethod
    def open(spark: SparkSession, path: str, version: int | None = None) -> LineIndex:
        rows = spark.read.schema(VERSIONS).parquet(f"{path.rstrip('/')}/versions/*")
        at = rows.where(F.lit(True) if version is None else F.col("version") == version).orderBy(F.desc("version")).first()
        if at is None:
            raise ValueError(f"no such version below {path}")
        return LineIndex(spark, path.rstrip("/"), at.version, tuple(at.parts), at.filters, at.shards, at.threshold, at.min_chars)

    def at(self, version: int) -> LineIndex:
        return LineIndex.open(self.spark, self.path, version)

    def _commit(self) -> LineIndex:
        new = replace(self, version=self.version + 1)
        row = (new.version, list(new.parts), new.filter_path, new.shards, new.threshold, new.min_chars)
        self.spark.createDataFrame([row], VERSIONS).coalesce(1).write.parquet(f"{self.path}/versions/{new.version}")
        return new

    def _write(self, df: DataFrame, kind: str) -> str:
        at = f"{self.path}/{kind}/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return at

    def _shard(self):
        return F.pmod("hi", F.lit(self.shards)).alias("shard")

    def _signed(self, parts=None) -> DataFrame:
        parts = self.parts if parts is None else parts
        return self.spark.read.schema(COUNTS).parquet(*parts) if parts else self.spark.createDataFrame([], COUNTS)

    def counts(self) -> DataFrame:
        """(hi, lo, n) of every line key that some document holds."""
        return self._signed().groupBy("hi", "lo").agg(F.sum("n").alias("n")).where("n > 0")

    def filters(self) -> DataFrame:
        return self.spark.read.schema(FILTERS).parquet(self.filter_path) if self.filter_path else self.spark.createDataFrame([], FILTERS)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """The index with the lines of ``docs`` added."""
        return self._changed(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """The index without the lines of ``docs``, which were inserted before."""
        return self._changed(docs, text_col, -1)

    def _changed(self, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
        texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        part = self._write(key_counts(texts, self.min_chars, sign), "counts")
        delta = self._signed([part])
        if self.parts:
            was = (self._signed().join(delta.select("hi", "lo"), ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.sum("n").alias("was")))
            delta = delta.join(was, ["hi", "lo"], "left")
        else:
            delta = delta.withColumn("was", F.lit(0).cast("long"))
        delta = delta.select("hi", "lo", F.coalesce("was", F.lit(0)).alias("was")
                             , (F.col("n") + F.coalesce("was", F.lit(0))).alias("n"))
        if sign < 0 and not delta.where("n < 0").isEmpty():
            raise ValueError("these documents were not inserted")
        new = replace(self, parts=(*self.parts, part))
        if len(new.parts) > MAX_PARTS:
            new = replace(new, parts=(self._write(new.counts(), "counts"),))
        often = F.lit(self.threshold)
        crossed = delta.where((F.col("was") < often) != (F.col("n") < often)).select("hi", "lo", (F.col("n") >= often).alias("add"))
        if self.parts:  # read several times below; without parts it is one filter over the part just written
            crossed = written(crossed, "crossed-lines")
        return replace(new, filter_path=self._write(new._filters_after(self, crossed), "filters"))._commit()

    def _filters_after(self, before: LineIndex, crossed: DataFrame) -> DataFrame:
        """The filters of ``before`` with the crossed keys put in or taken out; too full ones anew."""
        sums = crossed.groupBy(self._shard()).agg(F.sum(F.when(F.col("add"), 1).otherwise(-1)).alias("more"), F.count_if("add").alias("added"))
        old = before.filters()
        now = written(old.select("shard", "buckets", "held").join(sums, "shard", "full")
                      .select("shard", "buckets", (F.coalesce("held", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("keys"),
                              (F.coalesce("held", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("most")), "filter-sizes")
        anew = now.where(F.col("buckets").isNull() | (F.col("most") > F.lit(FULL * SLOTS) * F.col("buckets"))).select("shard", "keys")
        key = lambda df, add: df.select(self._shard(), F.lit(1).alias("kind"), "lo", add.alias("add"), F.lit(None).cast("long").alias("keys"),
                                        F.lit(None).cast("long").alias("buckets"), F.lit(None).cast("long").alias("held"),
                                        F.lit(None).cast("binary").alias("slots"), F.lit(None).cast("array<long>").alias("stash"))
        fresh = anew.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("lo"), F.lit(True).alias("add"), "keys",
                            F.lit(None).cast("long").alias("buckets"), F.lit(None).cast("long").alias("held"),
                            F.lit(None).cast("binary").alias("slots"), F.lit(None).cast("array<long>").alias("stash"))
        rows = fresh
        if before.parts:  # an index with counts: its filters change in place, some are built from all counts
            kept = old.join(F.broadcast(anew), "shard", "left_anti")  # one row a shard
            rows = rows.union(kept.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("lo"), F.lit(True).alias("add"),
                                          F.lit(None).cast("long").alias("keys"), "buckets", "held", "slots", "stash"))
            rows = rows.union(key(crossed.join(F.broadcast(anew), self._shard_equals(anew), "left_anti"), F.col("add")))
            if not anew.isEmpty():
                whole = self.counts().where(F.col("n") >= self.threshold)
                rows = rows.union(key(whole.join(F.broadcast(anew), self._shard_equals(anew), "left_semi"), F.lit(True)))
        else:
            rows = rows.union(key(crossed, F.col("add")))
        n = min(self.shards, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return rows.repartition(n, "shard").sortWithinPartitions("shard", "kind", "add", "lo").mapInArrow(_built, FILTERS)

    def _shard_equals(self, other: DataFrame):
        return F.pmod(F.col("hi"), F.lit(self.shards)) == other["shard"]

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", inserted: bool = True,
              filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept (the other lines, joined) per document.  ``inserted=False``
        for documents that the index may not know: their own keys are then held against the counts."""
        rows = id_and_text(docs, id_col, text_col)
        size = self.filters().agg(F.sum(F.octet_length("slots")), F.sum(F.size("stash") * 8)).first()
        if sum(x or 0 for x in size) > filter_bytes:
            return self._clean_dealt(rows)
        sent = self.spark.sparkContext.broadcast([tuple(r) for r in self.filters().select("shard", "buckets", "slots", "stash").collect()])
        shards, min_chars = self.shards, self.min_chars
        keys = self.counts() if inserted else key_counts(rows, min_chars).select("hi", "lo").join(self.counts(), ["hi", "lo"], "left")
        chance = self._by_chance(keys, sent)
        excepted = self.spark.sparkContext.broadcast({two.tobytes() for two in np.array([tuple(r) for r in chance], "<i8").reshape(-1, 2)})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = Filters(shards, sent.value)
            for b in slices(batches, "text", 16 << 20):
                found = [text_keys(t, min_chars) for t in _texts(b)]
                known = list({d for _, digests in found for d in digests if d is not None})
                k = two_longs(known)
                gone = {d for d, hit in zip(known, filters.contains(k[:, 0], k[:, 1]).tolist()) if hit} - excepted.value
                yield _cleaned(b, [without(lines, digests, gone) for lines, digests in found])

        return rows.mapInArrow(run, CLEANED)

    def _by_chance(self, keys: DataFrame, sent) -> list:
        """Keys below the threshold that pass a filter: about one in 5 * 10**8 of them."""
        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = Filters(shards, sent.value)
            for b in batches:
                if b.num_rows:
                    hit = filters.contains(b.column(0).to_numpy(), b.column(1).to_numpy())
                    yield b.filter(pa.array(hit))

        low = keys.where(F.coalesce("n", F.lit(0)) < self.threshold).select("hi", "lo")
        return low.mapInArrow(run, "hi long, lo long").collect()

    def _clean_dealt(self, rows: DataFrame) -> DataFrame:
        """``clean`` with the filters left in their shards: line keys go there, hits come back."""
        shards, min_chars = self.shards, self.min_chars
        docs = written(rows.withColumn("ref", F.monotonically_increasing_id()), "line-texts")
        salts = max(1, 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // shards)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", 16 << 20):
                refs, digests = [], []
                for ref, t in zip(b.column(0).to_pylist(), _texts(b)):
                    own = {d for d in text_keys(t, min_chars)[1] if d is not None}
                    digests.extend(own)
                    refs.extend([ref] * len(own))
                if refs:
                    k = two_longs(digests)
                    yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1])], names=["ref", "hi", "lo"])

        keys = docs.select("ref", "text").mapInArrow(keyed, "ref long, hi long, lo long")
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        asked = keys.select(self._shard(), F.pmod(F.xxhash64("ref"), F.lit(salts)).alias("salt"), F.lit(1).alias("kind"), "ref", "hi", "lo",
                            none("long", "buckets"), none("binary", "slots"), none("array<long>", "stash"))
        held = self.filters().select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(0).alias("kind"),
                                     none("long", "ref"), none("long", "hi"), none("long", "lo"), "buckets", "slots", "stash")

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters, at = None, None
            for b in batches:
                for part in _runs(b, "shard", "kind"):
                    shard = part.column(0)[0].as_py()
                    if part.column(2)[0].as_py() == 0:
                        r = part.slice(0, 1).to_pylist()[0]
                        filters, at = Filters(shards, [(shard, r["buckets"], r["slots"], r["stash"])]), shard
                    elif at == shard:
                        hit = filters.contains(part.column(4).to_numpy(), part.column(5).to_numpy())
                        yield part.select(["ref", "hi", "lo"]).filter(pa.array(hit))

        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        hits = written(asked.union(held).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
                       .mapInArrow(test, "ref long, hi long, lo long"), "line-hits")
        often = self.counts().where(F.col("n") >= self.threshold).select("hi", "lo")
        chance = written(hits.select("hi", "lo").distinct().join(often, ["hi", "lo"], "left_anti"), "chance-lines")
        gone = (hits.join(maybe_broadcast(chance, 2), ["hi", "lo"], "left_anti")
                .groupBy("ref").agg(F.collect_list("hi").alias("his"), F.collect_list("lo").alias("los")))

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", 16 << 20):
                rows = []
                for t, his, los in zip(_texts(b), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    rows.append(without(*text_keys(t, min_chars), {x.tobytes() for x in np.array([his, los], "<i8").T} if his else ()))
                yield _cleaned(b, rows)

        return docs.join(gone, "ref", "left").select("doc_id", "text", "his", "los").mapInArrow(drop, CLEANED)


def _runs(b: pa.RecordBatch, *names: str) -> Iterator[pa.RecordBatch]:
    """A sorted batch in pieces of equal ``names``."""
    if not b.num_rows:
        return
    k = np.stack([b.column(b.schema.get_field_index(n)).to_numpy() for n in names])
    cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        yield b.slice(low, high - low)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters out of sorted rows: a shard's old filter or its number of keys first, then its keys."""
    shard, own = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"shard": shard, "buckets": own.buckets, "held": own.held, "slots": own.slots.astype("<u4").tobytes(), "stash": own.stash}],
                                          schema=pa.schema([("shard", pa.int64()), ("buckets", pa.int64()), ("held", pa.int64()),
                                                            ("slots", pa.binary()), ("stash", pa.list_(pa.int64()))]))

    for b in batches:
        for part in _runs(b, "shard", "kind"):
            if part.column(1)[0].as_py() == 0:
                if own is not None:
                    yield row()
                r = part.slice(0, 1).to_pylist()[0]
                shard = r["shard"]
                own = Cuckoo(Cuckoo.buckets_for(r["keys"])) if r["slots"] is None else Cuckoo(r["buckets"], r["slots"], r["stash"], r["held"])
                continue
            for lo, add in zip(part.column(2).to_numpy().view(np.uint64).tolist(), part.column(3).to_pylist()):
                own.add(lo) if add else own.remove(lo)  # sorted: removals first, they make room
    if own is not None:
        yield row()
