"""Near-duplicates by Order MinHash with banded alignment.

A text is the sequence of its distinct shingles of five words, in order of first
occurrence; that sequence is sketched and aligned.  Each of ``SKETCHES`` hash
functions picks the ``PICKS`` shingles with the smallest values; kept in text
order and hashed, they form one sketch, so texts collide if they share shingles
in the same order.  Texts of at most ``SHORT`` shingles have exact keys instead:
two texts that match share the two smallest of their matched shingles, and these
are among the first few of either text in hash order, so every pair of those
first few is a key (texts that only a longer one could match have both).  Texts
that share a key are candidates; a banded alignment of their sequences must
match ``SIMILARITY`` of the union.

Exact copies (equal words) are one text throughout.  A text is first compared
with one other: the most central text of all its buckets (texts with one key in
common; central is the text whose buckets are the largest: of a group of copies,
its original).  Then come, as far as their texts are still in different classes,
the central texts of its other buckets and its neighbours when a bucket is sorted
by the further keys, where the texts that agree in most of them stand together.
Buckets that then still hold several classes are settled: every text outside the largest
class is held against every text of another class there, so no pair of a bucket
stays open and no partner is capped.  Buckets of one most central text are
settled together, large ones in blocks.  Classes are the connected components;
links found later join classes, one link for a pair of them, so the
edges stay near the number of texts whatever the size of a group.
A pair of short texts is always a candidate; a pair at the threshold of longer
ones is missed with probability below 2.5 * 10**-5 (5 * 10**-6 for long texts).

Defined results: one row per document; class id = smallest id of the class; a
null text is empty; texts without words are copies of one another; texts of
fewer than five words match equal ones only; null ids count as the smallest
and come back as null; rows with equal or null ids share a class only through
their texts; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, maybe_broadcast, mix, slices, span_hashes, word_spans, written
from .components import components, merged

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 40
PICKS = 6
#: Texts of so many shingles at most have exact keys.
SHORT = 32
#: Texts and shingles of a block when a bucket is settled.
BLOCK_TEXTS = 1024
BLOCK_SHINGLES = 1 << 20
#: Stands for a null id: the smallest.
LOW = -(1 << 63)

_SEEDS = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
_STEP = np.uint64(0xA0761D6478BD642F)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's word shingles in text order (none below ``words`` words)."""
    data, starts, ends = word_spans(text.lower().encode())
    n = len(starts) - words + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = span_hashes(data, starts, ends)
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = out * _STEP + h[k:k + n]
    return mix(out)


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingle hashes that also tell the first, second, ... occurrence apart."""
    order = np.argsort(s, kind="stable")
    new = np.ones(len(s), bool)
    new[1:] = s[order[1:]] != s[order[:-1]]
    at = np.arange(len(s))
    occurrence = np.empty(len(s), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(s + occurrence * _STEP)


def sketch(s: np.ndarray, sketches: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """Order MinHash of a shingle sequence: one hash per hash function."""
    lab = labelled(s)
    picks = min(picks, len(lab))
    out = np.zeros(sketches, np.uint64)
    rows = max(1, (1 << 17) // len(lab))
    for k in range(0, sketches, rows):
        seeds = _SEEDS[k:min(k + rows, sketches), None]
        v = lab[None, :] * seeds
        pos = np.sort(np.argpartition(v, picks - 1, axis=1)[:, :picks], axis=1)
        acc = seeds[:, 0].copy()
        for j in range(picks):
            acc = mix(acc * _STEP + lab[pos[:, j]])
        out[k:k + rows] = acc
    return out


def short_keys(s: np.ndarray) -> np.ndarray:
    """Keys of which any two sequences of distinct shingles that match have one in common.

    Matched shingles are at least ``SIMILARITY`` of either text, so the two smallest of
    them in hash order lie within the first n - least + 2 of both, in the same text order."""
    least = math.ceil(SIMILARITY * len(s) - 1e-9)
    both = min(2, len(s))
    at = np.sort(np.argsort(mix(s ^ _STEP))[:len(s) - least + both])
    first, second = np.triu_indices(len(at), both - 1)
    return mix(mix(s[at[first]]) * _STEP + s[at[second]])


def keys_of(s: np.ndarray) -> np.ndarray:
    """Bucket keys of a sequence of distinct shingles."""
    exact = short_keys(s) if len(s) <= SHORT / SIMILARITY else s[:0]
    return np.concatenate([exact, sketch(s)]) if len(s) > SHORT else exact


def first_seen(s: np.ndarray) -> np.ndarray:
    """The distinct shingles, ordered by first occurrence."""
    _, at = np.unique(s, return_index=True)
    return s[np.sort(at)]


def alignment(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shared share of two sequences of distinct shingles under the best alignment
    inside the band that ``least`` allows; 0 if it is below ``least``.

    Matched pairs must increase on both sides (longest increasing run), and no
    alignment that reaches ``least`` leaves the band, so the band loses nothing."""
    need = least * (len(a) + len(b)) / (1 + least)
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(ia) < need - 1e-9:
        return 0.0
    band = max(len(a), len(b)) - int(need) + 1
    ok = np.abs(ia - ib) <= band
    ia, ib = ia[ok], ib[ok]
    run = ib[np.argsort(ia)]
    if len(run) > 1 and (run[1:] > run[:-1]).all():
        n = len(run)
    else:
        tails: list[int] = []
        for x in run.tolist():
            k = bisect_left(tails, x)
            tails[k:k + 1] = [x]
        n = len(tails)
    score = n / (len(a) + len(b) - n)
    return score if score >= least - 1e-12 else 0.0


def words_digest(text: str) -> bytes:
    """The same for texts of equal words."""
    return hashlib.blake2b(b" ".join(text.lower().encode().split()), digest_size=16).digest()


def sketches_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest of the words, number of distinct shingles, keys (null below ``WORDS`` words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8 << 20):
            digests, sizes, rows = [], [], []
            for t in b.column(1).to_pylist():
                digests.append(words_digest(t))
                s = first_seen(shingles(t))
                sizes.append(len(s))
                rows.append(keys_of(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                                              pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "digest", "size", "sketches"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, digest binary, size long, sketches array<long>")


def sequences(texts: DataFrame) -> DataFrame:
    """doc_id, digest, the distinct shingles in order of first occurrence (64-bit little-endian)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8 << 20):
            own = b.column(1).to_pylist()
            out = [first_seen(shingles(t)).astype("<u8").tobytes() for t in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(words_digest, own), pa.binary()), pa.array(out, pa.binary())],
                                             names=["doc_id", "digest", "sequence"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, sequence binary")


def verified(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``alike``; ``content`` holds (rep, sequence) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = [alignment(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")) > 0 for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["a", "b", "alike"])

    left = content.select(F.col("rep").alias("a"), F.col("sequence").alias("x"))
    right = content.select(F.col("rep").alias("b"), F.col("sequence").alias("y"))
    return (pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
            .mapInArrow(run, "a long, b long, alike boolean"))


def central(members: DataFrame) -> DataFrame:
    """(key, lead, weight): the most central text of every bucket and how many texts its buckets hold."""
    weight = members.groupBy("rep").agg(F.sum("n").alias("weight"))
    return (members.select("key", "rep").join(weight, "rep")
            .groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("lead"))).alias("most"))
            .select("key", (-F.col("most.lead")).alias("lead"), "most.weight"))


def first_pairs(members: DataFrame, leads: DataFrame) -> DataFrame:
    """(a, b): every text and the most central of its buckets' most central texts."""
    best = (members.select("key", "rep").join(leads, "key").where("rep <> lead")
            .groupBy("rep").agg((-F.max(F.struct("weight", (-F.col("lead")).alias("lead")))["lead"]).alias("other")))
    return best.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def further_pairs(members: DataFrame, leads: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different classes, of rows (rep, key, s1, s2, s3): a text and a
    bucket's most central text, and neighbours in the order of the further keys."""
    labels = labels.withColumnRenamed("node", "rep")
    classed = members.join(labels, "rep", "left").withColumn("class", F.coalesce("label", "rep"))
    led = leads.join(labels.withColumnRenamed("rep", "lead"), "lead", "left").select("key", "lead", F.coalesce("label", "lead").alias("lead_class"))
    star = classed.join(led, "key").where("class <> lead_class").select("rep", F.col("lead").alias("other"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(k).to_numpy() for k in range(3)])
            before = np.concatenate([rows[:, :1] if last is None else last, rows[:, :-1]], axis=1)
            last = rows[:, -1:]
            other = (before[0] == rows[0]) & (before[2] != rows[2])
            yield pa.RecordBatch.from_arrays([pa.array(rows[1, other]), pa.array(before[1, other])], names=["rep", "other"])

    # a global sort: a bucket of any size spreads over the range partitions
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "s1", "s2", "s3", "rep"]
    ordered = classed.select("key", "rep", "class", "s1", "s2", "s3").repartitionByRange(n, *order).sortWithinPartitions(*order)
    chained = ordered.select("key", "rep", "class").mapInArrow(chain, "rep long, other long")
    return star.union(chained).select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def open_texts(members: DataFrame, leads: DataFrame, labels: DataFrame) -> DataFrame:
    """(lead, rep, size, class) of the buckets with several classes.  Two texts that
    are a whole bucket were compared with one another already."""
    classed = (members.where("n > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
               .select("key", "rep", "size", F.coalesce("label", "rep").alias("class")))
    several = classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    return classed.join(several, "key").join(leads, "key").select("lead", "rep", "size", "class").distinct()


def blocked(texts: DataFrame) -> DataFrame:
    """(lead, i, j, side, rep, class): all pairs of blocks in which some text is outside
    the largest class of its lead; side 0 is block i."""
    share = texts.groupBy("lead", "class").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    main = share.groupBy("lead").agg(F.max(F.struct("n", "class", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK_TEXTS), F.ceil(size / BLOCK_SHINGLES))
    plan = written(main.select("lead", F.col("main.class").alias("main"), parts(F.col("main.n"), F.col("main.size")).alias("large"),
                               parts(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("rest")), "block-counts")
    at = (texts.join(maybe_broadcast(plan, 4), "lead").withColumn("inside", F.col("class") == F.col("main"))
          .withColumn("block", F.when(F.col("inside"), F.col("rest") + F.pmod(F.xxhash64("rep"), "large")).otherwise(F.pmod(F.xxhash64("rep"), "rest")))
          .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("inside"), F.col("rest")).otherwise(F.col("rest") + F.col("large")) - 1))))
    return at.select("lead", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     (F.col("block") > F.col("other")).cast("int").alias("side"), "rep", "class")


def links_across(sides: np.ndarray, ids: np.ndarray, classes: np.ndarray, found: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the classes of two blocks (of one block, if no side is 1) as far as
    its texts do: every pair of different classes is decided by its count of equal
    shingles, and by alignment where that allows a match."""
    root, size = classes.copy(), np.array([len(s) for s in found])
    one = not sides.any()
    looked, held = np.flatnonzero(sides == 0), np.flatnonzero(sides == (0 if one else 1))
    if not len(looked) or not len(held) or (root == root[0]).all():
        return []
    _, code = np.unique(np.concatenate(found), return_inverse=True)
    starts = np.cumsum(size) - size
    where = np.concatenate([code[starts[k]:starts[k] + size[k]] for k in held])
    order = np.argsort(where, kind="stable")
    texts = np.repeat(held, size[held])[order]
    count = np.bincount(where, minlength=int(code.max()) + 1)
    begin = np.cumsum(count) - count
    out = []
    for r in looked.tolist():
        may = np.zeros(len(found), bool)
        may[held] = True
        if one:
            may[:r + 1] = False
        may &= root != root[r]
        least = SIMILARITY * (size[r] + size) / (1 + SIMILARITY) - 1e-9
        may &= np.minimum(size, size[r]) >= least
        if not may.any():
            continue
        own = code[starts[r]:starts[r] + size[r]]
        own = own[count[own] > 0]
        n = count[own]
        hits = np.bincount(texts[np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(found))
        for c in np.flatnonzero(may & (hits >= least)).tolist():
            if root[c] != root[r] and alignment(found[r], found[c]) > 0:
                root[root == root[c]] = root[r]
                out.append((int(ids[r]), int(ids[c])))
    return out


def settled(rows: DataFrame, content: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of ``blocked`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def links() -> pa.RecordBatch:
            side, ids, classes = (np.concatenate([h[k] for h in held]) for k in range(3))
            found = [np.frombuffer(x, "<u8") for h in held for x in h[3]]
            ab = links_across(side, ids, classes, found)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in ab], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in slices(batches, "sequence", 8 << 20):
            group = np.stack([b.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if held and at != group[:, low].tolist():
                    yield links()
                    held = []
                at = group[:, low].tolist()
                part = b.slice(low, high - low)
                held.append((*(part.column(k).to_numpy() for k in (3, 4, 5)), part.column(6).to_pylist()))
        if held:
            yield links()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.join(content, "rep").select("lead", "i", "j", "side", "rep", "class", "sequence")
            .repartition(n, "lead", "i", "j").sortWithinPartitions("lead", "i", "j").mapInArrow(run, "a long, b long"))


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (``LOW`` for null), digest, node of the class, smallest id of the class and of the equal texts."""
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(LOW)))
    sk = written(sketches_of(rows), "sketches")
    # every text has a number of its own, whatever the ids are; written, so it stays
    reps = written(sk.groupBy("digest", "size", "sketches").agg(F.min("doc_id").alias("first"))
                   .withColumn("rep", F.monotonically_increasing_id()), "texts")
    shown = reps.where("sketches is not null").select(
        "rep", "size", F.posexplode("sketches").alias("k", "key"), F.concat(*["sketches"] * 4).alias("all"))
    buckets = shown.select("rep", "size", "key", F.element_at("all", F.col("k") + 2).alias("s1"), F.element_at("all", F.col("k") + 3).alias("s2"),
                           F.element_at("all", F.col("k") + 4).alias("s3"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(buckets.join(shared, "key"), "buckets")
    wanted = written(reps.join(members.select("rep").distinct(), "rep", "left_semi")
                     .select(F.col("first").alias("doc_id"), "digest", "rep"), "candidates")
    some = rows.join(maybe_broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    content = written(sequences(some).join(maybe_broadcast(wanted, 4), ["doc_id", "digest"])
                      .select("rep", "sequence").dropDuplicates(["rep"]), "candidate-texts")
    leads = written(central(members), "leads")
    alike = lambda pairs: written(verified(pairs, content).where("alike").select("a", "b"), "links")
    labels = components(alike(first_pairs(members, leads)))
    labels = merged(labels, alike(further_pairs(members, leads, labels)))
    open_ = written(open_texts(members, leads, labels), "open-texts")
    if not open_.isEmpty():
        labels = merged(labels, written(settled(blocked(open_), content), "links"))
    texts = (reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
             .select("digest", "first", F.coalesce("label", "rep").alias("class")))
    smallest = texts.groupBy("class").agg(F.min("first").alias("class_id"))
    return sk.select("doc_id", "digest").join(texts.join(smallest, "class"), "digest")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, copies_of (smallest id with the same words) per document."""
    null = lambda c, name: F.when(F.col(c) != LOW, F.col(c)).alias(name)
    return classes_of(docs, id_col, text_col).select(null("doc_id", "doc_id"), null("class_id", "class_id"), null("first", "copies_of"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of every class; columns as before.  A document is
    its id and its words: rows that share an id only are told apart, equal ones stay once."""
    classes = written(classes_of(docs, id_col, text_col).select("doc_id", "digest", "class", "class_id"), "classes")
    repeated = written(classes.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    gone = written(classes.where("doc_id <> class_id").select("doc_id").distinct(), "dropped")
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(LOW))
    if repeated.isEmpty():
        mine = maybe_broadcast(gone.select(F.col("doc_id").alias("__doc")))
        return docs.join(mine, own == F.col("__doc"), "left_anti").select(*docs.columns)
    # ids that occur once as above; of the others, the first words of every class whose smallest id they are
    mine = maybe_broadcast(gone.union(repeated).distinct().select(F.col("doc_id").alias("__doc")))
    once = docs.join(mine, own == F.col("__doc"), "left_anti").select(*docs.columns)
    first = (classes.where("doc_id = class_id").groupBy("class").agg(F.min("doc_id").alias("__doc"), F.min("digest").alias("__digest"))
             .join(repeated.withColumnRenamed("doc_id", "__doc"), "__doc", "left_semi").select("__doc", "__digest"))
    digest = F.udf(words_digest, "binary", useArrow=True)
    several = (docs.join(repeated.withColumnRenamed("doc_id", "__doc"), own == F.col("__doc"))
               .withColumn("__digest", digest(F.coalesce(F.col(text_col), F.lit(""))))
               .join(first, ["__doc", "__digest"]).dropDuplicates(["__doc", "__digest"]))
    return once.unionByName(several.select(*docs.columns))
