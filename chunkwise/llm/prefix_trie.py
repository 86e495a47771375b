"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns.  Its identity is the sum of one
128-bit hash per (depth, role, text), as two 64-bit lanes: the prefix sums of all
conversations come from one distributed scan (``running``), which cuts a long
conversation at any turn, so no task holds a whole one.  A node's parent is the
sum before its last turn, hence known without a join.

``contract`` alternates two join rounds on the tree until nothing is left:

* rake: leaves leave with their final totals, which their parents add up;
* compress: an only child with one child itself is merged into its parent, and its child is linked
  there.  Which of them go is read off bits of depths: a node goes if its bit of this round is set
  and its parent's is not, so never two neighbours, every other node of a fresh
  chain, and each node of a chain within one pass over the bits.

Nodes know the number and the xor of their active children, so an only child is found
without a look at the children; all messages are pre-aggregated sums and all
joins are between unique ids, so a node with any number of children is harmless.
``expand`` then replays the compress rounds backwards: a contracted node's total
is what it held itself plus its child's total, which is known by then.

Defined results: conversations are ordered by turn (null first; equal turns by the
digest of role and text); null role or text is empty; rows without a conv_id belong to no
conversation and are left out; equal rows are several turns; a table without
conversations gives no node; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, mix, shared_path, written

#: A conversation takes its first turns from the first conversation of its group of ``GROUP`` ids, fewer than ``HEADS`` of them.
GROUP = 5
HEADS = 9
#: Turns of a block when depths are moved; children above which a parent is looked up by broadcast.
BLOCK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- a distributed scan -----------------------------------------------------------------------

def running(df: DataFrame, key: str, order: list, values: Callable[[pa.RecordBatch], list[np.ndarray]], names: list[str], drop: tuple = ()) -> DataFrame:
    """``df`` (``key`` long, not null) with running sums (modulo 2**64) along ``order`` within ``key``:
    column x and, without the row's own value, x_before.

    Rows are sorted by ranges, so a key of any size spreads over tasks.  Only the sums at the end
    of each partition (one row a partition) go through the driver, to the partitions behind it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).drop(*drop)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)
    own = ordered.columns
    local_schema = f"{kept}, {', '.join(f'{x} long' for x in names)}, part int, last boolean"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pending, at, carry = TaskContext.get().partitionId(), None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            sums = []
            for k, v in enumerate(values(b)):
                total = np.cumsum(v, dtype=np.uint64)
                before = (total - v)[starts]
                if at is not None and at == keys[0]:
                    before[0] -= carry[k]
                sums.append(total - np.repeat(before, sizes))
            at, carry = keys[-1], [s[-1] for s in sums]
            if pending is not None:
                yield pending
            pending = pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in own), *(pa.array(s.view(np.int64)) for s in sums),
                 pa.array(np.full(len(keys), part, np.int32)), pa.array(np.zeros(len(keys), bool))], names=[*own, *names, "part", "last"])
        if pending is not None:
            last = np.zeros(pending.num_rows, bool)
            last[-1] = True
            yield pending.set_column(len(own) + len(names) + 1, "last", pa.array(last))

    found = written(ordered.mapInArrow(local, local_schema), "scan")
    carries, before = {}, None
    for r in sorted(found.where("last").select("part", key, *names).collect(), key=lambda r: r.part):
        total = np.array(r[2:], np.int64).view(np.uint64)
        if before is not None:
            carries[r.part] = before
            if before[0] == r[1]:
                total = total + before[1]
        before = (r[1], total)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, parts = b.column(key).to_numpy(), b.column("part").to_numpy()
            out = [b.column(x).to_numpy().view(np.uint64) for x in names]
            for p in np.unique(parts).tolist():
                if p in carries:
                    here = ((parts == p) & (keys == carries[p][0])).astype(np.uint64)
                    out = [x + here * c for x, c in zip(out, carries[p][1])]
            low = [x - v for x, v in zip(out, values(b))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *(pa.array(x.view(np.int64)) for x in out + low)],
                                             names=[*own, *names, *(f"{x}_before" for x in names)])

    return found.mapInArrow(whole, f"{kept}, {', '.join(f'{x} long' for x in names + [f'{x}_before' for x in names])}")


# --- conversations rebuilt --------------------------------------------------------------------

def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (hex, of role and text), n_bytes of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, t1, t2, n_bytes) and members (conv_id) of all rebuilt conversations."""
    lane = lambda k: F.conv(F.substring("digest", k, 16), 16, -10).cast("long")
    turns = turn_digests(conversations).select("conv_id", "turn", "digest", lane(1).alias("t1"), lane(17).alias("t2"), "n_bytes")
    placed = written(running(turns, "conv_id", [F.col("turn").asc_nulls_first(), "digest"], lambda b: [np.ones(b.num_rows, np.uint64)], ["pos"],
                             drop=("turn", "digest")), "turns")
    length = placed.groupBy("conv_id").agg(F.max("pos").alias("len"))
    own = F.col("conv_id")
    convs = written(length.select("conv_id", "len", F.pmod(F.crc32(own.cast("string").cast("binary")), F.lit(HEADS)).alias("h"),
                                  (own - own % GROUP).alias("base")), "conversations")
    heads = convs.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    members = written(convs.join(heads, "base", "left")
                      .select("conv_id", "base", "len", "h", F.least("h", F.coalesce("base_len", F.lit(0))).alias("k")), "members")
    head = (placed.where(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base")
            .join(members.select("conv_id", "base", "k"), "base").where("pos <= k")
            .select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "n_bytes"))
    # a short head moves the own turns up; the move is dealt by blocks of turns, so no conversation meets in one task
    block = lambda p: F.floor(p / BLOCK).cast("long")
    moved = (members.where("k < h and len > h")
             .select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), block(F.col("len")))).alias("block"), (F.col("h") - F.col("k")).alias("up")))
    first = F.pmod(F.crc32(own.cast("string").cast("binary")), F.lit(HEADS))
    tail = (placed.where(F.col("pos") > first).withColumn("block", block(F.col("pos"))).join(moved, ["conv_id", "block"], "left")
            .select("conv_id", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("depth"), "t1", "t2", "n_bytes"))
    return head.union(tail), members.select("conv_id")


def turn_hash(b: pa.RecordBatch) -> list[np.ndarray]:
    """The two lanes of every (depth, role, text)."""
    depth = b.column("depth").to_numpy().view(np.uint64) * _STEP
    return [mix(mix(b.column(t).to_numpy().view(np.uint64)) + depth) for t in ("t1", "t2")]


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node (a, b), its parent (pa, pb) and n_bytes of the last text, per turn."""
    done = running(turns, "conv_id", ["depth"], turn_hash, ["a", "b"], drop=())
    return done.select("conv_id", "depth", "a", "b", F.col("a_before").alias("pa"), F.col("b_before").alias("pb"), "n_bytes")


def nodes_of(turns: DataFrame, members: DataFrame) -> DataFrame:
    """a, b, pa, pb, depth, conv_id, n_convs, weight, n_children, xa, xb (xor of the children's ids) per node."""
    found = written(turns.groupBy("a", "b", "depth").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.min("n_bytes").alias("n_bytes")).select("a", "b", "pa", "pb", "depth", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("weight")),
        "trie-nodes")
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = (members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
            .select(zero.alias("a"), zero.alias("b"), null.alias("pa"), null.alias("pb"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("weight")))
    kids = (found.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"))
            .agg(F.count("*").alias("n_children"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb")))
    return found.union(root).join(kids, ["a", "b"], "left").fillna(0, ["n_children", "xa", "xb"])


# --- tree contraction -------------------------------------------------------------------------

TOTALS = "a long, b long, n_leaves long, saved long"


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """a, b, n_leaves, saved summed over the subtree of every node of (a, b, pa, pb, depth, weight, n_children, xa, xb)."""
    spark = nodes.sparkSession
    at = shared_path(spark, "contraction")
    paths, logs, totals = {}, [], []

    def put(df: DataFrame, name: str) -> DataFrame:
        paths[name] = f"{at}/{name}"
        df.write.parquet(paths[name])
        return spark.read.schema(df.schema).parquet(paths[name])

    tree = put(nodes.select("a", "b", "pa", "pb", "depth", (F.col("depth") - 1).alias("pdepth"), F.col("n_children").alias("n"), "xa", "xb",
                            F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("weight").alias("saved")), "tree")
    bits = max(1, int(tree.agg(F.max("depth")).first()[0] or 0).bit_length())
    step = 0
    while not tree.isEmpty():
        # rake
        put(tree.where("n = 0").select("a", "b", "n_leaves", "saved"), f"total-{step}")
        totals.append((step, f"total-{step}"))
        told = (tree.where("n = 0 and pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"))
                .agg(F.count("*").alias("less"), F.bit_xor("a").alias("ya"), F.bit_xor("b").alias("yb"),
                     F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
        tree = put(tree.where("n > 0").join(told, ["a", "b"], "left").fillna(0, ["less", "ya", "yb", "more_leaves", "more_saved"])
                   .select("a", "b", "pa", "pb", "depth", "pdepth", (F.col("n") - F.col("less")).alias("n"),
                           F.col("xa").bitwiseXOR(F.col("ya")).alias("xa"), F.col("xb").bitwiseXOR(F.col("yb")).alias("xb"),
                           (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved") + F.col("more_saved")).alias("saved")), f"raked-{step}")
        # compress
        bit = lambda c: F.shiftright(c, step % bits).bitwiseAND(F.lit(1))
        goes = (F.col("n") == 1) & F.col("pa").isNotNull() & (bit("depth") == 1) & (bit("pdepth") == 0)
        out = put(tree.where(goes), f"gone-{step}")
        if not out.isEmpty():
            logs.append((step, out.select("a", "b", "xa", "xb", "n_leaves", "saved")))
            zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
            up = out.select(F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("a").bitwiseXOR(F.col("xa")).alias("ya"), F.col("b").bitwiseXOR(F.col("xb")).alias("yb"),
                            F.col("n_leaves").alias("more_leaves"), F.col("saved").alias("more_saved"), null.alias("na"), null.alias("nb"), null.alias("nd"))
            down = out.select(F.col("xa").alias("a"), F.col("xb").alias("b"), zero.alias("ya"), zero.alias("yb"), zero.alias("more_leaves"), zero.alias("more_saved"),
                              F.col("pa").alias("na"), F.col("pb").alias("nb"), F.col("pdepth").alias("nd"))
            told = up.union(down).groupBy("a", "b").agg(
                F.bit_xor("ya").alias("ya"), F.bit_xor("yb").alias("yb"), F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"),
                F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("nd").alias("nd"))
            tree = put(tree.where(~goes).join(told, ["a", "b"], "left").fillna(0, ["ya", "yb", "more_leaves", "more_saved"])
                       .select("a", "b", F.coalesce("na", "pa").alias("pa"), F.coalesce("nb", "pb").alias("pb"), "depth", F.coalesce("nd", "pdepth").alias("pdepth"), "n",
                               F.col("xa").bitwiseXOR(F.col("ya")).alias("xa"), F.col("xb").bitwiseXOR(F.col("yb")).alias("xb"),
                               (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved") + F.col("more_saved")).alias("saved")), f"compressed-{step}")
        step += 1
    # expand: the totals of what left after a compress round give those of what left in it
    known = lambda names: spark.read.schema(TOTALS).parquet(*(paths[n] for n in names))
    for step, out in reversed(logs):
        later = known([name for s, name in totals if s > step])
        child = later.select(F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("n_leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))
        put(out.join(child, ["xa", "xb"]).select("a", "b", (F.col("n_leaves") + F.col("below_leaves")).alias("n_leaves"),
                                                 (F.col("saved") + F.col("below_saved")).alias("saved")), f"expanded-{step}")
        totals.append((step, f"expanded-{step}"))
    return known([name for _, name in totals]) if totals else spark.createDataFrame([], TOTALS)


# --- the query's columns ----------------------------------------------------------------------

def id_digests(rows: DataFrame) -> DataFrame:
    """a, b, ends_sha256: digest of the ascending conv_ids of each (a, b), comma-joined.  Sorted ranges
    first make strings of up to ``BLOCK`` ids, which one running digest per node then reads."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((k[:2, 1:] != k[:2, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            spans = [(i, min(i + BLOCK, high)) for low, high in zip(cuts, cuts[1:]) for i in range(low, high, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(k[r, [i for i, _ in spans]]) for r in range(3)]
                                             + [pa.array([",".join(map(str, k[2, i:j].tolist())) for i, j in spans], pa.string())], names=["a", "b", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, done = None, None, []
        for b in batches:
            for x, y, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if at == (x, y):
                    sha.update(b"," + ids.encode())
                    continue
                if at:
                    done.append((*at, sha.hexdigest()))
                at, sha = (x, y), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["a", "b", "ends_sha256"])
                done = []
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, sha.hexdigest())], names=["a", "b", "ends_sha256"])

    parts = (rows.repartitionByRange(n, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
             .mapInArrow(strings, "a long, b long, first long, ids string"))
    return (parts.repartition(n, "a", "b").sortWithinPartitions("a", "b", "first")
            .mapInArrow(digests, "a long, b long, ends_sha256 string"))


def with_parent_conv(nodes: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id.  Parents of many children are few (one in ``BLOCK`` nodes at most)
    and joined apart, so that no key of the shuffled join has more rows."""
    named = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    busy = maybe_broadcast(written(named.where(F.col("n_children") > BLOCK).drop("n_children"), "busy-parents"), 3)
    calm = named.where(F.col("n_children") <= BLOCK).drop("n_children")
    below = nodes.where("pa is not null")
    root = nodes.where("pa is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return root.unionByName(below.join(busy, ["pa", "pb"])).unionByName(below.join(busy, ["pa", "pb"], "left_anti").join(calm, ["pa", "pb"]))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node of
    the rebuilt conversations; the node's id (a, b) too."""
    turns, members = rebuilt(conversations)
    turns = written(prefixes(turns), "prefixes")
    nodes = written(nodes_of(turns, members), "trie")
    totals = subtree_totals(nodes)
    deepest = turns.groupBy("conv_id").agg(F.max(F.struct("depth", "a", "b")).alias("end"))
    ends = members.join(deepest, "conv_id", "left").select(F.coalesce("end.a", F.lit(0)).alias("a"), F.coalesce("end.b", F.lit(0)).alias("b"), "conv_id")
    return (with_parent_conv(nodes).join(totals, ["a", "b"]).join(id_digests(ends), ["a", "b"], "left")
            .select("a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))
