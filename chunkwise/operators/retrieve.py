"""Exact cosine top-k.

Distance = 1 - cos(q, c), clamped at 0, kept when ``min_distance <= d <
max_distance``; nearest first, ties broken by the corpus id.  Flat (exact)
scan, as in the reference.

Plans:

* tables of queries (:func:`top_k`): the corpus scan reads the id and the
  vector only, once.  Query vectors of at most ``max_broadcast_bytes`` (counted rows x dim x 8
  bytes) are broadcast; a task scores every Arrow batch against them
  in a NumPy block product and keeps its own top-k per query as
  (query, id, distance).  More queries make a grid: query blocks by corpus splits, a
  cell for each pair, dealt by a shuffle.  A cell reads its queries first, then its corpus rows as
  a stream, so the driver sees no vector and a task holds one block of queries (``CELL_BYTES``, or the budget if that is more).
  Corpus rows are sent once for each query block, queries once for each split; a smaller budget makes up to ``COPIES`` blocks.  The cells' rows are merged in two levels, first by (query,
  partition modulo ``MERGE_WAYS``), then by query, so no task sorts the
  candidates of all partitions.  The payload columns are joined to the
  ``queries x k`` hits at the end.
* no pair table is ever built: candidates are scored inside each corpus
  partition and only the per-partition top-k leave it.
* :func:`nearest` (R1) for one literal vector: the same scan with one query; each partition gives its ``k``
  nearest, ``orderBy(distance, id).limit(k)`` takes them (TakeOrderedAndProject), and their rows are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

DEFAULT_K = 5
DEFAULT_MAX_DISTANCE = 0.6
# Distances are compared at this many decimals, so exact copies of a chunk tie
# regardless of summation order (BLAS blocking) and fall back to the id order.
DISTANCE_DECIMALS = 9
# Largest (corpus rows x queries) distance block held at once (16 MB of doubles), and corpus rows scored at once.
MAX_BLOCK = 1 << 21
ROWS = 2048


# ---------------------------------------------------------------------------
# column maths (HOF, JVM-side)

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """greatest(1 - cos, 0); NULL when a vector is NULL or has zero norm."""
    den = norm(a) * norm(b)
    return F.round(F.greatest(F.lit(1.0) - dot(a, b) / F.nullif(den, F.lit(0.0)), F.lit(0.0)), DISTANCE_DECIMALS)


# ---------------------------------------------------------------------------
# One literal vector

def nearest(corpus: DataFrame, vector, k: int = DEFAULT_K, max_distance: float = DEFAULT_MAX_DISTANCE,
            min_distance: float = 0.0, corpus_id: str = "chunk_id", corpus_vec: str = "embedding",
            drop_vector: bool = True) -> DataFrame:
    """The ``k`` nearest corpus rows with ``distance``, nearest first; ``corpus_id`` is unique in the corpus."""
    v = np.asarray(vector, dtype=np.float64)
    vn = float(np.sqrt(v @ v))
    if vn == 0:
        raise ValueError("query vector has zero norm")
    slim = corpus.select(corpus_id, corpus_vec).where(F.col(corpus_vec).isNotNull())
    schema = T.StructType([T.StructField("_qid", T.LongType()), T.StructField(corpus_id, slim.schema[corpus_id].dataType),
                           T.StructField("distance", T.DoubleType())])
    sent = corpus.sparkSession.sparkContext.broadcast(([0], (v / vn)[None, :]))
    hits = (slim.mapInArrow(_scan(sent, k, max_distance, min_distance, corpus_id, corpus_vec, len(v), schema), schema)
            .orderBy("distance", corpus_id).limit(k).drop("_qid"))  # at most k rows
    rows = corpus.drop(corpus_vec) if drop_vector else corpus
    return rows.join(F.broadcast(hits), corpus_id).select(*rows.columns, "distance").orderBy("distance", corpus_id)


# ---------------------------------------------------------------------------
# R2: a table of queries

#: First-level merge groups of one query.
MERGE_WAYS = 64
#: Hits up to this many are broadcast to the payload scan (about 100 bytes each).
MAX_HIT_ROWS = 2_000_000
#: Hits up to this many have their sources named in a filter.
MAX_NAMES = 10_000


def top_k(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_K,
          max_distance: float = DEFAULT_MAX_DISTANCE, min_distance: float = 0.0, *,
          query_id: str = "query_id", query_vec: str = "embedding",
          corpus_id: str = "chunk_id", corpus_vec: str = "embedding",
          payload: list[str] | None = None, dim: int | None = None,
          max_broadcast_bytes: int = 32 << 20, source: str | None = None) -> DataFrame:
    """Top-k corpus rows per query; ``corpus_id`` is unique in the corpus.

    Returns ``query_id``, the corpus id, the ``payload`` columns (default: every
    corpus column except the vector), ``distance`` and ``rank`` (1-based).
    Queries with no hit have no row (left-join the query table for them).

    ``source``: a payload column that names what a row was made of (a chunk's file).  The scan carries it, up to
    ``MAX_NAMES`` hits are written, and the payload is taken from the hits' sources only, so a corpus that is computed is not computed twice.
    """
    if payload is None:
        payload = [c for c in corpus.columns if c not in (corpus_vec, corpus_id)]
    payload = [c for c in payload if c != corpus_id]
    qv = queries.select(F.col(query_id).alias("_qid"), F.col(query_vec).alias("_qvec")) \
        .where(F.col("_qvec").isNotNull())
    spark = corpus.sparkSession
    if dim is None:  # size the bound from the actual vectors (one row)
        first = qv.select(F.size("_qvec").alias("n")).limit(1).collect()
        dim = max(1, first[0]["n"]) if first else 1
    total, max_rows = qv.count(), max(1, max_broadcast_bytes // (8 * dim))
    more = [source] if source in payload and 0 < total <= min(max_rows, MAX_NAMES // k) else []
    slim = corpus.select(corpus_id, corpus_vec, *more).where(F.col(corpus_vec).isNotNull())
    schema = T.StructType([T.StructField("_qid", qv.schema["_qid"].dataType), T.StructField(corpus_id, slim.schema[corpus_id].dataType),
                           T.StructField("distance", T.DoubleType()), *[T.StructField(c, slim.schema[c].dataType) for c in more]])
    if total > max_rows:
        cands = _grid(qv, slim.toDF("_cid", "_cvec"), total, max_rows, k, max_distance, min_distance, dim, schema)
    else:
        rows = qv.select("_qid", "_qvec").collect() if total else []  # at most max_rows
        if any(len(v) != dim for _, v in rows):
            raise ValueError(f"query vectors must all have {dim} dimensions")
        block = _unit_rows([i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float64), dim)
        if block:
            sent = spark.sparkContext.broadcast(block)
            cands = slim.mapInArrow(_scan(sent, k, max_distance, min_distance, corpus_id, corpus_vec, dim, schema, more), schema)
        else:
            cands = spark.createDataFrame([], schema)
    near = [F.col("distance").asc(), F.col(corpus_id).asc()]
    part = cands.withColumn("_way", F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS)))
    part = part.withColumn("_r", F.row_number().over(Window.partitionBy("_qid", "_way").orderBy(*near))).where(F.col("_r") <= k)
    hits = (part.select("_qid", corpus_id, "distance", *more)
            .withColumn("rank", F.row_number().over(Window.partitionBy("_qid").orderBy(*near))).where(F.col("rank") <= k))
    if payload:
        rows = corpus.select(corpus_id, *payload)
        if more:
            at = scratch_path(spark, "hits")
            hits.write.parquet(at)
            hits = spark.read.schema(hits.schema).parquet(at)
            # a filter by value reaches the files the corpus is made of; a join stays above what makes it
            rows = rows.where(F.col(source).isin([r[0] for r in hits.select(source).distinct().collect()]))
            hits = hits.drop(source)
        small = F.broadcast(hits) if total * k <= MAX_HIT_ROWS else hits
        hits = rows.join(small, corpus_id)
    return hits.select(F.col("_qid").alias(query_id), corpus_id, *payload, "distance", "rank")


def _unit_rows(ids: list, vectors: np.ndarray, dim: int) -> tuple[list, np.ndarray] | None:
    """(ids, unit vectors) of a matrix of vectors; those without a direction are left out."""
    mat = np.asarray(vectors, dtype=np.float64).reshape(-1, dim)
    n = np.sqrt(np.einsum("ij,ij->i", mat, mat))
    good = n > 0
    return ([i for i, g in zip(ids, good) if g], mat[good] / n[good, None]) if good.any() else None


def _matrix(vec: pa.Array, dim: int, what: str) -> np.ndarray:
    """The vectors of an Arrow column as they are typed."""
    if not (pc.list_value_length(vec).to_numpy(zero_copy_only=False) == dim).all():
        raise ValueError(f"{what} vectors must all have {dim} dimensions")
    return vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _select_topk(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best (distance, id) per query value in q."""
    if ids.dtype == object:
        ids = np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((ids, d, q))
    qs = q[order]
    start = np.r_[0, np.nonzero(qs[1:] != qs[:-1])[0] + 1]
    rank = np.arange(len(qs)) - np.repeat(start, np.diff(np.r_[start, len(qs)]))
    return order[rank < k]


class _Cell:
    """The nearest ``k`` of the corpus rows seen so far, for every query of a block.  Rows are scored in tiles of
    at most ``MAX_BLOCK`` distances; a tile gives only what is as near as the query's ``k``-th so far."""

    def __init__(self, block: tuple[list, np.ndarray], k: int, max_d: float, min_d: float, dim: int):
        self.ids, self.Q = block
        self.k, self.max_d, self.min_d, self.dim = k, max_d, min_d, dim
        self.found, self.waiting = [], 0  # (query, distance, id, *more) arrays, the first those kept
        self.bound = np.full(len(self.Q), np.inf)

    def see(self, ids: pa.Array, vec: pa.Array, *more: pa.Array) -> None:
        if len(vec) == 0:
            return
        C = _matrix(vec, self.dim, "corpus")
        cols = [x.to_numpy(zero_copy_only=False) for x in (ids, *more)]
        for r0 in range(0, len(C), ROWS):
            self._tiles(C[r0:r0 + ROWS].astype(np.float64), [x[r0:r0 + ROWS] for x in cols])

    def _tiles(self, C: np.ndarray, cols: list[np.ndarray]) -> None:
        cn = np.sqrt(np.einsum("ij,ij->i", C, C))
        if not (cn > 0).all():
            C, cols, cn = C[cn > 0], [x[cn > 0] for x in cols], cn[cn > 0]
        if not len(C):
            return
        C /= cn[:, None]
        # query tiles keep the (rows x queries) distance block under MAX_BLOCK entries
        step = max(1, MAX_BLOCK // C.shape[0])
        for q0 in range(0, self.Q.shape[0], step):
            D = C @ self.Q[q0:q0 + step].T
            np.subtract(1.0, D, out=D)
            np.maximum(D, 0.0, out=D)
            # rounded distances decide; unrounded ones within half a unit of the last place are looked at
            near = D <= np.minimum(self.bound[q0:q0 + step], self.max_d)[None, :] + 10.0 ** -DISTANCE_DECIMALS
            r, c = np.nonzero(near)
            d = np.round(D[r, c], DISTANCE_DECIMALS)
            valid = (d >= self.min_d) & (d < self.max_d)
            r, c, d = r[valid], c[valid], d[valid]
            if len(d) > 4 * self.k * D.shape[1] and self.k < D.shape[0]:
                D.fill(np.inf)
                D[r, c] = d
                near = d <= np.partition(D, self.k - 1, axis=0)[self.k - 1][c]
                r, c, d = r[near], c[near], d[near]
            if len(d):
                self.found.append((c + q0, d, *[x[r] for x in cols]))
                self.waiting += len(d)
        if self.waiting > self.k * len(self.Q):
            self._merge()

    def _merge(self) -> None:
        if not self.waiting:
            return
        rows = [np.concatenate(x) for x in zip(*self.found)]
        sel = _select_topk(*rows[:3], self.k)
        rows = [x[sel] for x in rows]
        self.found, self.waiting = [tuple(rows)], 0
        # rows are in the order of query and distance: the k-th of a query is its last
        q, d = rows[:2]
        last = np.r_[np.flatnonzero(q[1:] != q[:-1]), len(q) - 1]
        full = np.bincount(q, minlength=len(self.Q))[q[last]] == self.k
        self.bound[q[last[full]]] = d[last[full]]

    def rows(self, arrow: pa.Schema):
        self._merge()
        if not self.found:
            return
        (q, *rest), = self.found
        qids = pa.array(self.ids, type=arrow.field(0).type)
        d, i, *more = rest
        for s in range(0, len(q), 65536):
            e = s + 65536
            own = [pa.array(x[s:e], type=arrow.field(n).type) for n, x in enumerate([i, d, *more], 1)]
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q[s:e])), *own], schema=arrow)


def _scan(sent, k, max_d, min_d, corpus_id, corpus_vec, dim, schema, more=()):
    """One pass over a corpus partition: its own top-k per broadcast query."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def fn(batches):
        cell = _Cell(sent.value, k, max_d, min_d, dim)
        for b in batches:
            cell.see(*[b.column(x) for x in (corpus_id, corpus_vec, *more)])
        yield from cell.rows(arrow)

    return fn


#: Largest share of a query block's rows above the even share, when they are dealt by hash.
_SLACK = 1.25
#: Bytes of query vectors (doubles) that one task of the grid holds.
CELL_BYTES = 32 << 20
#: Query blocks, hence copies of the corpus, that a budget below CELL_BYTES may ask for.
COPIES = 6
#: Cells of the grid for each task slot.
CELLS_PER_SLOT = 3


def _shape(total: int, max_rows: int, dim: int, slots: int) -> tuple[int, int]:
    """(query blocks, corpus splits).  The corpus is sent once for each block, the queries once for each split, so
    their number is bounded by the task slots; only blocks of CELL_BYTES make more of them."""
    rows = int(total * _SLACK)
    blocks = max(-(-rows // max(max_rows, CELL_BYTES // (8 * dim))), min(-(-rows // max_rows), COPIES))
    return blocks, max(1, -(-CELLS_PER_SLOT * slots // blocks))


def _grid(qv: DataFrame, cv: DataFrame, total: int, max_rows: int, k: int, max_d: float, min_d: float, dim: int, schema: T.StructType) -> DataFrame:
    """Top-k rows of every (query block, corpus split), dealt by a shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    blocks, splits = _shape(total, max_rows, dim, qv.sparkSession.sparkContext.defaultParallelism)
    copies = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    null = lambda f: F.lit(None).cast(f.dataType)
    kinds = {qv.schema["_qvec"].dataType.elementType.simpleString(), cv.schema["_cvec"].dataType.elementType.simpleString()}
    vector = "array<float>" if kinds == {"float"} else "array<double>"
    queries = qv.select(F.pmod(F.xxhash64("_qid", "_qvec"), F.lit(blocks)).cast("int").alias("_qb"), copies(splits, "_cs"), F.lit(0).alias("_kind"),
                        "_qid", null(cv.schema["_cid"]).alias("_cid"), F.col("_qvec").cast(vector).alias("_vec"))
    rows = cv.select(copies(blocks, "_qb"), F.pmod(F.xxhash64("_cid", "_cvec"), F.lit(splits)).cast("int").alias("_cs"), F.lit(1).alias("_kind"),
                     null(qv.schema["_qid"]).alias("_qid"), "_cid", F.col("_cvec").cast(vector).alias("_vec"))
    dealt = queries.union(rows).repartition(blocks * splits, "_qb", "_cs").sortWithinPartitions("_qb", "_cs", "_kind")
    arrow = to_arrow_schema(schema)

    def fn(batches):
        at, ids, own, cell = None, [], [], None
        for b in batches:
            places = np.stack([b.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                part, here = b.slice(low, high - low), tuple(places[:2, low].tolist())
                if here != at:
                    if cell:
                        yield from cell.rows(arrow)
                    at, ids, own, cell = here, [], [], None
                if places[2, low] == 0:
                    ids += part.column(3).to_pylist()
                    own.append(_matrix(part.column(5), dim, "query").copy())
                    continue
                if own:
                    block = _unit_rows(ids, np.concatenate(own), dim)
                    ids, own, cell = [], [], _Cell(block, k, max_d, min_d, dim) if block else None
                if cell:
                    cell.see(part.column(4), part.column(5))
        if cell:
            yield from cell.rows(arrow)

    return dealt.mapInArrow(fn, schema)
