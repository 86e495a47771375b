"""Semantic chunking.

Pipeline per document (one row, no shuffle):

1. pieces = the token splitter at ``piece_size`` (500) tokens — JVM (T4);
2. token count of every piece (special tokens included) — JVM (T3);
3. one vector per piece — the embedder's Arrow helper (E1);
4. the sequential part — batches of ``batch_size`` pieces with the last chunk
   of a batch carried into the next (C8), inside each batch rolling context
   similarity (C1), cumulative tokens (C2), score bounds (C3), threshold
   bisection (C4/C5), split indices (C6) and greedy assembly (C7) — in one
   NumPy helper per document, called through an Arrow function;
5. chunk texts = their pieces joined by newline — JVM.

The carried chunk is re-embedded as one text, as in the reference.  With the
(linear) hashing embedder that vector is the normalised sum of the pieces'
raw count vectors, so no second model call is needed; other embedders are
called again from inside the helper.

The same rules are also available as row-form DataFrame operators (window
functions and folds) for tables that already hold one row per piece:
:func:`context_similarity`, :func:`cumulative_tokens`, :func:`score_bounds`,
:func:`split_points`, :func:`segment_token_median`, :func:`assemble_at`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counter import TokenCounter, special_tokens
from ..functions.text import token_count
from .split import _once


# Scores, their median/sd and the bisection midpoints live on this decimal
# grid, so every implementation (NumPy helper, window operator, SQL) splits at
# the same places whatever its summation order.
SCORE_DECIMALS = 9


GRID = 10.0 ** SCORE_DECIMALS


def on_grid(x: float) -> float:
    """Nearest grid value, halves rounded up: floor(x * 1e9 + 0.5) / 1e9.  The
    midpoint of two grid values is often exactly halfway, so the tie rule is
    spelled out (plain IEEE steps, the same in every engine)."""
    return math.floor(x * GRID + 0.5) / GRID


@dataclass(frozen=True)
class SemanticOptions:
    # Fixed values of the reference's configuration.
    window: int = 5
    min_tokens: int = 100
    max_tokens: int = 512
    tolerance: int = 10
    adjustment: float = 0.01
    batch_size: int = 64
    piece_size: int = 500
    # "drop" reproduces the reference (a buffer under min_tokens is discarded
    # when the next piece overflows it); "keep" emits it instead.
    short_buffer: str = "keep"
    # Token counter of the user (functions.counter); None: the built-in one.
    counter: TokenCounter | None = None


# ---------------------------------------------------------------------------
# NumPy statement of the rules (used inside the Arrow helper and by tests)

def similarity_scores(vecs: np.ndarray, window: int = 5) -> np.ndarray:
    """cos(v_i, mean(v_{i-window} .. v_{i-1})) for i = 1..n-1."""
    n = len(vecs)
    if n < 2:
        return np.zeros(0)
    v = np.asarray(vecs, dtype=np.float64)
    cs = np.vstack([np.zeros((1, v.shape[1])), np.cumsum(v, axis=0)])
    i = np.arange(1, n)
    lo = np.maximum(0, i - window)
    ctx = (cs[i] - cs[lo]) / (i - lo)[:, None]
    num = np.einsum("ij,ij->i", v[1:], ctx)
    den = np.linalg.norm(v[1:], axis=1) * np.linalg.norm(ctx, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.round(np.where(den > 0, num / den, 0.0), SCORE_DECIMALS)


def _median_int(xs: np.ndarray) -> int:
    s = np.sort(xs)
    m = len(s) // 2
    return int(s[m]) if len(s) % 2 else int((s[m - 1] + s[m]) // 2)


def split_indices(scores: np.ndarray, threshold: float) -> np.ndarray:
    """Every i+1 with score[i] < threshold (strict)."""
    return np.nonzero(scores < threshold)[0] + 1


def optimal_threshold(token_counts: np.ndarray, scores: np.ndarray, o: SemanticOptions) -> tuple[float, int]:
    """Bisection on the threshold until the median segment size is in
    [min - tol, max + tol].  Returns (threshold, rounds)."""
    cum = np.concatenate([[0], np.cumsum(token_counts)])
    if len(scores) == 0:
        return 0.0, 0
    med = on_grid(float(np.median(scores)))
    sd = on_grid(float(np.std(scores, ddof=1))) if len(scores) > 1 else 0.0
    low, high = max(0.0, med - sd), min(1.0, med + sd)
    thr, rounds = 0.0, 0
    while low <= high:
        rounds += 1
        thr = on_grid((low + high) / 2.0)
        idx = split_indices(scores, thr)
        bounds = np.concatenate([[0], idx, [len(token_counts)]])
        seg = cum[bounds[1:]] - cum[bounds[:-1]]
        mt = _median_int(seg)
        if o.min_tokens - o.tolerance <= mt <= o.max_tokens + o.tolerance:
            break
        if mt < o.min_tokens:
            high = thr - o.adjustment
        else:
            low = thr + o.adjustment
    return thr, rounds


def assemble(token_counts, splits, o: SemanticOptions) -> list[list[int]]:
    """Greedy assembly of element positions under the token limits."""
    split_set = set(int(s) for s in splits)
    chunks, cur, c = [], [], 0
    for d, t in enumerate(int(x) for x in token_counts):
        if (d + 1) in split_set and o.min_tokens <= c + t <= o.max_tokens:
            cur.append(d)
            chunks.append(cur)
            cur, c = [], 0
            continue
        if c + t > o.max_tokens:
            if cur and (c >= o.min_tokens or o.short_buffer == "keep"):
                chunks.append(cur)
            cur, c = [], 0
        cur.append(d)
        c += t
    if cur:
        chunks.append(cur)
    return chunks


def segment_batch(token_counts: np.ndarray, vecs: np.ndarray, o: SemanticOptions) -> list[list[int]]:
    """C1-C7 on one batch of elements."""
    scores = similarity_scores(vecs, o.window)
    thr, _ = optimal_threshold(token_counts, scores, o)
    return assemble(token_counts, split_indices(scores, thr), o)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def segment_document(token_counts, vecs, o: SemanticOptions, raw: bool = True, reembed=None) -> list[list[int]]:
    """Batches of ``batch_size`` pieces; the last chunk of a batch is carried
    into the next one as a single element (re-embedded; its token count is the
    count of the joined text).  Returns chunks as lists of piece positions.

    ``raw=True``: ``vecs`` are un-normalised counts of a linear embedder, so a
    carried chunk's vector is their sum.  Otherwise ``reembed(piece_positions)``
    returns the carried chunk's vector.
    """
    tc = np.asarray(token_counts, dtype=np.int64)
    n = len(tc)
    if n == 0:
        return []
    V = np.asarray(vecs, dtype=np.float64)
    special = special_tokens(o.counter)
    out: list[list[int]] = []
    carry: list[int] = []
    for start in range(0, n, o.batch_size):
        members = [[i] for i in range(start, min(start + o.batch_size, n))]
        if carry:
            members = [carry] + members
        counts = np.array([int(tc[m].sum()) - special * (len(m) - 1) for m in members])
        if raw:
            ev = np.vstack([_unit(V[m].sum(axis=0)) for m in members])
        else:
            ev = np.vstack([_unit(V[m[0]]) if len(m) == 1 else _unit(np.asarray(reembed(m), dtype=np.float64))
                            for m in members])
        groups = segment_batch(counts, ev, o)
        chunks = [[p for g in grp for p in members[g]] for grp in groups]
        if len(chunks) > 1:
            out.extend(chunks[:-1])
            carry = chunks[-1]
        else:
            carry = chunks[0]
    if carry:
        out.append(carry)
    return out


# ---------------------------------------------------------------------------
# Spark wiring

def _segment_udf(o: SemanticOptions, dim: int, embed_fn=None):
    """Arrow function: (token counts, piece vectors[, piece texts]) -> chunk groups."""

    def run(tcs: pa.Array, vecs: pa.Array, texts: pa.Array | None) -> pa.Array:
        n_docs = len(tcs)
        tl = pc.fill_null(pc.list_value_length(tcs), 0).to_numpy(zero_copy_only=False)
        tflat = tcs.flatten().to_numpy(zero_copy_only=False)
        vflat = vecs.flatten()
        vl = pc.fill_null(pc.list_value_length(vflat), 0).to_numpy(zero_copy_only=False)
        vals = vflat.flatten().to_numpy(zero_copy_only=False)
        offs = np.concatenate([[0], np.cumsum(vl)])
        tstart = np.concatenate([[0], np.cumsum(tl)])
        results = []
        for d in range(n_docs):
            a, b = tstart[d], tstart[d + 1]
            tc = tflat[a:b]
            if (vl[a:b] == dim).all():
                mat = vals[offs[a]:offs[b]].reshape(b - a, dim)
            else:  # a piece without a vector counts as a zero vector
                mat = np.zeros((b - a, dim))
                for j, i in enumerate(range(a, b)):
                    if vl[i] == dim:
                        mat[j] = vals[offs[i]:offs[i + 1]]
            if embed_fn is None:
                groups = segment_document(tc, mat, o, raw=True)
            else:
                doc_texts = texts[d].values.to_pylist() if texts[d].is_valid else []

                def reembed(members, doc_texts=doc_texts):
                    joined = "\n".join(doc_texts[m] for m in members)
                    return np.asarray(embed_fn(pa.array([joined])), dtype=np.float64).reshape(-1)

                groups = segment_document(tc, mat, o, raw=False, reembed=reembed)
            results.append(groups)
        return pa.array(results, type=pa.list_(pa.list_(pa.int32())))

    if embed_fn is None:
        @F.arrow_udf("array<array<int>>")
        def semantic_groups(tcs: pa.Array, vecs: pa.Array) -> pa.Array:
            return run(tcs, vecs, None)
    else:
        @F.arrow_udf("array<array<int>>")
        def semantic_groups(tcs: pa.Array, vecs: pa.Array, texts: pa.Array) -> pa.Array:
            return run(tcs, vecs, texts)
    return semantic_groups


def _hashing_segment_udf(o: SemanticOptions, dim: int):
    """One Arrow function for the hashing embedder: per-piece tokens -> raw count
    vectors -> chunk groups, plus each chunk's vector.  By linearity a chunk's
    vector is its pieces' summed counts, normalised — the same vector the
    embedder gives the joined chunk text — so no second pass is needed."""
    from .embed import ROWS, _dense, _lengths

    kind = pa.struct([("groups", pa.list_(pa.list_(pa.int32()))), ("vectors", pa.list_(pa.list_(pa.float32())))])

    @F.arrow_udf("struct<groups:array<array<int>>,vectors:array<array<float>>>")
    def semantic_hashing(tcs: pa.Array, toks: pa.Array) -> pa.Array:
        # documents of about ROWS pieces at a time: the vectors of all pieces of an Arrow batch are never held at once
        cuts = np.flatnonzero(np.diff(np.cumsum(_lengths(tcs)) // ROWS, prepend=0)).tolist()
        ends = list(zip([0, *cuts], [*cuts, len(tcs)]))
        return pa.concat_arrays([some(tcs.slice(a, b - a), toks.slice(a, b - a)) for a, b in ends if a < b] or [pa.array([], kind)])

    def some(tcs: pa.Array, toks: pa.Array) -> pa.Array:
        n_docs = len(tcs)
        tl = _lengths(tcs)
        tflat = tcs.flatten().to_numpy(zero_copy_only=False)
        raw, _ = _dense(toks.flatten(), dim, normalize=False)
        raw = raw.astype(np.float64)
        tstart = np.concatenate([[0], np.cumsum(tl)])
        groups_all, sums, per_doc = [], [], []
        for d in range(n_docs):
            a, b = tstart[d], tstart[d + 1]
            # zero or one piece: nothing to segment
            groups = [] if b == a else ([[0]] if b - a == 1 else segment_document(tflat[a:b], raw[a:b], o, raw=True))
            groups_all.append(groups)
            per_doc.append(len(groups))
            sums.extend(raw[a:b][g].sum(axis=0) for g in groups)
        mat = np.vstack(sums) if sums else np.zeros((0, dim))
        norm = np.sqrt(np.einsum("ij,ij->i", mat, mat))
        ok = norm > 0
        mat[ok] /= norm[ok, None]
        vecs = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(mat) + 1) * dim, dim, dtype=np.int32)),
                                        pa.array(mat.astype(np.float32).reshape(-1)), mask=pa.array(~ok))
        offsets = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)
        groups_arr = pa.array(groups_all, type=pa.list_(pa.list_(pa.int32())))
        vec_lists = pa.ListArray.from_arrays(pa.array(offsets), vecs)
        return pa.StructArray.from_arrays([groups_arr, vec_lists], fields=list(kind))

    return semantic_hashing


def with_semantic_chunks(df: DataFrame, text_col: str, out_col: str, embedder, o: SemanticOptions | None = None,
                         groups_col: str | None = None, vectors_col: str | None = None) -> DataFrame:
    """Adds ``out_col``: array<string> of semantic chunks of ``text_col``
    (already cleaned/normalised).  ``groups_col`` also keeps the piece groups;
    ``vectors_col`` the chunk vectors (computed in the same pass for the
    hashing embedder, by the embedder otherwise)."""
    from .embed import embed_tokens
    from .split import with_token_chunks

    o = o or SemanticOptions()
    staged = with_token_chunks(df, text_col, "_pieces", size=o.piece_size, counter=o.counter)
    staged = staged.withColumn("_tc", F.transform("_pieces", lambda p: token_count(p)) if o.counter is None else F.transform(
        o.counter.counts(F.col("_pieces")), lambda n: n + F.lit(o.counter.special)))
    linear = getattr(embedder, "linear", False)
    if linear:
        udf = _hashing_segment_udf(o, embedder.dim)
        staged = staged.withColumn("_seg", udf(F.col("_tc"), F.transform("_pieces", embed_tokens)))
        staged = staged.withColumn("_groups", F.col("_seg.groups")).withColumn("_cv", F.col("_seg.vectors"))
    else:
        staged = staged.withColumn("_pv", embedder.embed_many(F.col("_pieces")))
        udf = _segment_udf(o, embedder.dim, embedder.fn)
        staged = staged.withColumn("_groups", udf(F.col("_tc"), F.col("_pv"), F.col("_pieces")))
    texts = F.transform("_groups", lambda g: F.array_join(F.transform(g, lambda i: F.get(F.col("_pieces"), i)), "\n"))
    out = staged.withColumn(out_col, texts)
    if vectors_col:
        out = out.withColumn(vectors_col, F.col("_cv") if linear else embedder.embed_many(F.col(out_col)))
    if groups_col:
        out = out.withColumnRenamed("_groups", groups_col)
    return out.drop("_pieces", "_tc", "_pv", "_groups", "_seg", "_cv")


# ---------------------------------------------------------------------------
# Row-form operators (one row per piece)
#
# ``group`` is a column name or a list of names.  The reference takes its
# statistics per batch of ``batch_size`` pieces; :func:`with_batches` adds that
# batch number so that (document, batch) groups hold at most ``batch_size``
# rows — every gathered group below is bounded by it.

def _keys(group) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def with_batches(df: DataFrame, group, order: str, batch_size: int = 64, out: str = "batch") -> DataFrame:
    """Batch number of each row inside its group (0-based position div batch_size).
    The row_number window streams over each group's sorted rows."""
    w = Window.partitionBy(*_keys(group)).orderBy(order)
    return df.withColumn(out, ((F.row_number().over(w) - 1) / batch_size).cast("int"))

def context_similarity(df: DataFrame, group: str, order: str, vec: str, window: int = 5,
                       out: str = "score") -> DataFrame:
    """C1 over rows: cosine of each vector with the mean of the up to ``window``
    preceding vectors of its group (NULL on the first row).  The window frame
    holds at most ``window`` vectors per row; rows are sorted per group.  Vectors
    are brought to unit length first, as in the chunker; the cosine is then
    scale-free, so the sum of the window stands in for its mean."""
    length = F.sqrt(F.aggregate(F.col(vec), F.lit(0.0).cast("double"), lambda a, b: a + b.cast("double") * b.cast("double")))
    given, vec = vec, "_unit"
    df = df.withColumn("_len", length).withColumn(vec, F.transform(given, lambda x: F.when(
        F.col("_len") > 0, x.cast("double") / F.nullif(F.col("_len"), F.lit(0.0))).otherwise(F.lit(0.0))))
    w = Window.partitionBy(*_keys(group)).orderBy(order).rowsBetween(-window, -1)
    ctx = F.collect_list(F.col(vec)).over(w)
    x = df.withColumn("_ctx", ctx)
    dim_sum = F.transform(F.col(vec), lambda _, i: F.aggregate(F.col("_ctx"), F.lit(0.0).cast("double"),
                                                                 lambda a, v: a + F.get(v, i).cast("double")))
    x = x.withColumn("_m", dim_sum)
    dotp = F.aggregate(F.zip_with(F.col(vec), F.col("_m"), lambda a, b: a.cast("double") * b),
                       F.lit(0.0).cast("double"), lambda a, b: a + b)
    n1 = F.sqrt(F.aggregate(F.col(vec), F.lit(0.0).cast("double"), lambda a, b: a + b.cast("double") * b.cast("double")))
    n2 = F.sqrt(F.aggregate(F.col("_m"), F.lit(0.0).cast("double"), lambda a, b: a + b * b))
    score = F.when(F.size("_ctx") > 0, F.round(F.coalesce(dotp / F.nullif(n1 * n2, F.lit(0.0)), F.lit(0.0)),
                                                 SCORE_DECIMALS))
    return x.withColumn(out, score).drop("_ctx", "_m", "_len", "_unit")


def cumulative_tokens(df: DataFrame, group: str, order: str, tokens: str, out: str = "cum_tokens") -> DataFrame:
    """Running token sum per group (including the current row)."""
    w = Window.partitionBy(*_keys(group)).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(tokens).over(w))


def score_bounds(scores: DataFrame, group: str, score: str = "score") -> DataFrame:
    """Per group median, sample sd (0 for one score) and the search bounds."""
    g = scores.where(F.col(score).isNotNull()).groupBy(*_keys(group)).agg(
        F.median(score).alias("median"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("sd"),
        F.count(score).alias("n_scores"))
    g = g.withColumn("sd", F.when(F.col("n_scores") > 1, F.col("sd")).otherwise(F.lit(0.0)))
    return g.select(*_keys(group), "median", "sd", F.greatest(F.lit(0.0), F.col("median") - F.col("sd")).alias("low"),
                    F.least(F.lit(1.0), F.col("median") + F.col("sd")).alias("high"))


def split_points(scored: DataFrame, threshold, score: str = "score", out: str = "split_before") -> DataFrame:
    """A boundary before a row whose score is below the threshold (strict).
    ``threshold`` is a number or a column."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return scored.withColumn(out, F.coalesce(F.col(score) < thr, F.lit(False)))


def segment_token_median(marked: DataFrame, group: str, order: str, tokens: str,
                         split_col: str = "split_before") -> DataFrame:
    """C4: token totals of the segments between boundaries, then their median
    (integer division of the middle pair for an even count)."""
    keys = _keys(group)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seg = marked.withColumn("_seg", F.sum(F.col(split_col).cast("int")).over(w))
    sizes = seg.groupBy(*keys, "_seg").agg(F.sum(tokens).alias("_n"))
    g = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list("_n")).alias("_s"))
    n = F.size("_s")
    mid = F.get(F.col("_s"), F.floor(n / 2).cast("int"))
    lo = F.get(F.col("_s"), (F.floor(n / 2) - 1).cast("int"))
    med = F.when(n % 2 == 1, mid).otherwise(F.floor((lo + mid) / 2))
    return g.select(*keys, n.cast("int").alias("n_segments"), med.cast("long").alias("median_tokens"))


def _rounds(o: SemanticOptions) -> int:
    """Rounds after which the bisection's interval, at most 1 wide, is empty (with some to spare for the grid)."""
    if o.adjustment <= 0:
        raise ValueError("adjustment must be positive")
    n, width = 0, 1.0
    while width >= 0:
        n, width = n + 1, width / 2 - o.adjustment
    return n + 2


def _grid(x: Column) -> Column:
    """:func:`on_grid` of a column."""
    return F.floor(x * F.lit(GRID) + F.lit(0.5)).cast("double") / F.lit(GRID)


def _middle(sorted_values: Column, pair) -> Column:
    """Median of a sorted array; ``pair`` joins the middle two."""
    n = F.size(sorted_values)
    at = lambda k: F.get(sorted_values, k.cast("int"))
    return F.when(n % 2 == 1, at(F.floor(n / 2))).otherwise(pair(at(F.floor(n / 2) - 1), at(F.floor(n / 2))))


def _segment_median(pieces: Column, threshold: Column) -> Column:
    """C4 for array<struct<t,s>> in order: median token total of the segments that begin at scores below the threshold."""
    zero = F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).cast("long").alias("c"), F.lit(True).alias("first"))
    folded = F.aggregate(pieces, zero, lambda st, p: F.when(
        ~st["first"] & F.coalesce(p["s"] < threshold, F.lit(False)),
        F.struct(F.concat(st["out"], F.array(st["c"])).alias("out"), p["t"].alias("c"), F.lit(False).alias("first")))
        .otherwise(F.struct(st["out"].alias("out"), (st["c"] + p["t"]).alias("c"), F.lit(False).alias("first"))),
        lambda st: F.array_sort(F.concat(st["out"], F.array(st["c"]))))
    return _once(folded, lambda m: _middle(m, lambda x, y: F.floor((x + y) / 2).cast("long")))


def bisected(pieces: Column, o: SemanticOptions) -> Column:
    """C3 - C5 as one fold over an array<struct<t:bigint,s:double>> of a batch's pieces in order (the first has no
    score): struct<threshold:double,rounds:int>.  The state is the interval; every round counts its segments in a fold of its own."""
    scores = F.array_sort(F.filter(F.transform(pieces, lambda p: p["s"]), lambda s: s.isNotNull()))

    def bounds(ss):
        n = F.size(ss).cast("double")
        mean = F.aggregate(ss, F.lit(0.0).cast("double"), lambda a, x: a + x) / n
        squares = F.aggregate(F.transform(ss, lambda x: (x - mean) * (x - mean)), F.lit(0.0).cast("double"), lambda a, x: a + x)
        sd = F.when(n > 1, _grid(F.sqrt(squares / F.nullif(n - 1, F.lit(0.0))))).otherwise(F.lit(0.0))
        med = _grid(_middle(ss, lambda x, y: (x + y) / 2))
        return _once(F.struct(med.alias("m"), sd.alias("d")), lambda v: F.struct(
            F.greatest(F.lit(0.0), v["m"] - v["d"]).alias("lo"), F.least(F.lit(1.0), v["m"] + v["d"]).alias("hi"),
            F.lit(0.0).cast("double").alias("thr"), F.lit(False).alias("done"), F.lit(0).alias("r")))

    def state(lo, hi, thr, done, r):
        return F.struct(lo.alias("lo"), hi.alias("hi"), thr.alias("thr"), done.alias("done"), r.alias("r"))

    def judged(st, thr):
        def after(mt):
            good = (mt >= o.min_tokens - o.tolerance) & (mt <= o.max_tokens + o.tolerance)
            small = ~good & (mt < o.min_tokens)
            return state(F.when(good | small, st["lo"]).otherwise(thr + F.lit(o.adjustment)),
                         F.when(small, thr - F.lit(o.adjustment)).otherwise(st["hi"]), thr, good, st["r"] + 1)

        return _once(_segment_median(pieces, thr), after)

    def step(st, _):
        return F.when(st["done"] | (st["lo"] > st["hi"]), st).otherwise(_once(_grid((st["lo"] + st["hi"]) / 2), lambda thr: judged(st, thr)))

    def search(ss):
        return F.aggregate(F.sequence(F.lit(1), F.lit(_rounds(o))), bounds(ss), step, lambda st: F.struct(st["thr"].alias("threshold"), st["r"].alias("rounds")))

    none = F.struct(F.lit(0.0).cast("double").alias("threshold"), F.lit(0).alias("rounds"))
    return _once(scores, lambda ss: F.when(F.size(ss) > 0, search(ss)).otherwise(none))


def thresholds(scored: DataFrame, group: str, order: str, tokens: str, score: str = "score",
               o: SemanticOptions | None = None) -> DataFrame:
    """C5 per group: the bisection threshold and its round count, from the
    group's ordered scores and token counts (one batch).  The group's small
    arrays are gathered once; the bisection is the fold :func:`bisected`, JVM-side."""
    o = o or SemanticOptions()
    keys = _keys(group)
    g = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col(order).alias("o"), F.col(tokens).cast("long").alias("t"), F.col(score).cast("double").alias("s")))).alias("_p"))
    # the first piece's score, if any, is that of another batch
    pieces = F.transform("_p", lambda p, k: F.struct(p["t"].alias("t"), F.when(k > 0, p["s"]).alias("s")))
    b = g.withColumn("_q", pieces).select(*keys, bisected(F.col("_q"), o).alias("_b"))
    return b.select(*keys, F.col("_b.threshold").alias("threshold"), F.col("_b.rounds").alias("rounds"))


def assemble_at(marked: DataFrame, group: str, order: str, tokens: str, split_col: str = "split_before",
                o: SemanticOptions | None = None) -> DataFrame:
    """C7 over rows with given boundaries: one row per chunk (``group``,
    ``chunk_no``, ``first``, ``last`` order values), by a fold per group."""
    o = o or SemanticOptions()
    keys = _keys(group)
    w = Window.partitionBy(*keys).orderBy(order)
    x = marked.withColumn("_split_after", F.coalesce(F.lead(split_col).over(w), F.lit(False)))
    g = x.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col(order).alias("o"), F.col(tokens).cast("int").alias("t"), F.col("_split_after").alias("s")))).alias("_p"))
    zero = F.struct(F.array().cast("array<array<long>>").alias("out"), F.array().cast("array<long>").alias("cur"),
                    F.lit(0).alias("c"))
    keep_short = o.short_buffer == "keep"

    def step(st, p):
        ct = st["c"] + p["t"]
        cut = p["s"] & (ct >= o.min_tokens) & (ct <= o.max_tokens)
        over = ct > o.max_tokens
        emit_old = (F.size(st["cur"]) > 0) & ((st["c"] >= o.min_tokens) | F.lit(keep_short))
        o_long = p["o"].cast("long")
        return (F.when(cut, F.struct(F.concat(st["out"], F.array(F.concat(st["cur"], F.array(o_long)))).alias("out"),
                                     F.array().cast("array<long>").alias("cur"), F.lit(0).alias("c")))
                .when(over, F.struct(F.when(emit_old, F.concat(st["out"], F.array(st["cur"]))).otherwise(st["out"]).alias("out"),
                                     F.array(o_long).alias("cur"), p["t"].alias("c")))
                .otherwise(F.struct(st["out"].alias("out"), F.concat(st["cur"], F.array(o_long)).alias("cur"),
                                    ct.alias("c"))))

    def finish(st):
        return F.when(F.size(st["cur"]) > 0, F.concat(st["out"], F.array(st["cur"]))).otherwise(st["out"])

    chunks = g.select(*keys, F.aggregate("_p", zero, step, finish).alias("_chunks"))
    e = chunks.select(*keys, F.posexplode_outer("_chunks").alias("chunk_no", "_m")).where(F.col("_m").isNotNull())
    return e.select(*keys, F.col("chunk_no").cast("int").alias("chunk_no"),
                    F.element_at("_m", 1).alias("first"), F.element_at("_m", -1).alias("last"),
                    F.size("_m").cast("int").alias("n_pieces"))
