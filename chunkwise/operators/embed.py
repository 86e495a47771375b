"""Embedding.

The default embedder is a *hashing embedder*: a linear bag of tokens.  For
each token of the lower-cased text, bucket = first 8 hex digits of md5 mod
``dim`` and sign = +1 when the 9th hex digit is even, -1 when odd; the signed
counts are L2-normalised.  Tokenising runs JVM-side (``regexp_extract_all``); the Arrow-batched helper
dictionary-encodes the batch's tokens, hashes each distinct token once and
scatters the signed counts into dense vectors with one ``numpy.bincount``
over the whole batch.  A text without tokens gets a NULL vector.

Any other model plugs in through :class:`ArrowEmbedder` (a function from an
Arrow string array to a 2-D float array), loaded once per Python worker.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERN, _c
from ..schemas import DEFAULT_DIM


@dataclass(frozen=True)
class EmbedOptions:
    """E5 defaults: chunk size 256, overlap 0 (see README on the reference's cast),
    batch 32, Semantic strategy."""
    chunk_size: int = 256
    overlap: int = 0
    batch_size: int = 32
    strategy: str = "semantic"

    def embedder(self, embedder):
        """The given embedder with this batch size (the hashing embedder calls no model)."""
        return embedder.batched(self.batch_size) if isinstance(embedder, ArrowEmbedder) else embedder


def hash_token(tok: str, dim: int) -> int:
    """code = bucket * 2 + sign_bit of one token (md5 of its UTF-8 bytes)."""
    d = hashlib.md5(tok.encode("utf-8")).digest()
    return (int.from_bytes(d[:4], "big") % dim) * 2 + ((d[4] >> 4) & 1)


#: Codes of tokens that this worker has met, by dimension and token; emptied when full.
_SEEN: dict[int, dict[str, int]] = {}
_SEEN_MOST = 1 << 16


def _codes(flat_tokens: pa.Array, dim: int) -> np.ndarray:
    """Codes of a flat token array; md5 runs once per distinct token that is not in :data:`_SEEN`."""
    if len(flat_tokens) == 0:
        return np.zeros(0, dtype=np.int64)
    enc = pc.dictionary_encode(flat_tokens)
    uniq = enc.dictionary.to_pylist()
    seen = _SEEN.setdefault(dim, {})
    if len(seen) > _SEEN_MOST:
        seen.clear()
    for t in uniq:
        if t not in seen:
            seen[t] = hash_token(t, dim)
    ucodes = np.fromiter((seen[t] for t in uniq), dtype=np.int64, count=len(uniq))
    return ucodes[enc.indices.to_numpy(zero_copy_only=False)]


def _dense_from_codes(values: np.ndarray, lengths: np.ndarray, dim: int,
                      normalize: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Scatter signed bucket codes of n rows into an (n, dim) float32 matrix
    (unit norm unless ``normalize=False``, which keeps the signed counts)."""
    n = len(lengths)
    rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
    bucket = values >> 1
    sign = 1.0 - 2.0 * (values & 1)
    mat = np.bincount(rows * dim + bucket, weights=sign, minlength=n * dim).reshape(n, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", mat, mat))
    ok = norm > 0
    if normalize:
        mat[ok] /= norm[ok, None]
    return mat.astype(np.float32), ok


#: Rows whose token codes are held at once; an Arrow batch may have ten thousand.
ROWS = 512


def _dense(toks: pa.Array, dim: int, normalize: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_dense_from_codes` of a column of token lists, some rows at a time."""
    mat, ok = np.empty((len(toks), dim), np.float32), np.empty(len(toks), bool)
    for a in range(0, len(toks), ROWS):
        some = toks.slice(a, ROWS)
        mat[a:a + ROWS], ok[a:a + ROWS] = _dense_from_codes(_codes(some.flatten(), dim), _lengths(some), dim, normalize)
    return mat, ok


def _list_of_vectors(mat: np.ndarray, ok: np.ndarray) -> pa.Array:
    n, dim = mat.shape
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(mat.reshape(-1)), type=pa.list_(pa.float32()),
                                    mask=pa.array(~ok))


def _lengths(arr: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _scatter_udf(dim: int):
    @F.arrow_udf("array<float>")
    def hashed_vectors(toks: pa.Array) -> pa.Array:
        mat, ok = _dense(toks, dim)
        return _list_of_vectors(mat, ok)

    return hashed_vectors


def _scatter_nested_udf(dim: int, normalize: bool = True):
    @F.arrow_udf("array<array<float>>")
    def hashed_vectors_nested(toks: pa.Array) -> pa.Array:
        outer_len = _lengths(toks)
        inner = toks.flatten()
        mat, ok = _dense(inner, dim, normalize)
        offsets = np.zeros(len(outer_len) + 1, dtype=np.int32)
        np.cumsum(outer_len, out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), _list_of_vectors(mat, ok), mask=toks.is_null())

    return hashed_vectors_nested


def embed_tokens(text: Column) -> Column:
    """Tokens fed to the hashing embedder: the T3 tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


class HashingEmbedder:
    """Deterministic, SQL-expressible default embedder (E2 replacement; see README)."""

    linear = True

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim = dim
        self._udf = _scatter_udf(dim)
        self._udf_nested = _scatter_nested_udf(dim)
        self._udf_nested_raw = _scatter_nested_udf(dim, normalize=False)

    def embed(self, text) -> Column:
        """array<float> (unit norm, NULL when the text has no token)."""
        return self._udf(embed_tokens(_c(text)))

    def embed_many(self, texts) -> Column:
        """array<string> -> array<array<float>> (one vector per element)."""
        return self._udf_nested(F.transform(_c(texts), embed_tokens))

    def embed_many_raw(self, texts) -> Column:
        """Like :meth:`embed_many` but the signed counts, not normalised: the
        vector of a concatenation is the sum of the parts' counts (linearity)."""
        return self._udf_nested_raw(F.transform(_c(texts), embed_tokens))


class ArrowEmbedder:
    """Pluggable model: ``fn(pa.StringArray) -> np.ndarray (n, dim)``.

    ``fn`` is called on at most ``batch_size`` texts at a time (32 for chunk
    texts, 16 for the chunker's pieces, the reference's sizes).

    ``fn`` runs once per Arrow batch inside the Python worker; load the model
    lazily (e.g. a module-level cache) so each worker loads it once.  Rows whose
    vector has zero norm or whose text is NULL get a NULL vector.
    """

    linear = False

    def __init__(self, fn: Callable[[pa.Array], np.ndarray], dim: int, batch_size: int = 32,
                 piece_batch_size: int = 16):
        self.dim = dim
        self.batch_size, self.piece_batch_size = batch_size, piece_batch_size

        def batched(size):
            def call(texts: pa.Array) -> np.ndarray:
                # The model sees at most ``size`` texts per call
                if len(texts) == 0:
                    return np.zeros((0, dim), dtype=np.float32)
                return np.vstack([np.asarray(fn(texts.slice(i, size)), dtype=np.float32).reshape(-1, dim)
                                  for i in range(0, len(texts), size)])
            return call

        self._model = fn
        texts_fn, pieces_fn = batched(batch_size), batched(piece_batch_size)
        self.fn = pieces_fn

        @F.arrow_udf("array<float>")
        def run(texts: pa.Array) -> pa.Array:
            mat = texts_fn(texts).reshape(len(texts), dim)
            ok = np.isfinite(mat).all(axis=1) & (np.abs(mat).sum(axis=1) > 0)
            if texts.null_count:
                ok &= ~texts.is_null().to_numpy(zero_copy_only=False)
            return _list_of_vectors(np.where(ok[:, None], mat, 0).astype(np.float32), ok)

        @F.arrow_udf("array<array<float>>")
        def run_many(lists: pa.Array) -> pa.Array:
            outer_len = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = lists.flatten()
            mat = pieces_fn(texts).reshape(len(texts), dim)
            ok = np.isfinite(mat).all(axis=1) & (np.abs(mat).sum(axis=1) > 0)
            vecs = _list_of_vectors(np.where(ok[:, None], mat, 0).astype(np.float32), ok)
            offsets = np.zeros(len(outer_len) + 1, dtype=np.int32)
            np.cumsum(outer_len, out=offsets[1:])
            return pa.ListArray.from_arrays(pa.array(offsets), vecs, mask=lists.is_null())

        self._run, self._run_many = run, run_many

    def batched(self, batch_size: int) -> ArrowEmbedder:
        """The same model, called on at most ``batch_size`` chunk texts at a time."""
        return ArrowEmbedder(self._model, self.dim, batch_size, self.piece_batch_size)

    def embed(self, text) -> Column:
        return self._run(_c(text))

    def embed_many(self, texts) -> Column:
        return self._run_many(_c(texts))


def first_vector(col) -> Column:
    """First vector of a multi-vector result; empty or NULL -> NULL."""
    return F.get(_c(col), 0)


def check_dim(col, dim: int) -> Column:
    """S11 check: the vector exists and has ``dim`` elements."""
    c = _c(col)
    return c.isNotNull() & (F.size(c) == F.lit(dim))
