"""Pluggable token counters.

A counter is a function from an Arrow string array to the number of tokens of each text, without
the ``special`` tokens that a chunk gets besides.  It is called within Arrow batches, on every
distinct text of a batch once and on at most ``batch_size`` texts a call; load a model lazily, so that each
worker loads it once.  ``None`` stands for the built-in counter, which needs no Python.

The splitter works in two phases: :meth:`TokenCounter.units` cuts and counts, the packing fold then
sees the counts only.  A chunk's size is the sum of its units' counts.
"""

from __future__ import annotations

import re
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPECIAL_TOKENS, WIDE_END

BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


class TokenCounter:
    def __init__(self, fn: Callable[[pa.Array], "np.ndarray | list[int]"], special: int = SPECIAL_TOKENS, batch_size: int = 1024):
        self.fn, self.special, self.batch_size = fn, special, batch_size

    def counted(self, texts: pa.Array) -> np.ndarray:
        """Counts of an Arrow array without nulls; every distinct text is counted once."""
        if len(texts) == 0:
            return np.zeros(0, np.int64)
        coded = pc.dictionary_encode(texts)
        distinct = coded.dictionary
        n = np.concatenate([np.asarray(self.fn(distinct.slice(i, self.batch_size)), np.int64) for i in range(0, len(distinct), self.batch_size)])
        return n[coded.indices.to_numpy(zero_copy_only=False)]

    def count(self, text: Column) -> Column:
        """Tokens of a text without the special ones (null: null)."""
        @F.arrow_udf("int")
        def count_texts(texts: pa.Array) -> pa.Array:
            null = texts.is_null().to_numpy(zero_copy_only=False)
            out = np.zeros(len(texts), np.int32)
            out[~null] = self.counted(texts.drop_null())
            return pa.array(out, pa.int32(), mask=null)

        return count_texts(text)

    def counts(self, texts: Column) -> Column:
        """array<string> -> array<int>."""
        @F.arrow_udf("array<int>")
        def count_lists(lists: pa.Array) -> pa.Array:
            n = pa.array(self.counted(lists.flatten()).astype(np.int32))
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), n, mask=lists.is_null())

        return count_lists(texts)

    def halved(self, word: str, n: int, cap: int) -> list[tuple[str, int]]:
        """A word of ``n`` tokens in parts of at most ``cap``, with their counts."""
        if n <= cap or len(word) < 2:
            return [(word, n)]
        parts = [word[:len(word) // 2], word[len(word) // 2:]]
        return [x for p, k in zip(parts, self.counted(pa.array(parts)).tolist()) for x in self.halved(p, k, cap)]

    def units(self, sentences: Column, cap: int) -> Column:
        """array<string> of sentences -> array<struct<t,s,n>> of units of at most ``cap`` tokens: a sentence over it is cut at its
        blanks, a word over it is halved (by code points) until its parts fit or are single characters."""
        counted, halved = self.counted, self.halved

        @F.arrow_udf("array<struct<t:string,s:string,n:int>>")
        def cut(lists: pa.Array) -> pa.Array:
            flat = lists.flatten()
            n = counted(flat)
            texts = flat.to_pylist()
            words = {k: [w for w in BLANKS.split(texts[k]) if w] for k in np.flatnonzero(n > cap).tolist()}
            word_n = iter(counted(pa.array([w for ws in words.values() for w in ws], pa.string())).tolist())
            out, at = [], 0
            for size in pc.fill_null(pc.list_value_length(lists), 0).to_pylist():
                units = []
                for k in range(at, at + size):
                    sep = "" if k > at and texts[k - 1][-1:] in WIDE_END else " "
                    if k not in words:
                        units.append((texts[k], sep, n[k]))
                        continue
                    for j, w in enumerate(words[k]):
                        for i, (part, m) in enumerate(halved(w, next(word_n), cap)):
                            units.append((part, "" if i else " " if j else sep, m))
                at += size
                out.append([{"t": t, "s": s, "n": int(m)} for t, s, m in units])
            return pa.array(out, pa.list_(pa.struct([("t", pa.string()), ("s", pa.string()), ("n", pa.int32())])))

        return cut(sentences)


def special_tokens(counter: TokenCounter | None) -> int:
    return SPECIAL_TOKENS if counter is None else counter.special
