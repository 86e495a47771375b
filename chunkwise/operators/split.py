"""Token-bounded splitting (T4/T5) and the sentence packer.

All of it runs inside one row per document with higher-order functions: no
shuffle, and the document's pieces come out with ``posexplode``.

Boundary order of the token splitter (our own, documented): a chunk never
exceeds ``size`` tokens (special tokens included) unless a single token does.
Units are sentences, cut at every newline, after ``. ! ? ;`` followed by
blanks, and after a run of the full-width ``。 ！ ？ ；``; a sentence over budget
is cut into words (blank-separated); a word over budget is cut into windows of
tokens.  Units are packed greedily, in order.  Inside a chunk, sentences and
words are joined by one space, but a sentence after a full-width end and the
token windows of one word are joined with nothing, so every non-blank
character is kept.  No character of a text has a special meaning to the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counter import special_tokens
from ..functions.text import SENTENCE_END, TOKEN_PATTERN, WIDE_END, _c


def _ntok(x: Column) -> Column:
    return F.regexp_count(x, F.lit(TOKEN_PATTERN))


_CUT = rf"\s*\n\s*|(?<=[{SENTENCE_END}])\s+|(?<=[{WIDE_END}])(?![{WIDE_END}])\s*"


def sentences(col) -> Column:
    """array<string>: sentences of a text, blanks trimmed, empties dropped.

    The cuts swallow the blanks on both sides, so only the text's own ends can
    carry blanks: one trim of the whole text trims every sentence."""
    trimmed = F.regexp_replace(_c(col), r"^\s+|\s+$", "")
    return F.filter(F.split(trimmed, _CUT, -1), lambda s: s != F.lit(""))


def _once(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once however often ``fn`` uses it:
    an expression that a nested lambda names is evaluated per element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def split_units(col, cap: int) -> Column:
    """array<struct<t,s,n>>: atomic units of at most ``cap`` tokens.

    ``t`` is the text, ``s`` the separator placed before it inside a chunk and
    ``n`` its token count (without special tokens).
    """
    def unit(t, sep, n):
        return F.struct(t.alias("t"), sep.alias("s"), n.cast("int").alias("n"))

    def windows(toks, sep):
        nw = F.size(toks)
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(nw / F.lit(cap)).cast("int") - 1, F.lit(0))),
            lambda j: unit(F.array_join(F.slice(toks, j * cap + 1, F.lit(cap)), ""),
                           F.when(j == 0, sep).otherwise(F.lit("")), F.least(nw - j * cap, F.lit(cap))))

    def word_units(w, sep):
        return F.when(_ntok(w) <= cap, F.array(unit(w, sep, _ntok(w)))).otherwise(
            _once(F.regexp_extract_all(w, F.lit(TOKEN_PATTERN), F.lit(0)), lambda toks: windows(toks, sep)))

    def sentence_units(s, sep):
        words = F.filter(F.split(s, r"\s+"), lambda w: w != F.lit(""))
        return F.when(_ntok(s) <= cap, F.array(unit(s, sep, _ntok(s)))).otherwise(
            F.flatten(F.transform(words, lambda w, k: word_units(w, F.when(k == 0, sep).otherwise(F.lit(" "))))))

    def all_units(ss):
        # a sentence after a full-width end has no blank before it
        before = F.concat(F.array(F.lit("")), F.slice(ss, 1, F.greatest(F.size(ss) - 1, F.lit(0))))
        return F.flatten(F.zip_with(ss, before, lambda s, p: sentence_units(
            s, F.when(p.rlike(f"[{WIDE_END}]$"), F.lit("")).otherwise(F.lit(" ")))))

    return F.coalesce(_once(sentences(col), all_units), F.array().cast("array<struct<t:string,s:string,n:int>>"))


#: Spans of one inner list; a fold that appends copies at most this many.
_RUN = 256


def pack_spans(units: Column, cap: int, overlap: int = 0) -> Column:
    """Greedy packing fold: array<struct<a:int,b:int>> of 1-based inclusive unit spans.

    A new chunk starts when the running count would exceed ``cap``.  With
    ``overlap`` > 0 the new chunk re-uses the trailing units of the previous
    one whose tokens sum to at most ``overlap`` (and, with the new unit, fit).
    The accumulator carries the counts of the open chunk only (``w``, at most
    ``cap`` of them), and finished spans in lists of ``_RUN``.
    """
    ns = F.transform(units, lambda u: u["n"])
    spans, ints = "array<struct<a:int,b:int>>", "array<int>"
    zero = F.struct(F.array().cast(f"array<{spans}>").alias("out"), F.array().cast(spans).alias("run"),
                    F.lit(1).alias("a"), F.lit(0).alias("c"), F.lit(0).alias("i"),
                    *([F.array().cast(ints).alias("w")] if overlap > 0 else []))

    def tail(w, x):
        """(k, s): the trailing units that fit the overlap, and their tokens."""
        return F.aggregate(
            F.reverse(F.slice(w, 2, F.size(w))), F.struct(F.lit(0).alias("k"), F.lit(0).alias("s"), F.lit(True).alias("on")),
            lambda st, n: F.when(st["on"] & (st["s"] + n <= overlap) & (st["s"] + n + x <= cap), F.struct(
                (st["k"] + 1).alias("k"), (st["s"] + n).alias("s"), F.lit(True).alias("on")))
            .otherwise(F.struct(st["k"].alias("k"), st["s"].alias("s"), F.lit(False).alias("on"))))

    def step(st, x):
        i = st["i"] + 1
        full = (st["c"] > 0) & (st["c"] + x > cap)
        span = F.array(F.struct(st["a"].alias("a"), (i - 1).alias("b")))
        out = F.when(F.size(st["run"]) >= _RUN, F.concat(st["out"], F.array(st["run"]))).otherwise(st["out"])
        run = F.when(F.size(st["run"]) >= _RUN, span).otherwise(F.concat(st["run"], span))

        def opened(k, s, w):
            return F.struct(out.alias("out"), run.alias("run"), (i - k).alias("a"), (s + x).alias("c"), i.alias("i"), *[v.alias("w") for v in w])

        if overlap > 0:
            new = _once(tail(st["w"], x), lambda t: opened(t["k"], t["s"], [F.concat(
                F.slice(st["w"], F.size(st["w"]) - t["k"] + 1, t["k"]), F.array(x))]))
            w = [F.concat(st["w"], F.array(x)).alias("w")]
        else:
            new, w = opened(F.lit(0), F.lit(0), []), []
        return F.when(full, new).otherwise(F.struct(
            st["out"].alias("out"), st["run"].alias("run"), st["a"].alias("a"), (st["c"] + x).alias("c"), i.alias("i"), *w))

    def finish(st):
        last = F.when(st["i"] >= st["a"], F.array(F.struct(st["a"].alias("a"), st["i"].alias("b")))).otherwise(F.array().cast(spans))
        return F.concat(F.flatten(st["out"]), st["run"], last)

    return F.aggregate(ns, zero, step, finish)


def span_text(units: Column, span: Column) -> Column:
    """Chunk text of a unit span: the first unit's own text, then every later
    unit with its separator."""
    first = F.element_at(units, span["a"])["t"]
    rest = F.slice(units, span["a"] + 1, span["b"] - span["a"])
    return F.concat(first, F.array_join(F.transform(rest, lambda u: F.concat(u["s"], u["t"])), ""))


def _cap(size: int, overlap: int, counter=None) -> int:
    cap = size - special_tokens(counter)
    if cap <= 0:
        raise ValueError("size must exceed the special-token count")
    if overlap >= cap:
        raise ValueError("overlap must be smaller than the chunk budget")
    return cap


def chunks_from_units(units: Column, cap: int, overlap: int = 0) -> Column:
    """array<string> of chunk texts; ``units`` should be a column reference so the
    unit split is computed once (stage it with a select)."""
    return F.transform(pack_spans(units, cap, overlap), lambda sp: span_text(units, sp))


def token_chunks(col, size: int = 256, overlap: int = 0) -> Column:
    """T4/T5 as one expression (evaluates the unit split twice; prefer
    :func:`with_token_chunks` on DataFrames)."""
    cap = _cap(size, overlap)
    return chunks_from_units(split_units(col, cap), cap, overlap)


def with_token_chunks(df: DataFrame, text_col: str, out_col: str, size: int = 256, overlap: int = 0, counter=None) -> DataFrame:
    """Adds ``out_col`` = array<string> of chunks; the unit split is staged in its own
    projection so it is evaluated once per document.  A ``counter`` of the user cuts and counts the
    units in Arrow batches; they are packed the same way."""
    cap = _cap(size, overlap, counter)
    units = split_units(F.col(text_col), cap) if counter is None else counter.units(
        F.coalesce(sentences(text_col), F.array().cast("array<string>")), cap)
    staged = df.withColumn("_units", units)
    return staged.withColumn(out_col, chunks_from_units(F.col("_units"), cap, overlap)).drop("_units")


def explode_positions(df: DataFrame, keep: list[str], array_col: str, pos_col: str, out_col: str) -> DataFrame:
    """``posexplode`` that keeps the array expression out of inferred filters.

    A plain generator makes Catalyst infer ``size(array) > 0`` and push that
    copy of the (expensive) array expression down to the scan; the outer form
    is not rewritten, and the NULL row of an empty array is dropped here.
    """
    return (df.select(*keep, F.posexplode_outer(array_col).alias(pos_col, out_col))
            .where(F.col(out_col).isNotNull()))


def split_tokens(df: DataFrame, text_col: str = "text", size: int = 256, overlap: int = 0,
                 pos_col: str = "pos", out_col: str = "text", keep: list[str] | None = None, counter=None) -> DataFrame:
    """T5: one row per chunk: ``keep`` columns, ``pos`` (0-based) and the chunk text."""
    keep = [c for c in (keep if keep is not None else df.columns) if c not in (text_col, pos_col, out_col)]
    staged = with_token_chunks(df.select(*keep, F.col(text_col).alias("_src")), "_src", "_chunks", size, overlap, counter)
    return explode_positions(staged, keep, "_chunks", pos_col, out_col)


def pack_sentences(col, n_words: int) -> Column:
    """Reference sentence packer as one expression (array<string>).

    Split on ``.`` and ``;`` (a final terminator leaves no empty sentence),
    append ``.`` to each sentence, collect blank-separated words and emit the
    buffer (joined by one space) once it holds at least ``n_words`` words; the
    remainder is the last chunk.  A text with fewer bytes than ``n_words`` is
    returned whole; an empty text gives no chunk.
    """
    text = _c(col)
    sents = F.split(F.regexp_replace(text, r"[.;]\z", ""), "[.;]", -1)
    none = F.array().cast("array<string>")
    # finished chunks in lists of ``_RUN``, so an append copies at most one of them
    zero = F.struct(F.array().cast("array<array<string>>").alias("out"), none.alias("run"), none.alias("cur"))

    def emitted(st, cur):
        full, chunk = F.size(st["run"]) >= _RUN, F.array(F.array_join(cur, " "))
        return F.struct(F.when(full, F.concat(st["out"], F.array(st["run"]))).otherwise(st["out"]).alias("out"),
                        F.when(full, chunk).otherwise(F.concat(st["run"], chunk)).alias("run"), none.alias("cur"))

    def step(st, s):
        words = F.filter(F.split(F.concat(s, F.lit(".")), r"\s+"), lambda w: w != F.lit(""))
        return _once(F.concat(st["cur"], words), lambda cur: F.when(F.size(cur) >= n_words, emitted(st, cur))
                     .otherwise(F.struct(st["out"].alias("out"), st["run"].alias("run"), cur.alias("cur"))))

    def finish(st):
        last = F.when(F.size(st["cur"]) > 0, F.array(F.array_join(st["cur"], " "))).otherwise(none)
        return F.concat(F.flatten(st["out"]), st["run"], last)

    packed = F.aggregate(sents, zero, step, finish)
    return (F.when(text.isNull() | (text == F.lit("")), F.array().cast("array<string>"))
            .when(F.octet_length(text) < n_words, F.array(text))
            .otherwise(packed))


def split_sentences(df: DataFrame, text_col: str = "text", n_words: int = 50,
                    pos_col: str = "pos", out_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """T6 as rows."""
    keep = [c for c in (keep if keep is not None else df.columns) if c not in (text_col, pos_col, out_col)]
    staged = df.select(*keep, pack_sentences(F.col(text_col), n_words).alias("_chunks"))
    return explode_positions(staged, keep, "_chunks", pos_col, out_col)
