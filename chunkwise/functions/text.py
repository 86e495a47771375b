"""Scalar text functions (Column -> Column), all JVM-side built-ins.

T1 clean, T2 newline folding, T3 token counting, T7 joins, T8 epoch stamps.
Every function here has an equivalent DuckDB expression in ``__spark_entry__``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay as written: they define the token counter and the
# cleaning rules the results are compared against).
# Token = one CJK ideograph, or one run of letters/digits, or one other
# non-space character.  Two special tokens are added per text.
TOKEN_PATTERN = r"[一-鿿]|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SPECIAL_TOKENS = 2
# Sentence terminators used by the token splitter: the first kind ends a
# sentence when blanks follow, the second (full-width) always.
SENTENCE_END = ".!?;"
WIDE_END = "。！？；"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col) -> Column:
    """Strip leading and trailing blanks of every line and drop empty lines."""
    t = F.regexp_replace(_c(col), r"(?m)^[ \t]+|[ \t]+$", "")  # both line edges in one pass
    t = F.regexp_replace(t, r"\n{2,}", "\n")
    return F.regexp_replace(t, r"\A\n+|\n+\z", "")


def fold_newlines(col) -> Column:
    """Single newlines become spaces, double newlines stay (pairs left to right):
    the last newline of every run of odd length is the single one."""
    return F.regexp_replace(_c(col), r"(?<!\n)((?:\n\n)*+)\n(?!\n)", "$1 ")


def normalize_text(col) -> Column:
    """T1 then T2, the order the ingest path applies them."""
    return fold_newlines(clean_text(col))


def tokens(col) -> Column:
    """array<string> of the tokens of a text (without special tokens)."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN_PATTERN), F.lit(0))


def n_tokens(col) -> Column:
    """Token count without the special tokens."""
    return F.regexp_count(_c(col), F.lit(TOKEN_PATTERN))


def token_count(col, counter=None) -> Column:
    """Token count including the special tokens; ``counter`` as in :mod:`chunkwise.functions.counter`."""
    if counter is not None:
        return (counter.count(_c(col)) + F.lit(counter.special)).cast("int")
    return (n_tokens(col) + F.lit(SPECIAL_TOKENS)).cast("int")


def join_lines(col, sep: str = "\n") -> Column:
    """Join an array of strings."""
    return F.array_join(_c(col), sep)


def epoch_seconds(col=None) -> Column:
    """Epoch seconds of a timestamp column (or of now)."""
    return F.unix_timestamp() if col is None else F.unix_timestamp(_c(col))


def file_name(path) -> Column:
    """Last path component."""
    return F.element_at(F.split(F.regexp_replace(_c(path), r"/+$", ""), "/"), -1)


def file_extension(path) -> Column:
    """Extension of the last path component, NULL when there is none."""
    return F.nullif(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1), F.lit(""))
