"""Quality rules by line-first cleaning.

Every line of a text is judged on its own: navigation, symbol noise, shouting,
word stutter, missing punctuation and boilerplate phrases fail a line.  Failed
lines are removed, and a document that loses more than ``MAX_LOSS`` of its
word characters, or fails the base rules (too short, too repetitive), is
rejected.

Defined results: a null text has no words and is rejected (``n_words`` 0); an
empty text likewise; repeated rows are judged one by one; an empty table gives
an empty table; extra columns are ignored by :func:`judge` and kept by
:func:`clean`.  One text is one row of work (linear time and memory).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PCT = 30
MAX_LOSS = 0.5
#: Share of separator words (``|`` and the like) that makes a line navigation.
NAV_PCT = 20
#: Symbols per 100 words that make a line noise.
SYMBOL_PCT = 50
STUTTER_WORDS = 10
PLAIN_WORDS = 8
SHOUT_WORDS = 3
#: Phrases of page furniture; a short line that holds one is boilerplate.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use",
               "sign up for our newsletter", "subscribe to our newsletter", "enable javascript", "click here to",
               "skip to content", "lorem ipsum")
BOILERPLATE_WORDS = 30
SEPARATORS = (b"|", b"\xc2\xbb", b"\xe2\x80\xba", b"\xe2\x80\xa2")
SYMBOLS = b"#*$%&|<>"
#: Marks that end or divide sentences, by script (Latin, Greek, Armenian, Hebrew, Arabic, Devanagari,
#: Tibetan, Burmese, Ethiopic, Khmer, Mongolian, Chinese and Japanese, full width).
PUNCTUATION = ".,;:!?…" "·" "։՜՝՞" "׃" "،؛؟۔" "।॥" "།༎" "၊။" "።፣፤፥፦፧" "។៕៖" "᠂᠃" "、。" "！，．：；？｡､"

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_failed_lines long, kept_chars long, cleaned string")

_LOWER, _UPPER = regex.compile(r"\p{Ll}"), regex.compile(r"\p{Lu}")
_ASCII_MARKS = "".join(c for c in PUNCTUATION if c.isascii()).encode()
_MARKS = regex.compile(f"[{PUNCTUATION}]")


def _length(data: bytes) -> int:
    """Code points of valid UTF-8."""
    return len(data) if data.isascii() else len(data.decode())


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with at least one word fails a line rule."""
    n = len(words)
    if 100 * sum(words.count(s) for s in SEPARATORS) >= NAV_PCT * n:
        return True
    if 100 * (len(line) - len(line.translate(None, SYMBOLS))) >= SYMBOL_PCT * n:
        return True
    if n >= STUTTER_WORDS and 3 * len(set(words)) < n:
        return True
    text = line.decode()
    if n >= PLAIN_WORDS and len(line) == len(line.translate(None, _ASCII_MARKS)) and (line.isascii() or not _MARKS.search(text)):
        return True
    if n >= SHOUT_WORDS and not _LOWER.search(text) and _UPPER.search(text):
        return True
    if n <= BOILERPLATE_WORDS:
        low = text.lower()
        return any(p in low for p in BOILERPLATE)
    return False


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    roll = np.zeros(n, np.uint64)
    for k in range(window):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
        roll ^= roll >> np.uint64(29)
    order = np.argsort(roll, kind="stable")
    same = roll[order[1:]] == roll[order[:-1]]
    if not same.any():
        return 0
    # equal hashes are confirmed word by word; a mismatch (never seen) falls back to exact keys
    ids: dict[bytes, int] = {}
    ranks = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    a, b = order[:-1][same], order[1:][same]
    hit = np.zeros(n, bool)
    if all((ranks[a + k] == ranks[b + k]).all() for k in range(window)):
        hit[a] = hit[b] = True
    else:
        _, inverse, counts = np.unique(np.lib.stride_tricks.sliding_window_view(ranks, window), axis=0,
                                       return_inverse=True, return_counts=True)
        hit = counts[inverse.ravel()] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge_text(data: bytes | None) -> tuple:
    """The row of :data:`SCHEMA` without the id for one UTF-8 text."""
    words: list[bytes] = []
    seen: set[bytes] = set()
    dup = failed = lost = 0
    keep: list[bytes] = []
    for line in (data or b"").split(b"\n"):
        own = line.split()
        if own:
            words += own
            if line in seen:
                dup += 1
            seen.add(line)
            if line_fails(line, own):
                failed += 1
                lost += _length(b"".join(own))
                continue
        keep.append(line)
    n = len(words)
    joined = b"".join(words)
    chars = _length(joined)
    repeats = repeat_words(words)
    base = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PCT * n
    return (n, chars, len(joined) - len(joined.translate(None, SYMBOLS)), dup, repeats, base,
            not base and lost <= MAX_LOSS * chars, failed, chars - lost, b"\n".join(keep).decode())


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row of :data:`SCHEMA` per document: measures, verdict and, with
    ``with_text``, the text without its failed lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8 << 20):
            rows = [judge_text(x) for x in b.column(1).to_pylist()]
            cols = list(zip(*rows))
            if not with_text:
                cols[9] = [None] * len(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0)] + [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()])],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "kept", "n_failed_lines", "kept_chars", "cleaned"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, SCHEMA))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept documents with failed lines removed: the same columns, and
    ``n_chars`` (if it is there) counted anew.  The rows pass through Python
    whole, so ids may repeat or be null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, 8 << 20):
            at = b.schema.get_field_index(text_col)
            rows = [judge_text(x.encode() if x else b"") for x in b.column(at).to_pylist()]
            b = b.set_column(at, b.schema.field(at), pa.array([r[9] for r in rows], b.schema.field(at).type))
            if "n_chars" in names:
                k = b.schema.get_field_index("n_chars")
                b = b.set_column(k, b.schema.field(k), pa.array([len(r[9]) for r in rows], b.schema.field(k).type))
            yield b.filter(pa.array([r[6] for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
