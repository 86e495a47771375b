"""Fill-in-the-middle rows by in-place block rotation.

A text is cut at two token boundaries into prefix, middle and suffix.  One scan
over its bytes finds the token starts; the three sentinels are inserted into one
bytearray in text order (prefix, middle, suffix), and the order of the form
comes from exchanging two neighbouring segments in place by three reversals:

* psm: ``<P>`` prefix, then [``<M>`` middle] and [``<S>`` suffix] change places;
* spm: [``<P>`` prefix ``<M>`` middle] and [``<S>`` suffix] change places.

``restore`` finds the sentinels, undoes the rotation and takes them out again.
A text that holds a sentinel itself stays plain, so an output holds each one
once: a sentinel cannot overlap another one, and no two segments touch.

Rows are independent (one narrow stage, no shuffle); reversals run in blocks of
``BLOCK`` bytes, so a text needs its own bytes once beside the row.

Defined results: a null text is empty, an empty text is plain; a null id hashes
like an empty one; rows are never dropped, so repeated rows come back repeated;
an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Share of texts that are transformed, and of these the share with the suffix first, in per cent.
RATE = 90
SPM_RATE = 20
SALT = "1:"
BLOCK = 1 << 16

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def reverse(a: np.ndarray, i: int, j: int) -> None:
    """Reverse a[i:j] in place, a block from either end at a time."""
    while j - i > 1:
        n = min(BLOCK, (j - i) // 2)
        low = a[i:i + n][::-1].copy()
        a[i:i + n] = a[j - n:j][::-1]
        a[j - n:j] = low
        i, j = i + n, j - n


def exchange(a: np.ndarray, i: int, m: int, j: int) -> None:
    """Let a[i:m] and a[m:j] change places in place: reverse both, then the whole."""
    reverse(a, i, m)
    reverse(a, m, j)
    reverse(a, i, j)


def token_starts(data: bytes) -> np.ndarray:
    """Byte positions at which the tokens ``[A-Za-z]+|[^A-Za-z]`` of a UTF-8 text start."""
    a = np.frombuffer(data, np.uint8)
    letter = ((a | 32) >= 97) & ((a | 32) <= 122)
    start = (a & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


def draws(doc_id: int | None, salt: str = SALT) -> list[int]:
    """h1 to h4 of a document."""
    h = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k:k + 8], 16) for k in range(0, 32, 8)]


def code_points(data: bytes | bytearray) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def arrange(data: bytes, low: int, high: int, form: str) -> bytearray:
    """The output of a text whose middle is data[low:high]."""
    out = bytearray(data)
    out[high:high] = SUFFIX
    out[low:low] = MIDDLE
    out[0:0] = PREFIX
    middle = len(PREFIX) + low
    suffix = middle + len(MIDDLE) + high - low
    a = np.frombuffer(out, np.uint8)
    exchange(a, middle if form == "psm" else 0, suffix, len(out))
    del a  # a bytearray with a view cannot change its length
    return out


def rebuilt(output: bytes, form: str) -> bytes:
    """The text of an output: the rotation undone, the sentinels taken out."""
    if form == "plain":
        return output
    out = bytearray(output)
    a = np.frombuffer(out, np.uint8)
    if form == "psm":
        exchange(a, out.index(SUFFIX), out.index(MIDDLE), len(out))
    else:
        exchange(a, 0, out.index(PREFIX), len(out))
    del a
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = out.index(mark)
        del out[at:at + len(mark)]
    return bytes(out)


def transform_text(doc_id: int | None, data: bytes, rate: int = RATE, spm_rate: int = SPM_RATE, salt: str = SALT) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    starts = token_starts(data)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id, salt)
    if not n or h3 % 100 >= rate or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    cuts = np.append(starts, len(data))
    low, high = (int(cuts[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    form = "spm" if h4 % 100 < spm_rate else "psm"
    return n, form, code_points(data[:low]), code_points(data[low:high]), arrange(data, low, high, form).decode()


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, salt: str = SALT,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8 << 20):
            rows = [transform_text(i, t.encode(), rate, spm_rate, salt) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            n, form, prefix, middle, out = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array([x if isinstance(x, str) else x.decode() for x in out], pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` of ``transform`` with ``restored``, the text rebuilt from output and form alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "output", 8 << 20):
            back = [rebuilt(x.encode(), f).decode() for x, f in zip(b.column("output").to_pylist(), b.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.string())], names=[*b.schema.names, "restored"])

    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").mapInArrow(run, SCHEMA + ", restored string")
