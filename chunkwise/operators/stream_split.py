"""Splitting documents that are larger than a row (S6 into T1, T2, T4/T5).

A document's pages arrive as rows; :func:`split_pages` sorts them by document and page and
reads them as a stream: it cleans, cuts and packs with the rules of
:mod:`chunkwise.operators.split`, so the chunks equal those of the assembled text, but holds only
what is still open: blanks at the end of the page read last, the sentence (of one over the budget:
the word) that goes on, and the units of the chunk being filled.  Memory does not grow with
the document.  A sentence within the budget, a token and a page must fit in memory.

Greedy packing is sequential, so one document is one task's sorted run (spilled by Spark, never
gathered); documents are dealt to all tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.counter import BLANKS, TokenCounter
from ..functions.text import SENTENCE_END, WIDE_END
from .split import _cap

#: Java's \\s, and the line ends at which its ^ and $ match.
_S = " \\t\\n\\x0b\\f\\r"
_EOL = "\\n\\r\\x85\\u2028\\u2029"
_TOKEN = regex.compile(rf"[一-鿿]|[\p{{L}}\p{{N}}]+|[^{_S}\p{{L}}\p{{N}}]")
_OPEN_END = re.compile(rf"[ \t{_EOL}]*\Z")
_EDGES = re.compile(rf"(?<=[{_EOL}])[ \t]+|[ \t]+(?=[{_EOL}])")
_CUT = re.compile(rf"(?<=[{SENTENCE_END}])[{_S}]+|(?<=[{WIDE_END}])(?![{WIDE_END}])[{_S}]*")


class PageSplitter:
    """Chunks of one document, fed page by page: :meth:`feed` and :meth:`finish` give the chunks that are complete."""

    def __init__(self, cap: int, overlap: int = 0, counter: TokenCounter | None = None):
        self.cap, self.overlap, self.counter = cap, overlap, counter
        self.raw, self.started = "", False
        self.text, self.seen = "", 0  # cleaned, not cut yet; no cut begins before ``seen``
        self.end = ""  # last character of the sentence before
        self.words = self.inside = False  # the open sentence is over the cap; the open word too, and has begun
        self.first = True  # the next word is its sentence's first
        self.units: list[tuple[str, str, int]] = []
        self.size = 0
        self.done: list[str] = []

    # -- T1, T2 ------------------------------------------------------------
    def feed(self, page: str) -> list[str]:
        self.raw += page
        at = _OPEN_END.search(self.raw).start()
        body, self.raw = self.raw[:at], self.raw[at:]
        if body:
            self._clean(body)
            self._cut()
        return self._take()

    def finish(self) -> list[str]:
        """The last chunks; blanks at the end of the text count for nothing."""
        rest = _EDGES.sub("", self.raw).rstrip(" \t")
        self.text += re.sub(r"\n+", " ", re.sub(r"\n+\Z", "", rest))
        # Java's $ also matches before a line end that closes the text
        self.text = re.sub(rf"[{_S}]+(?=[\x85\u2028\u2029]?\Z)", "", self.text)
        self._cut()
        if self.words:
            self._words(self.text, True)
        elif self.text:
            self._sentence(self.text)
        if self.units:
            self._emit()
        return self._take()

    def _clean(self, body: str) -> None:
        t = re.sub(r"\n+", "\n", _EDGES.sub("", body))
        if not self.started:
            t = t.lstrip(" \t").lstrip("\n")
        t = t.replace("\n", " ")
        if not self.started:
            t = t.lstrip(" \t\n\x0b\f\r")
            self.started = bool(t)
        self.text += t

    # -- sentences, words, windows -------------------------------------------
    def _cut(self) -> None:
        at = 0
        for m in _CUT.finditer(self.text, self.seen):
            if m.end() >= len(self.text):  # blanks or a further full-width end may follow
                break
            if m.start() > at or self.words:
                self._words(self.text[at:m.start()], True) if self.words else self._sentence(self.text[at:m.start()])
            at = m.end()
        self.text = self.text[at:]
        if self.counter is None and (self.words or len(_TOKEN.findall(self.text)) > self.cap):
            self.words = True
            self.text = self._words(self.text, False)
        # a cut may begin at the blanks or full-width ends that close the text
        self.seen = len(self.text.rstrip(" \t\n\x0b\f\r" + WIDE_END))

    def _count(self, texts: list[str]) -> list[int]:
        if self.counter is not None:
            return self.counter.counted(pa.array(texts, pa.string())).tolist()
        return [len(_TOKEN.findall(t)) for t in texts]

    def _before(self) -> str:
        return "" if self.end and self.end in WIDE_END else " "

    def _sentence(self, s: str) -> None:
        n = self._count([s])[0]
        if n <= self.cap:
            self._unit(s, self._before(), n)
            self.end = s[-1:]
        else:
            self._words(s, True)

    def _words(self, s: str, complete: bool) -> str:
        """Units of the words of an open sentence; of an incomplete one the last word is given back."""
        parts = BLANKS.split(s)
        rest = "" if complete else parts.pop()
        if self.counter is not None:
            self._counted_words([w for w in parts if w])
        else:
            for k, w in enumerate(parts):
                if w or self.inside:
                    self._word(w, True)
            if rest:
                rest = self._word(rest, False)
        if complete:
            if s:
                self.end = s[-1:]
            self.words, self.first, self.inside = False, True, False
        return rest

    def _word(self, w: str, complete: bool) -> str:
        tokens = _TOKEN.findall(w)
        sep = "" if self.inside else self._before() if self.first else " "
        if complete and not self.inside and len(tokens) <= self.cap:
            self._unit(w, sep, len(tokens))
            self.first = False
            return ""
        # windows of cap tokens; the last token of an open word may go on
        whole = len(tokens) if complete else (len(tokens) - 1) // self.cap * self.cap
        for k in range(0, whole, self.cap):
            window = tokens[k:min(k + self.cap, whole)]
            self._unit("".join(window), sep, len(window))
            sep, self.first, self.inside = "", False, True
        if complete:
            self.inside = False
        return "".join(tokens[whole:])

    def _counted_words(self, words: list[str]) -> None:
        for w, n in zip(words, self._count(words) if words else []):
            for k, (part, m) in enumerate(self.counter.halved(w, n, self.cap)):
                self._unit(part, "" if k else self._before() if self.first else " ", m)
            self.first = False

    # -- T5 packing ----------------------------------------------------------
    def _unit(self, t: str, sep: str, n: int) -> None:
        if self.size > 0 and self.size + n > self.cap:
            self._emit()
            kept, size = 0, 0
            for _, _, m in reversed(self.units[1:]) if self.overlap else ():
                if size + m > self.overlap or size + m + n > self.cap:
                    break
                kept, size = kept + 1, size + m
            self.units, self.size = self.units[len(self.units) - kept:], size
        self.units.append((t, sep, n))
        self.size += n

    def _emit(self) -> None:
        self.done.append(self.units[0][0] + "".join(s + t for t, s, _ in self.units[1:]))

    def _take(self) -> list[str]:
        out, self.done = self.done, []
        return out


def split_pages(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no", text_col: str = "text", *, size: int = 256, overlap: int = 0,
                separator: str = "", page_separator: str = "", counter: TokenCounter | None = None) -> DataFrame:
    """``doc_col``, pos, text: the chunks of every document, as ``assemble_pages`` followed by the ingest path's
    cleaning and T5 would give them.  Null pages are left out."""
    from ..sources.pages import page_text

    cap = _cap(size, overlap, counter)
    kind = pages.schema[doc_col].dataType
    rows = (pages.select(F.col(doc_col).alias("_doc"), F.col(page_col).alias("_page"), page_text(text_col, separator).alias("_text"))
            .where("_text IS NOT NULL").repartition("_doc").sortWithinPartitions("_doc", "_page", "_text").select("_doc", "_text"))
    arrow_kind = to_arrow_type(kind)
    names = [doc_col, "pos", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()  # an id may be null
        doc, splitter, pos, out, held = nothing, None, 0, [], 0

        def flush() -> pa.RecordBatch:
            ids, places, texts = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(ids, arrow_kind), pa.array(places, pa.int32()), pa.array(texts, pa.string())], names=names)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                chunks, before = [], doc
                if i != doc or doc is nothing:
                    chunks = splitter.finish() if splitter else []
                    for c in chunks:
                        out.append((before, pos, c))
                        pos, held = pos + 1, held + len(c)
                    doc, splitter, pos = i, PageSplitter(cap, overlap, counter), 0
                    chunks = splitter.feed(t)
                else:
                    chunks = splitter.feed(page_separator + t)
                for c in chunks:
                    out.append((doc, pos, c))
                    pos, held = pos + 1, held + len(c)
                if held > 4 << 20:
                    yield flush()
                    out, held = [], 0
        if splitter:
            for c in splitter.finish():
                out.append((doc, pos, c))
                pos += 1
        if out:
            yield flush()

    schema = T.StructType([T.StructField(doc_col, kind), T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema)
