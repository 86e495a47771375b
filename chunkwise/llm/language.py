"""Language identification by compression.

Each language gets a raw-content zstandard dictionary of sample text.  A text
is cut into blocks, every block is compressed with every dictionary, and the
language with the smallest total wins; a narrow margin is a rejection.

The dictionaries come from a bounded sample (documented parameters
``SAMPLE_DOCS`` and ``SAMPLE_CHARS``): the rows of each language with the
smallest hash.  They are the only thing that reaches the driver, at most
``SAMPLE_DOCS * SAMPLE_CHARS`` characters a language.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and is rejected; equal texts have equal results; ties go to the language with
more labelled rows; with one learned language all texts get it, with none ``und``;
repeated rows are judged one by one; an empty table gives an empty table.
Whole texts count, however long: blocks bound the memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

SAMPLE_DOCS = 300
SAMPLE_CHARS = 400
BLOCK = 4096
LEVEL = 6
#: A text is rejected if the best language saves less than this share over the second.
MIN_MARGIN = 0.002
UNKNOWN = "und"

SHORT, ROTATIONS = 400, 8

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def sample(docs: DataFrame, where: Column | None = None, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
           n_docs: int = SAMPLE_DOCS, n_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Learn: sample text by language (the commonest first) from the labelled rows that satisfy ``where``.

    Rows are thinned by a hash of the id before the per-language rank, so the
    rank sorts a few times ``n_docs`` rows a language, whatever the input."""
    rows = docs if where is None else docs.where(where)
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return {}
    # hash below share * 2^32 keeps about 2 * n_docs rows of each language, all of a small one
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit("language sample")), F.lit(2**32))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, 2.0 * n_docs / n))).otherwise(share)
    thin = rows.select(F.col(lang_col).alias("lang"), h.alias("h"), share.alias("share"),
                       F.substring(F.col(text_col), 1, n_chars).alias("text")).where(F.col("h") < F.col("share") * F.lit(2.0**32))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    top = thin.withColumn("k", rank).where(F.col("k") <= n_docs).orderBy("lang", "k").collect()
    out: dict[str, list[bytes]] = {}
    for r in top:
        out.setdefault(r["lang"], []).append(normal(r["text"]).encode())
    return {lang: b" ".join(out[lang]) for lang in sorted(out, key=lambda x: (-counts[x], x))}


def normal(text: str) -> str:
    """Lower-case words of letters, one space apart, runs of one word once."""
    words = _OTHER.sub(" ", text.lower()).split()
    return " ".join([w for k, w in enumerate(words) if not k or w != words[k - 1]])


def blocks_of(text: str) -> list[bytes]:
    """What is compressed for a text: its normal form in blocks.  Sizes are whole
    bytes, so a short text is compressed in several rotations, which average that out."""
    data = normal(text)
    if len(data) < SHORT:
        words = data.split(" ")
        turns = min(ROTATIONS, len(words))
        return [" ".join(words[k:] + words[:k]).encode() for k in (len(words) * i // turns for i in range(turns))]
    data = data.encode()
    return [data[k:k + BLOCK] for k in range(0, len(data), BLOCK)]


class Compressors:
    """Total compressed bytes of a text by language."""

    def __init__(self, samples: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.langs = list(samples)
        self.by_lang = []
        for data in samples.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by_lang.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False,
                                                         write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): the score is the softmax weight of the best
        language over the mean bits saved, the margin the share saved over the second."""
        if not self.langs or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        blocks = blocks_of(text)
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.by_lang]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / sizes[order[1]] if len(order) > 1 else 1.0
        score = 1.0 / sum(math.exp(-min(700.0, s - best)) for s in sizes)
        return self.langs[order[0]], score, margin


def _predictor(samples: dict[str, bytes]):
    made: list[Compressors] = []

    def get() -> Compressors:
        if not made:
            made.append(Compressors(samples))
        return made[0]
    return get


def identify(docs: DataFrame, samples: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for every row."""
    get = _predictor(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = get()
        for b in slices(batches, "text", 8 << 20):
            rows = [c.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.float64()),
                 pa.array([r[0] == UNKNOWN or r[2] < min_margin for r in rows], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean"))


def keep_identified(docs: DataFrame, samples: dict[str, bytes], text_col: str = "text", lang_col: str = "lang",
                    min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows whose language is clear, ``lang`` set to it; columns as before."""
    get = _predictor(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = get()
        for b in slices(batches, text_col, 8 << 20):
            rows = [c.predict(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            at = b.schema.get_field_index(lang_col)
            if at >= 0:
                b = b.set_column(at, b.schema.field(at), pa.array([r[0] for r in rows], b.schema.field(at).type))
            yield b.filter(pa.array([r[0] != UNKNOWN and r[2] >= min_margin for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
