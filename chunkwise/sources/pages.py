"""Assembling texts from ordered parts (S6 pages, S8 digests, S9 numbered parts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_text(col, separator: str = "") -> F.Column:
    """S6 per page: split on newline, right-trim every line, join with ``separator``
    (the reference glues lines with nothing)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(F.split(c, "\n", -1), lambda l: F.regexp_replace(l, r"\s+$", "")), separator)


def assemble_pages(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no",
                   text_col: str = "text", separator: str = "", page_separator: str = "") -> DataFrame:
    """One text per document, pages in page order joined with ``page_separator``.

    Each page is reduced to one string first (row-local), then a document's
    page strings are gathered once; a document's text has to fit in a row.
    """
    per_page = pages.select(doc_col, page_col, page_text(text_col, separator).alias("_pt"))
    g = per_page.groupBy(doc_col).agg(F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("p"),
                                                                          F.col("_pt").alias("t")))).alias("_pages"))
    return g.select(doc_col, F.array_join(F.transform("_pages", lambda x: x["t"]), page_separator).alias("text"),
                    F.size("_pages").cast("int").alias("n_pages"))


def contiguous_parts(parts: DataFrame, id_col: str = "id", part_col: str = "part_no",
                     first: int = 1) -> DataFrame:
    """S9 step 1: keep parts ``first, first+1, ...`` up to the first gap.

    ``row_number`` over the part order equals ``part_no - first + 1`` exactly on
    the gap-free prefix (part numbers are unique per id).  The window sorts
    each id's parts in its task, spilling if needed; nothing is collected.
    """
    w = Window.partitionBy(id_col).orderBy(part_col)
    rn = F.row_number().over(w)
    return parts.withColumn("_rn", rn).where(F.col(part_col) - first + 1 == F.col("_rn")).drop("_rn")


def reassemble_parts(parts: DataFrame, id_col: str = "id", part_col: str = "part_no", body_col: str = "body",
                     first: int = 1) -> DataFrame:
    """Per id, the number of contiguous parts, the md5 of their
    concatenation and its length in characters.

    MD5 is sequential, so the parts of one id are hashed as a stream: rows are
    hash-partitioned by id and sorted within the partition, then one pass keeps
    a running digest per id.  Nothing is concatenated or collected, so an id
    holding a large share of all parts costs one sorted (spillable) run, not
    memory.
    """
    import hashlib

    import pyarrow as pa

    kept = contiguous_parts(parts, id_col, part_col, first).select(id_col, part_col, body_col)
    ordered = kept.repartition(id_col).sortWithinPartitions(id_col, part_col)
    id_type = kept.schema[id_col].dataType
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type
    out_schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_parts", T.IntegerType()),
                               T.StructField("md5", T.StringType()), T.StructField("n_chars", T.LongType())])
    arrow_id = to_arrow_type(id_type)

    def digest(batches):
        nothing = object()  # an id may be NULL
        cur, h, n, chars = nothing, None, 0, 0
        ids, counts, sums, lens = [], [], [], []
        for b in batches:
            for i, body in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if i != cur:
                    if cur is not nothing:
                        ids.append(cur), counts.append(n), sums.append(h.hexdigest()), lens.append(chars)
                    cur, h, n, chars = i, hashlib.md5(), 0, 0
                body = body or ""
                h.update(body.encode("utf-8"))
                n += 1
                chars += len(body)
            if len(ids) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_id), pa.array(counts, pa.int32()),
                                                  pa.array(sums, pa.string()), pa.array(lens, pa.int64())],
                                                 names=[id_col, "n_parts", "md5", "n_chars"])
                ids, counts, sums, lens = [], [], [], []
        if cur is not nothing:
            ids.append(cur), counts.append(n), sums.append(h.hexdigest()), lens.append(chars)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_id), pa.array(counts, pa.int32()),
                                              pa.array(sums, pa.string()), pa.array(lens, pa.int64())],
                                             names=[id_col, "n_parts", "md5", "n_chars"])

    return ordered.mapInArrow(digest, out_schema)


def merge_parts(parts: DataFrame, id_col: str = "id", part_col: str = "part_no", body_col: str = "body", first: int = 1) -> DataFrame:
    """Per id, the number of contiguous parts and their merged text (one row's value)."""
    kept = contiguous_parts(parts, id_col, part_col, first)
    body = F.coalesce(F.col(body_col), F.lit(""))
    g = kept.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(part_col).alias("p"), body.alias("b")))).alias("_parts"))
    return g.select(id_col, F.size("_parts").cast("int").alias("n_parts"),
                    F.array_join(F.transform("_parts", lambda x: x["b"]), "").alias("text"))


def check_digests(content: DataFrame, expected: DataFrame, id_col: str = "id", content_col: str = "content",
                  expected_col: str = "expected_md5") -> DataFrame:
    """md5 of each content against an expected digest -> ok / changed / missing."""
    got = content.select(id_col, F.md5(F.col(content_col)).alias("md5"))
    j = got.join(expected.select(id_col, expected_col), id_col, "left")
    status = (F.when(F.col(expected_col).isNull(), F.lit("missing"))
              .when(F.col(expected_col) == F.col("md5"), F.lit("ok")).otherwise(F.lit("changed")))
    return j.select(id_col, "md5", status.alias("status"))
