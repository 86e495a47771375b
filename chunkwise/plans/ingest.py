"""Ingest plans: documents -> clean -> chunk -> embed -> chunk table rows.

Everything is row-local (no shuffle): each document's chunks are produced by
higher-order functions inside its own row and exploded; the embedder is
JVM-side hashing plus an Arrow scatter.  A chunk's id is its file path and
position (:func:`chunk_key`): exact for any id and any number of chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators.embed import HashingEmbedder
from ..session import spread
from ..operators.split import explode_positions, with_token_chunks

def chunk_key(file_path: Column, pos: Column) -> Column:
    """A chunk's identity: its file and its position, as one string that sorts by both."""
    return F.concat(file_path, F.lit("#"), F.lpad(pos.cast("string"), 10, "0")).alias("chunk_id")


def stored_vector(vec: Column, embedder) -> Column:
    """A chunk's vector as it is stored.  The hashing embedder gives none where the signed counts of a text's tokens cancel
    out; such a chunk keeps a zero vector, which has no direction, so no search finds it."""
    if not getattr(embedder, "linear", False):
        return vec
    return F.coalesce(vec, F.array_repeat(F.lit(0.0).cast("float"), embedder.dim))


def document_path(df_source: Column, doc_id: Column) -> Column:
    """Path of a driver document: ``<source>/<doc_id>.txt``."""
    return F.concat(df_source, F.lit("/"), doc_id.cast("string"), F.lit(".txt"))


def chunk_pages(pages: DataFrame, *, doc_col: str = "file_path", page_col: str = "page_no", text_col: str = "text", root_path: Column | None = None,
                size: int = 256, overlap: int = 0, embedder=None, add_time: int | Column | None = None, separator: str = "", page_separator: str = "",
                counter=None) -> DataFrame:
    """Chunk table rows of documents given as page rows, of any number of pages: their text is never
    assembled (:mod:`chunkwise.operators.stream_split`).  ``root_path`` is an expression over ``file_path`` (default: the path itself)."""
    from ..operators.stream_split import split_pages

    embedder = embedder or HashingEmbedder()
    stamp = F.unix_timestamp() if add_time is None else (add_time if isinstance(add_time, Column) else F.lit(add_time))
    named = pages.select(F.col(doc_col).cast("string").alias("file_path"), F.col(page_col).alias("page_no"), F.col(text_col).alias("text"))
    chunks = split_pages(named, "file_path", size=size, overlap=overlap, separator=separator, page_separator=page_separator, counter=counter)
    return chunks.select(chunk_key(F.col("file_path"), F.col("pos")), (F.col("file_path") if root_path is None else root_path).alias("root_path"),
                         "file_path", "pos", "text", stored_vector(embedder.embed(F.col("text")), embedder).alias("embedding"), stamp.cast("long").alias("add_time"))


def chunk_documents(docs: DataFrame, *, size: int = 256, overlap: int = 0, embedder=None,
                    id_col: str = "doc_id", text_col: str = "text", root_col: str = "source",
                    add_time: int | Column | None = None, strategy: str = "sentence",
                    semantic_options=None, options=None, counter=None) -> DataFrame:
    """Chunk table rows (``schemas.chunks_schema`` columns) from a keyed document table.

    ``strategy="sentence"``: T1 -> T2 -> token splitter (T5).
    ``strategy="semantic"``: T1 -> T2 -> pieces of 500 tokens -> semantic chunker (C1-C9).
    ``options`` (:class:`chunkwise.operators.embed.EmbedOptions`, E5) overrides
    size, overlap and strategy, and the batch size of a model.  ``counter``: a token counter of the user
    (:mod:`chunkwise.functions.counter`) for both strategies.
    """
    embedder = embedder or HashingEmbedder()
    if options is not None:
        size, overlap, strategy = options.chunk_size, options.overlap, options.strategy
        embedder = options.embedder(embedder)
    stamp = F.unix_timestamp() if add_time is None else (add_time if isinstance(add_time, Column) else F.lit(add_time))
    base = spread(docs).select(F.col(id_col).alias("_id"), F.col(root_col).alias("root_path"),
                       normalize_text(F.col(text_col)).alias("_t"))
    if strategy == "sentence":
        chunks = explode_positions(with_token_chunks(base, "_t", "_chunks", size, overlap, counter),
                                   ["_id", "root_path"], "_chunks", "pos", "text")
    elif strategy == "semantic":
        from ..operators.semantic import SemanticOptions, with_semantic_chunks
        opts = semantic_options or SemanticOptions(counter=counter)
        staged = with_semantic_chunks(base, "_t", "_chunks", embedder, opts, vectors_col="_vecs")
        z = staged.select("_id", "root_path", F.arrays_zip(F.col("_chunks").alias("t"), F.col("_vecs").alias("v")).alias("_z"))
        chunks = explode_positions(z, ["_id", "root_path"], "_z", "pos", "_cz") \
            .select("_id", "root_path", "pos", F.col("_cz.t").alias("text"), F.col("_cz.v").alias("_vec"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    vec = F.col("_vec") if "_vec" in chunks.columns else embedder.embed(F.col("text"))
    return chunks.select(
        chunk_key(document_path(F.col("root_path"), F.col("_id")), F.col("pos")),
        F.col("root_path"),
        document_path(F.col("root_path"), F.col("_id")).alias("file_path"),
        F.col("pos").cast("int").alias("pos"),
        F.col("text"),
        stored_vector(vec, embedder).alias("embedding"),
        stamp.cast("long").alias("add_time"),
    )
