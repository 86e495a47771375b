"""Question answering plans (R2 -> R3/R4/R5 -> R6/R7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.embed import HashingEmbedder
from ..operators.render import markdown
from ..operators.retrieve import DEFAULT_K, DEFAULT_MAX_DISTANCE, top_k


def embed_questions(questions: DataFrame, embedder=None, id_col: str = "query_id",
                    text_col: str = "text") -> DataFrame:
    embedder = embedder or HashingEmbedder()
    return questions.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("question"),
                            embedder.embed(F.col(text_col)).alias("embedding"))


def retrieve(questions: DataFrame, chunks: DataFrame, *, k: int = DEFAULT_K,
             max_distance: float = DEFAULT_MAX_DISTANCE, embedder=None, id_col: str = "query_id",
             text_col: str = "text") -> DataFrame:
    """Hits: query_id, chunk_id, file_path, text, distance, rank."""
    embedder = embedder or HashingEmbedder()
    q = embed_questions(questions, embedder, id_col, text_col)
    return top_k(q, chunks, k=k, max_distance=max_distance, payload=["file_path", "text"],
                 dim=embedder.dim, source="file_path")


def answer_markdown(questions: DataFrame, chunks: DataFrame, *, k: int = DEFAULT_K,
                    max_distance: float = DEFAULT_MAX_DISTANCE, embedder=None, id_col: str = "query_id",
                    text_col: str = "text") -> DataFrame:
    """R2 + R3: one row per question: query_id, n_hits, markdown ('' without hits)."""
    hits = retrieve(questions, chunks, k=k, max_distance=max_distance, embedder=embedder,
                    id_col=id_col, text_col=text_col)
    md = markdown(hits)
    q = questions.select(F.col(id_col).alias("query_id"))
    return (q.join(md, "query_id", "left")
            .select("query_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
                    F.coalesce("markdown", F.lit("")).alias("markdown")))
