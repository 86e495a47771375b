"""Answer routing (R6) and the whole question-to-answer pipeline.

* No settings row (``id = 1``) or ``state = false``: the answer is the
  Markdown of the hits.
* Otherwise the user's generator is called once per question with the
  prompts of R4/R5 and the settings' url/token.  A failing call is captured
  per row: that question falls back to its Markdown and is flagged
  (``generator_failed``).  The reference instead switched generation off for
  everyone; :func:`settings_after_failures` applies that state change (M6)
  when wanted.
* A question without any token (no vector) gets the fixed hint text.

The generator is the only per-row Python: each row is one external call, run
in an Arrow function; no HTTP client is built in.
"""

from __future__ import annotations

from typing import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mutate import set_state
from .render import EMPTY_QUERY_HINT, context_of, hit_items, markdown_of, prompt_columns

Generator = Callable[[str | None, str, str, str], str]


def _generate_udf(generator: Generator):
    @F.arrow_udf("struct<answer:string,error:string>")
    def generate(system: pa.Array, prompt: pa.Array, url: pa.Array, token: pa.Array) -> pa.Array:
        answers, errors = [], []
        for s, p, u, t in zip(system.to_pylist(), prompt.to_pylist(), url.to_pylist(), token.to_pylist()):
            if p is None:  # generation not enabled for this row
                answers.append(None)
                errors.append(None)
                continue
            try:
                answers.append(str(generator(s, p, u, t)))
                errors.append(None)
            except Exception as e:  # noqa: BLE001 - captured per row
                answers.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return pa.StructArray.from_arrays([pa.array(answers, pa.string()), pa.array(errors, pa.string())],
                                          names=["answer", "error"])

    return generate


def route_answers(questions: DataFrame, hits: DataFrame, settings: DataFrame | None, generator: Generator | None,
                  *, query_id: str = "query_id", question_col: str = "text", has_vector_col: str | None = None,
                  include_question: bool = True, settings_id: int = 1, generator_tasks: int | None = None) -> DataFrame:
    """``generator_tasks``: tasks that call the generator (default: all task slots); rows are few
    and small but each is a slow call, so they are dealt by number, not by bytes.

    R6: query_id, answer, source ('generator' | 'markdown' | 'hint'), n_hits, generator_failed, error."""
    h = hit_items(hits, query_id=query_id)
    q = questions.select(query_id, F.col(question_col).alias("_question"),
                         *([has_vector_col] if has_vector_col else []))
    j = q.join(h, query_id, "left")
    sys_p, user_p = prompt_columns(F.col("_question"), context_of("items"), F.col("n_hits"), include_question)
    j = j.select("*", sys_p.alias("system_prompt"), user_p.alias("user_prompt"), markdown_of("items").alias("markdown"))
    # The one settings row (id = settings_id), read once as literals
    cfg = None
    if settings is not None and generator is not None:
        cfg = settings.where(F.col("id") == F.lit(settings_id)).select("url", "token", "state").limit(1).first()
    enabled = F.lit(bool(cfg is not None and cfg["state"]))
    j = (j.withColumn("_url", F.lit(cfg["url"] if cfg is not None else None).cast("string"))
          .withColumn("_token", F.lit(cfg["token"] if cfg is not None else None).cast("string")))
    has_vec = F.col(has_vector_col) if has_vector_col else F.lit(True)
    run = enabled & has_vec
    gen = _generate_udf(generator) if generator is not None else None
    if gen is not None:
        j = j.repartition(generator_tasks or j.sparkSession.sparkContext.defaultParallelism)
        j = j.withColumn("_g", gen(F.col("system_prompt"), F.when(run, F.col("user_prompt")),
                                   F.col("_url"), F.col("_token")))
    else:
        j = j.withColumn("_g", F.struct(F.lit(None).cast("string").alias("answer"),
                                        F.lit(None).cast("string").alias("error")))
    md_text = F.coalesce(F.col("markdown"), F.lit(""))
    ok = run & F.col("_g.answer").isNotNull()
    answer = F.when(~has_vec, F.lit(EMPTY_QUERY_HINT)).when(ok, F.col("_g.answer")).otherwise(md_text)
    source = F.when(~has_vec, F.lit("hint")).when(ok, F.lit("generator")).otherwise(F.lit("markdown"))
    return j.select(query_id, answer.alias("answer"), source.alias("source"),
                    F.coalesce(F.col("n_hits"), F.lit(0)).cast("int").alias("n_hits"),
                    (run & F.col("_g.error").isNotNull()).alias("generator_failed"),
                    F.col("_g.error").alias("error"))


def settings_after_failures(settings: DataFrame, answers: DataFrame, now, settings_id: int = 1) -> DataFrame:
    """The reference's circuit break: any failed generation sets ``state = false``."""
    failed = answers.where(F.col("generator_failed")).limit(1).select(F.lit(settings_id).cast("long").alias("id"))
    return set_state(settings, failed, False, now)


def answer_questions(questions: DataFrame, chunks: DataFrame, settings: DataFrame | None = None,
                     generator: Generator | None = None, *, k: int = 5, max_distance: float = 0.6, embedder=None,
                     id_col: str = "query_id", text_col: str = "text", include_question: bool = True) -> DataFrame:
    """Questions -> vectors -> exact top-k -> answer per question."""
    from ..operators.embed import HashingEmbedder
    from ..operators.retrieve import top_k

    embedder = embedder or HashingEmbedder()
    qv = questions.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text"),
                          embedder.embed(F.col(text_col)).alias("embedding"))
    hits = top_k(qv, chunks, k=k, max_distance=max_distance, payload=["file_path", "text"], dim=embedder.dim, source="file_path")
    qs = qv.select("query_id", "text", F.col("embedding").isNotNull().alias("_has_vec"))
    return route_answers(qs, hits, settings, generator, has_vector_col="_has_vec",
                         include_question=include_question)
