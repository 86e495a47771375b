"""Answer assembly from hits (R3 Markdown, R4/R5 prompts).

Hits are small (queries x k rows): one aggregation per query gathers them
into a rank-sorted array and every rendering is an expression over it.
Files inside one answer are ordered by their best hit (the reference used
hash-map order); texts inside a file by rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The exact prompt texts and Markdown layout of the reference.
MD_FILE_HEADER = "### File: "
MD_AFTER_HEADER = "\n\n"
MD_ITEM_PREFIX = "- "
MD_ITEM_SUFFIX = "\n"
MD_FILE_FOOTER = "\n---\n\n"

CONTEXT_PREAMBLE = """你是一个基于检索增强生成（RAG）的知识问答助手。你的任务是根据用户提供的查询和相关文档片段，生成准确、简洁且符合上下文的回答。

### 输入格式：
1. **用户查询**：用户提出的问题或需要解答的内容。
2. **相关文档片段**：从知识库中检索到的与查询相关的文本片段。

### 输出格式：
1. **回答**：基于检索到的文档片段，生成一个准确且完整的回答。
2. **引用来源**（可选）：如果适用，标明回答所依据的文档片段来源。
3. **格式**：使用Markdown格式回答。

### 注意事项：
1. **准确性**：确保回答与检索到的文档片段一致，避免编造信息。
2. **简洁性**：回答应简明扼要，避免冗长或不相关的信息。
3. **上下文一致性**：确保回答与用户查询的上下文相符。
4. **引用来源**：如果用户要求或需要明确来源，请在回答中引用相关文档片段。

### 本地知识

"""

REMOTE_PREAMBLE = """你是一个基于本地知识和通用知识的 AI 助手，能够帮助用户解答问题。

1. **如果未检索到本地知识**：
   - 礼貌地告知用户未找到相关本地内容。
   - 继续基于通用知识回答用户的问题。
   - 确保回答仍然有帮助且相关。

**示例交互**：

- 用户：法国的首都是哪里？
- AI：法国的首都是巴黎。

- 用户：我们内部项目 X 的关键特性是什么？
- AI：未找到关于项目 X 的本地内容。不过，根据通用知识，项目 X 通常涉及以下特性：……"""

EMPTY_QUERY_HINT = "请输入内容或问题"
# Our addition (not in the reference): heading placed before the question when
# the context prompt includes it.
QUESTION_HEADING = "\n\n### 用户查询\n\n"
# ---------------------------------------------------------------------------


def hit_items(hits: DataFrame, query_id: str = "query_id", file_col: str = "file_path",
              text_col: str = "text", rank_col: str = "rank") -> DataFrame:
    """One row per query with hits: ``n_hits`` and ``items`` = array of
    struct(r, f, t) sorted by rank.  Hits are at most k per query, so this one
    aggregation feeds every rendering below."""
    return hits.groupBy(query_id).agg(
        F.count(F.lit(1)).cast("int").alias("n_hits"),
        F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"), F.col(file_col).alias("f"),
                                             F.col(text_col).alias("t")))).alias("items"))


def markdown_of(items) -> Column:
    """R3 for a rank-sorted item array: one block per file, files in order of
    their best hit, texts of a file in rank order."""
    it = F.col(items) if isinstance(items, str) else items
    files = F.array_distinct(F.transform(it, lambda x: x["f"]))

    def block(f):
        texts = F.transform(F.filter(it, lambda x: x["f"] == f),
                            lambda x: F.concat(F.lit(MD_ITEM_PREFIX), x["t"], F.lit(MD_ITEM_SUFFIX)))
        return F.concat(F.lit(MD_FILE_HEADER), f, F.lit(MD_AFTER_HEADER), F.array_join(texts, ""),
                        F.lit(MD_FILE_FOOTER))

    return F.coalesce(F.array_join(F.transform(files, block), ""), F.lit(""))


def context_of(items) -> Column:
    """Hit texts joined by newline in rank order."""
    it = F.col(items) if isinstance(items, str) else items
    return F.array_join(F.transform(it, lambda x: x["t"]), "\n")


def markdown(hits: DataFrame, query_id: str = "query_id", file_col: str = "file_path",
             text_col: str = "text", rank_col: str = "rank") -> DataFrame:
    """One row per query that has hits: ``query_id``, ``n_hits``, ``markdown``."""
    h = hit_items(hits, query_id, file_col, text_col, rank_col)
    return h.select(query_id, "n_hits", markdown_of("items").alias("markdown"))


def prompt_columns(question, context, n_hits, include_question: bool = True) -> tuple[Column, Column]:
    """R4 + R5 as columns: (system_prompt, user_prompt)."""
    with_ctx = F.concat(F.lit(CONTEXT_PREAMBLE), context)
    if include_question:
        with_ctx = F.concat(with_ctx, F.lit(QUESTION_HEADING), question)
    has = F.coalesce(n_hits, F.lit(0)) > 0
    return (F.when(has, F.lit(None).cast("string")).otherwise(F.lit(REMOTE_PREAMBLE)),
            F.when(has, with_ctx).otherwise(question))


def prompts(queries: DataFrame, hits: DataFrame, query_id: str = "query_id", question_col: str = "text",
            include_question: bool = True, text_col: str = "text", rank_col: str = "rank",
            file_col: str = "file_path") -> DataFrame:
    """R4 + R5: one row per query: ``system_prompt``, ``user_prompt``, ``n_hits``.

    With hits: no system prompt, user prompt = preamble + hit texts (+ the
    question unless ``include_question=False``, which reproduces the
    reference).  Without hits: system prompt = general preamble, user prompt =
    the question.
    """
    h = hit_items(hits, query_id, file_col, text_col, rank_col)
    j = queries.select(query_id, F.col(question_col).alias("_question")).join(h, query_id, "left")
    sys_p, user_p = prompt_columns(F.col("_question"), context_of("items"), F.col("n_hits"), include_question)
    return j.select(query_id, sys_p.alias("system_prompt"), user_p.alias("user_prompt"),
                    F.coalesce(F.col("n_hits"), F.lit(0)).cast("int").alias("n_hits"))
